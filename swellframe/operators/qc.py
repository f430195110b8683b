"""Filters and quality control, as column rules. Nothing here shuffles, but for `complete_cases` and `every_kth`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Plausible ranges, both ends kept.
RANGES = {
    "hs": (0, 30), "hmax": (0, 40), "hcmax": (0, 40), "tm": (0, 40), "tp": (0, 40), "dm": (-180, 360), "dp": (-180, 360),
    "wind_spd": (0, 150), "gust": (0, 200), "sst": (-70, 70), "air_temp": (-80, 80), "dewpoint": (-80, 80), "mslp": (500, 1500),
}
#: Observations that an altimeter record needs; 17 unless named here, None for no bound.
LEAST_OBS = {"GFO": 3, "TOPEX": 7, "GEOSAT": None, "CFOSAT": None}


def ranged(df: DataFrame, ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """F1. Values out of their range, and NaN, become null."""
    ranges = ranges or RANGES
    return df.withColumns({c: F.when(F.col(c).between(*r) & ~F.isnan(c), F.col(c)) for c, r in ranges.items() if c in df.columns})


def least_obs(mission: Column) -> Column:
    bound = F.lit(17)
    for name, n in LEAST_OBS.items():
        bound = F.when(mission == name, F.lit(n)).otherwise(bound)
    return bound


def altimeter_qc(df: DataFrame, depth: float = 80.0, coast: float = 50.0, swh_std: float = 1.5, sig0_std: float = 0.8, qc: float = 2.0, max_hs: float = 20.0, max_wind: float = 60.0, only_time: bool = False, start: float | None = None, end: float | None = None) -> DataFrame:
    """F2. Records that pass depth, coast, spread, count, flag and range rules; each row by its own mission's count.

    Columns: mission, time, wdepth, distcoast, swh_std, sig0_std, n_obs, qc, hs, hs_cal, wnd, wnd_cal.
    """
    ok = F.lit(True)
    if start is not None and end is not None:
        ok = F.col("time").between(start, end)
    if not only_time:
        least = least_obs(F.col("mission"))
        ok = ok & (F.col("wdepth") >= depth) & (F.col("distcoast") >= coast) & (F.col("swh_std") <= swh_std) & (F.col("sig0_std") <= sig0_std)
        ok = ok & (least.isNull() | (F.col("n_obs") >= least)) & (F.col("qc") <= qc)
        for c, low, high in (("hs", 0.1, max_hs), ("hs_cal", 0.1, max_hs), ("wnd", 0.2, max_wind), ("wnd_cal", 0.2, max_wind)):
            ok = ok & (F.col(c) > low) & (F.col(c) < high)
    return df.where(ok)


def extraction_qc(df: DataFrame, values: dict[str, float], directions: tuple[str, ...] = ()) -> DataFrame:
    """F3. Values below 0.01 or above their maximum, and directions out of -180..360, become null."""
    rules = {c: F.when((F.col(c) >= 0.01) & (F.col(c) <= top), F.col(c)) for c, top in values.items()}
    rules |= {c: F.when(F.col(c).between(-180, 360), F.col(c)) for c in directions}
    return df.withColumns(rules)


def within(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], time: tuple | None = None) -> DataFrame:
    """F4. Rows in a box, its edges included."""
    ok = F.col("lat").between(*lat) & F.col("lon").between(*lon)
    return df.where(ok & F.col("time").between(*time) if time else ok)


def pairs_qc(df: DataFrame, low: float, high: float, most: float, model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """F5. Pairs with both values strictly inside (low, high) that differ by at most `most`."""
    m, o = F.col(model), F.col(obs)
    return df.where((m > low) & (m < high) & (o > low) & (o < high) & (F.abs(m - o) <= most))


def matchup_qc(df: DataFrame, values: tuple[str, ...] = ("model_hs", "obs_hs", "model_wnd", "obs_wnd")) -> DataFrame:
    """F6. Matchups over open sea with all values in [0, 999)."""
    ok = (F.col("mask") == 1) & (F.col("distcoast") > 0) & (F.col("depth") > 0)
    for c in values:
        ok = ok & (F.col(c) >= 0) & (F.col(c) < 999)
    return df.where(ok)


def complete_cases(long: DataFrame, keys: list[str], value: str, members: int) -> DataFrame:
    """F7. Rows of the keys for which each of `members` rows has a value."""
    full = long.where(F.col(value).isNotNull()).groupBy(*keys).count().where(F.col("count") == members).select(*keys)
    return long.join(full, keys, "left_semi")


def stratum(df: DataFrame, depth: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, cyclone_above: int | None = None) -> DataFrame:
    """F8. A stratum by depth (low, high], latitude band and cyclone class."""
    ok = F.lit(True)
    if depth:
        ok = ok & (F.col("depth") > depth[0]) & (F.col("depth") <= depth[1])
    if lat:
        ok = ok & F.col("lat").between(*lat)
    if cyclone_above is not None:
        ok = ok & (F.col("cyclone") > cyclone_above)
    return df.where(ok)


def every_kth(df: DataFrame, k: int, keys: list[str], time: str = "time") -> DataFrame:
    """F9. Every k-th distinct time of a series, from its first. Distinct times are ranked, and rows meet those that stay."""
    own = df.withColumns({"_k": F.struct(*keys), "_t": F.col(time)})
    times = own.where(F.col(time).isNotNull()).select("_k", "_t").distinct()
    w = Window.partitionBy("_k").orderBy("_t")
    kept = times.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % k == 0).select("_k", "_t")
    return own.join(kept, ["_k", "_t"], "left_semi").drop("_k", "_t")


def numerous(df: DataFrame, keys: list[str], more_than: int = 2) -> DataFrame:
    """Rows of the keys that have more than so many; none of the others."""
    enough = df.groupBy(*keys).count().where(F.col("count") > more_than).select(*keys)
    return df.join(enough, keys, "left_semi")
