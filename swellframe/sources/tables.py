"""Decoded tables: aliases to one name, fixed shapes, missing values as null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mean_of, period, wind_at_height
from ..operators.qc import altimeter_qc, numerous, ranged

#: Names under which a variable may be stored, in the order they are tried.
MODEL_ALIASES = {
    "hs": ("hs", "swh", "HTSGW_surface"), "uwnd": ("uwnd", "u", "UGRD_surface"), "vwnd": ("vwnd", "v", "VGRD_surface"), "wind": ("wind", "wnd", "WIND_surface"),
    "lat": ("lat", "latitude", "LATITUDE", "LAT"), "lon": ("lon", "longitude", "LONGITUDE", "LON"),
}
BUOY_ALIASES = {
    "hs": ("wave_height", "VHM0", "VGHS", "VAVH"), "hmax": ("VZMX",), "tm": ("average_wpd", "VTM02", "VGTA"), "tp": ("dominant_wpd", "VTPK"), "dm": ("mean_wave_dir", "VMDR"), "dp": ("VPED",),
    "wind_spd": ("wind_spd", "WSPD"), "wind_dir": ("wind_dir", "WDIR"), "gust": ("gust", "GSPD"), "mslp": ("air_pressure", "ATMS"), "air_temp": ("air_temperature", "DRYT"), "dewpoint": ("dewpt_temperature", "DEWT"), "sst": ("sea_surface_temperature", "TEMP"),
}


def _value(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = mean_of(F.col(name)) if kind.startswith("array") else F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def aliased(df: DataFrame, aliases: dict[str, tuple[str, ...]], keep: list[str]) -> DataFrame:
    """Columns under their standard names: the first alias with a value; array columns (a depth axis) by their mean."""
    found = {to: [n for n in names if n in df.columns] for to, names in aliases.items()}
    made = [F.coalesce(*[_value(df, n) for n in names]).alias(to) for to, names in found.items() if names]
    return df.select(*[c for c in keep if c in df.columns], *made)


def model_points(df: DataFrame, station: str | None = None) -> DataFrame:
    """S1. Model series by station: hs under any alias, tp = 1 / fp, plausible ranges."""
    rest = [c for c in df.columns if c not in {n for names in MODEL_ALIASES.values() for n in names}]
    out = aliased(df, MODEL_ALIASES, rest)
    if "fp" in out.columns:
        out = out.withColumn("tp", period(F.col("fp"))).drop("fp")
    out = ranged(out)
    return out.where(F.col("station") == station) if station is not None else out


def buoys(df: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """S3. Buoy rows of either archive; wind at 10 m by the station's anemometer height (4 m where unknown)."""
    out = aliased(df, BUOY_ALIASES, ["station", "time", "lat", "lon"])
    if stations is not None:
        out = out.join(stations.select("station", "anemometer_height"), "station", "left")
        out = out.withColumns({c: wind_at_height(F.col(c), F.col("anemometer_height")) for c in ("wind_spd", "gust") if c in out.columns}).drop("anemometer_height")
    return ranged(out)


def altimeter_tiles(df: DataFrame, mission: str, start: float, end: float, margin: float = 1800.0, least: int = 10) -> DataFrame:
    """S4. A mission's rows in the time window; tiles with at most `least` of them are skipped; Ku-band columns where a tile
    has them, else Ka; depth positive downward. Partition columns (mission, tile) prune the scan.

    df: mission, tile_lat, tile_lon, time, lat, lon, bot_depth, dist2coast, wspd, wspd_cal and *_ku, *_ka columns.
    """
    tile = ["mission", "tile_lat", "tile_lon"]
    rows = df.where((F.col("mission") == mission) & F.col("time").between(start - margin, end + margin))
    bases = sorted({c[:-3] for c in df.columns if c.endswith("_ku")} & {c[:-3] for c in df.columns if c.endswith("_ka")})
    stats = rows.groupBy(*tile).agg(F.count("*").alias("_n"), F.count("swh_ku").alias("_ku")).where(F.col("_n") > least)
    rows = rows.join(stats, tile)
    made = [F.when(F.col("_ku") > 0, F.col(f"{b}_ku")).otherwise(F.col(f"{b}_ka")).alias(b) for b in bases]
    return rows.select(*tile, "time", "lat", "lon", (-F.col("bot_depth")).alias("wdepth"), F.col("dist2coast").alias("distcoast"), "wspd", "wspd_cal", *made)


def checked_tiles(tiles: DataFrame, start: float, end: float, **limits) -> DataFrame:
    """S4. Rows of `altimeter_tiles` that pass `altimeter_qc` within the time window; a mission with at most two left has none.

    tiles: mission, time, wdepth, distcoast, swh_std, sig0_std, n_obs, qc, swh, swh_cal, wspd, wspd_cal, which come out as hs, hs_cal, wnd and wnd_cal.
    """
    own = tiles.withColumnsRenamed({"swh": "hs", "swh_cal": "hs_cal", "wspd": "wnd", "wspd_cal": "wnd_cal"})
    only_time = limits.pop("only_time", False)
    ok = own.where(F.col("time").between(start, end)) if only_time else altimeter_qc(own, **limits).where(F.col("time").between(start, end))
    return numerous(ok, ["mission"])


def scatterometer(swaths: DataFrame) -> DataFrame:
    """S5. Swath cells as rows: the row's time for each cell, good cells only, 999 for a missing direction."""
    cells = swaths.select(*[c for c in ("mission", "time") if c in swaths.columns], F.inline(F.arrays_zip("lat", "lon", "wspd_cal", "qc", "wnd_dir")))
    return cells.where("qc = 1").withColumn("wnd_dir", F.coalesce("wnd_dir", F.lit(999.0))).drop("qc")


def model_fields(df: DataFrame) -> DataFrame:
    """S15. Fields under standard names; the wind speed from its components where it is not given."""
    rest = [c for c in df.columns if c not in {n for names in MODEL_ALIASES.values() for n in names}]
    out = aliased(df, MODEL_ALIASES, rest)
    if "wind" not in out.columns and {"uwnd", "vwnd"} <= set(out.columns):
        out = out.withColumn("wind", F.sqrt(F.col("uwnd") * F.col("uwnd") + F.col("vwnd") * F.col("vwnd")))
    return out


def spectrum_station(spectra: DataFrame, station: str | int) -> DataFrame:
    """S16. Spectra of a station by name, or by its place in name order for a number below 1000, with mean position and wind."""
    if isinstance(station, int) and station < 1000:
        first = spectra.select("station").distinct().orderBy("station").limit(station + 1)
        name = first.agg(F.max("station").alias("station"), F.count("*").alias("n")).where(F.col("n") == station + 1).select("station")
        own = spectra.join(F.broadcast(name), "station", "left_semi")  # one row
    else:
        own = spectra.where(F.col("station") == str(station))
    mean = own.groupBy("station").agg(*[F.avg(c).alias(f"mean_{c}") for c in ("lat", "lon", "depth") if c in own.columns])
    return own.join(F.broadcast(mean), "station")  # one row, of one station


def grid_info(spark: SparkSession, paths: list[str] | str, optional: tuple[str, ...] = ("distcoast", "depth", "ocean_id", "zone_id", "offshore_id")) -> DataFrame:
    """S17. Grid tables, several read as one; a missing optional column is null."""
    df = spark.read.option("mergeSchema", "true").parquet(*([paths] if isinstance(paths, str) else paths))
    return with_optional(df, optional)


def with_optional(df: DataFrame, optional: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in optional if c not in df.columns})
