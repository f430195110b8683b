"""Interpolation between grid points, and the building of grid information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import axis_bracket


def _bracket(x: Column, first: float, step: float) -> tuple[Column, Column]:
    """Lower index and fraction on a regular axis."""
    p = (x - first) / step
    i = F.floor(p).cast("int")
    return i, p - i


def _interpolated(rows: DataFrame, field: DataFrame, values: list[str], key: str, brackets, sizes: tuple[int, int, int], wrap: bool) -> DataFrame:
    """Each row lists its corners with a weight (corners of weight 0 are left out), which join the field by index; the field is first
    cut to the corners that any row asks for. brackets: lower index and fraction of lat, lon and time."""
    (i, a), (j, b), (k, c) = brackets
    nlat, nlon, nt = sizes
    r = rows.select(key, i.alias("i"), a.alias("a"), j.alias("j"), b.alias("b"), k.alias("k"), c.alias("c"))
    ends = lambda n, w: F.array(F.struct(F.col(n).alias("n"), (1 - F.col(w)).alias("w")), F.struct((F.col(n) + 1).alias("n"), F.col(w).alias("w")))
    for n, w, out in (("i", "a", "la"), ("j", "b", "lo"), ("k", "c", "ti")):
        r = r.withColumn(out, F.explode(F.filter(ends(n, w), lambda x: x.w > 0)))
    lon_idx = F.pmod(F.col("lo.n"), F.lit(nlon)) if wrap else F.col("lo.n")
    inside = F.col("la.n").between(0, nlat - 1) & F.col("ti.n").between(0, nt - 1) & lon_idx.between(0, nlon - 1)
    r = r.select(key, F.col("la.n").alias("lat_idx"), lon_idx.alias("lon_idx"), F.col("ti.n").alias("t_idx"), (F.col("la.w") * F.col("lo.w") * F.col("ti.w")).alias("w"), inside.alias("inside"))
    at = ["t_idx", "lat_idx", "lon_idx"]
    cut = field.join(r.where("inside").select(*at).distinct(), at, "left_semi")
    got = r.join(cut.select(*at, *values), at, "left")
    full = lambda v: F.when(F.count(v) == F.count("*"), F.sum(F.col("w") * F.col(v)))
    out = got.groupBy(key).agg(F.min("inside").alias("_in"), *[full(v).alias(v) for v in values])
    return rows.join(out.select(key, *[F.when(F.col("_in"), F.col(v)).alias(v) for v in values]), key, "left")


def on_axes(rows: DataFrame, field: DataFrame, values: list[str], key: str, lats: list[float], lons: list[float], times: list[float], period: float | None = None) -> DataFrame:
    """J10, J12. As `trilinear`, between the values of any ascending axes. With a period (of longitudes), the last longitude is followed by the first; rows are within it.

    rows: key, lat, lon, time. field: t_idx, lat_idx, lon_idx and values; indices count from 0 along the axes.
    """
    turn = [lons[-1] - period, *lons, lons[0] + period] if period else lons
    j, b = axis_bracket(turn, F.col("lon"))
    brackets = (axis_bracket(lats, F.col("lat")), (j - 1 if period else j, b), axis_bracket(times, F.col("time")))
    return _interpolated(rows, field, values, key, brackets, (len(lats), len(lons), len(times)), period is not None)


def trilinear(rows: DataFrame, field: DataFrame, values: list[str], key: str, lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int, t0: float, dt: float, nt: int, wrap: bool = False) -> DataFrame:
    """J10. Field values at the place and time of each row, on regular axes; null outside the axes or where a corner is missing.

    rows: key, lat, lon, time. field: t_idx, lat_idx, lon_idx and values.
    """
    brackets = (_bracket(F.col("lat"), lat0, dlat), _bracket(F.col("lon"), lon0, dlon), _bracket(F.col("time"), t0, dt))
    return _interpolated(rows, field, values, key, brackets, (nlat, nlon, nt), wrap)


def bilinear(cells: DataFrame, source: DataFrame, values: list[str], key: str, lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int, wrap: bool = True) -> DataFrame:
    """J12. Bathymetry or coast distance at the cells of another grid: `trilinear` at one time."""
    rows = cells.withColumn("time", F.lit(0.0))
    return trilinear(rows, source.withColumn("t_idx", F.lit(0)), values, key, lat0, dlat, nlat, lon0, dlon, nlon, 0.0, 1.0, 1, wrap).drop("time")


def grid_mask(cells: DataFrame, min_depth: float = 80.0, min_coast: float = 50.0, elevation: str = "z", coast: str = "distcoast", status: str | None = None) -> DataFrame:
    """J13. depth, distcoast and mask: null over land, 1 in deep and open sea, 0 elsewhere; the first longitude's mask is the last's.

    Land is where z > 0, or by the model's status map (over 100, or 0).
    """
    land = (F.col(status) > 100) | (F.col(status) == 0) if status else F.col(elevation) > 0
    land = land | F.col(elevation).isNull()
    depth = F.when(~land, F.greatest(-F.col(elevation), F.lit(0.0)))
    out = cells.withColumn("depth", depth).withColumn("distcoast", F.when(~land, F.col(coast)))
    out = out.withColumn("mask", F.when(F.col("depth").isNotNull(), F.when((F.col("depth") >= min_depth) & (F.col("distcoast") >= min_coast), 1.0).otherwise(0.0)))
    last = out.agg(F.max("lon_idx").alias("m"))
    seam = out.join(F.broadcast(last), F.col("lon_idx") == F.col("m")).select("lat_idx", F.col("mask").alias("_m"), F.lit(True).alias("_s"))
    out = out.join(seam, "lat_idx", "left")
    return out.withColumn("mask", F.when((F.col("lon_idx") == 0) & F.col("_s"), F.col("_m")).otherwise(F.col("mask"))).drop("_m", "_s")
