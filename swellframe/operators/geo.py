"""Joins in space: nearest cells, radius and nearest-neighbour gridding, along-track segments, storm footprints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_KM, axis_nearest, cell3, cube_number, distance_weight, great_circle_km, nearest_index, slot, sphere_km, touching
from ..storage import broadcast_if_few, stored
from .qc import numerous

#: Edge of the cubes that `radius_means` deals by, in radii (two at least): larger ones have fewer copies of a row and more candidates.
CUBES = 4


def nearest_cell(df: DataFrame, lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int, wrap: bool = True, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """J4. lat_idx and lon_idx of the nearest cell of a regular grid, each axis on its own; the lower index halfway."""
    return df.withColumns({"lat_idx": nearest_index(F.col(lat), lat0, dlat, nlat), "lon_idx": nearest_index(F.col(lon), lon0, dlon, nlon, wrap)})


def nearest_on_axes(df: DataFrame, lats: list[float], lons: list[float], period: float | None = None, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """J4. lat_idx and lon_idx of the nearest values of any ascending axes (Gaussian latitudes, gaps), each on its own; the lower index halfway."""
    return df.withColumns({"lat_idx": axis_nearest(lats, F.col(lat)), "lon_idx": axis_nearest(lons, F.col(lon), period)})


def satellite_matchup(tracks: DataFrame, field: DataFrame, step: float = 3600.0, half: float = 1800.0) -> DataFrame:
    """J3. Model values at satellite rows: valid times of the field that are also slot times of a track, rows strictly
    less than `half` seconds from them, the nearest cell. The field is cut to the cells and times that are asked for.

    tracks: time, lat_idx, lon_idx and observations. field: run_id, cycle, valid_time, lat_idx, lon_idx, model columns.
    """
    s = slot(F.col("time"), step)
    rows = tracks.withColumn("valid_time", (s * step).cast("bigint")).where(F.abs(F.col("time") - s * step) < half)
    wanted = rows.select("valid_time", "lat_idx", "lon_idx").distinct()
    cut = field.join(wanted, ["valid_time", "lat_idx", "lon_idx"], "left_semi")
    return cut.join(rows, ["valid_time", "lat_idx", "lon_idx"])


def counts_in_time(points: DataFrame, tracks: DataFrame, half: float) -> DataFrame:
    """points (any columns, and time) with n_time, the track rows less than `half` seconds away.

    Distinct times of a bucket of 2 `half` seconds and the ends of the points' intervals are run over once, in order, with the count so far. An
    interval begins in one bucket and ends in the next: rows of the first after its begin, and of the second before its end. Times are compared in
    microseconds. Only track rows of those buckets are dealt.
    """
    width = round(2e6 * half)
    micros = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
    bucket = lambda c: F.floor(c / width)
    begin = micros("time") - width // 2
    asked = points.select("*", begin.alias("_t0"), bucket(begin).alias("_b0"))
    wanted = broadcast_if_few(asked.select(F.explode(F.array("_b0", F.col("_b0") + 1)).alias("b")).distinct(), "buckets")
    seen = tracks.select(micros("time").alias("t")).withColumn("b", bucket(F.col("t"))).join(wanted, "b", "left_semi")
    seen = seen.groupBy("b", "t").agg(F.count("*").alias("c")).select("b", "t", F.lit(1).alias("kind"), "c")
    # an end counts what is before it (kind 0 stands before rows of its time), a begin what is up to it (kind 2, after them)
    ends = asked.select(F.inline(F.array(F.struct(F.col("_b0").alias("b"), F.col("_t0").alias("t"), F.lit(2).alias("kind")), F.struct((F.col("_b0") + 1).alias("b"), (F.col("_t0") + width).alias("t"), F.lit(0).alias("kind")))))
    run = seen.unionByName(ends.distinct().withColumn("c", F.lit(0).cast("bigint")))
    sofar = Window.partitionBy("b").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = run.select("b", "t", "kind", F.sum("c").over(sofar).alias("upto"), F.sum("c").over(Window.partitionBy("b")).alias("all"))
    before = run.where("kind = 2").select(F.col("t").alias("_t0"), (F.col("all") - F.col("upto")).alias("_first"))
    after = run.where("kind = 0").select((F.col("t") - width).alias("_t0"), F.col("upto").alias("_second"))
    out = asked.join(before.join(after, "_t0"), "_t0")
    return out.withColumn("n_time", F.col("_first") + F.col("_second")).drop("_t0", "_b0", "_first", "_second")


def dealt_around(rows: DataFrame, edge: float, radius: float, width: float, half: float) -> DataFrame:
    """rows with the bucket and the cube of every place and time less than `half` seconds and at most `radius` km away from theirs, a row each.

    Of the cubes that the ball around a row may meet, at most two on each axis (`edge` is at least twice the radius), those stay that it does meet
    and that the sphere passes through.
    """
    reach, slack = radius + 1e-3, 1e-3
    out = rows.withColumns(dict(zip(("_x", "_y", "_z"), sphere_km(F.col("lat"), F.col("lon")), strict=True)))
    out = out.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("time") - half) / width), F.floor((F.col("time") + half) / width))))
    off, least, most = [], [], []
    for c in ("_x", "_y", "_z"):
        at, low = F.col(c), F.col(f"_i{c}") * edge
        out = out.withColumn(f"_i{c}", F.explode(F.sequence(F.floor((at - reach) / edge), F.floor((at + reach) / edge))))
        high = low + edge
        off.append(F.pow(F.greatest(low - at, at - high, F.lit(0.0)), F.lit(2)))
        least.append(F.pow(F.greatest(low, -high, F.lit(0.0)), F.lit(2)))
        most.append(F.pow(F.greatest(F.abs(low), F.abs(high)), F.lit(2)))
    out = out.where((sum(off) <= reach**2) & (sum(least) <= (EARTH_KM + slack) ** 2) & (sum(most) >= (EARTH_KM - slack) ** 2))
    return out.select(*rows.columns, "bucket", cube_number(F.col("_i_x"), F.col("_i_y"), F.col("_i_z")).alias("cell"))


def radius_means(points: DataFrame, tracks: DataFrame, values: list[str], key: str, radius: float = 50.0, half: float = 2700.0, mission: str | None = "satellite_id") -> DataFrame:
    """J5, J6, T2. A row for each key of points that has more than two track rows less than `half` seconds away, and two of these at most `radius` km away:
    the number of the latter (n), the means of their values, and their commonest mission (the lowest on a tie).

    A point is in one time bucket and one cube of the sphere; a track row goes to those that a point near it may be in. Missions are counted before
    they are compared, so that no pair of a point and a row is kept or sorted. A key with three rows in the radius has three in time; only
    those with two have their rows in time counted, by `counts_in_time`, without looking at space.
    """
    edge, width = CUBES * radius, 2 * half
    place = [F.floor(c / edge) for c in sphere_km(F.col("lat"), F.col("lon"))]
    asked = points.select(key, F.col("time").alias("pt"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.floor(F.col("time") / width).alias("bucket"), cube_number(*place).alias("cell"))
    rows = dealt_around(tracks.select("time", "lat", "lon", *values, *([mission] if mission else [])), edge, radius, width, half)
    # cheap and true of whatever is near, where latitudes end at the poles
    about = (F.abs(F.col("lat") - F.col("plat")) <= math.degrees(radius / EARTH_KM) + 1e-6) | (F.abs("lat") > 90) | (F.abs("plat") > 90)
    near = asked.join(rows, ["bucket", "cell"]).where((F.abs(F.col("time") - F.col("pt")) < half) & about)
    near = near.where(great_circle_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")) <= radius)
    n = F.count("*").alias("n")
    if mission:
        each = near.groupBy(key, mission).agg(n, *[a for v in values for a in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))])
        commonest = F.min(F.when(F.col(mission).isNotNull(), F.struct(-F.col("n"), mission)))[mission].alias(mission)
        means = [F.try_divide(F.sum(f"sum_{v}"), F.sum(f"n_{v}")).alias(v) for v in values]
        found = each.groupBy(key).agg(F.sum("n").alias("n"), *means, commonest)
    else:
        found = near.groupBy(key).agg(n, *[F.avg(v).alias(v) for v in values])
    found = stored(found.where(F.col(key).isNotNull() & (F.col("n") >= 2)), "found")
    two = broadcast_if_few(found.where("n = 2").select(key), "two")
    counted = counts_in_time(stored(points.select(key, "time").join(two, key, "left_semi"), "counted"), tracks, half)
    enough = counted.groupBy(key).agg(F.sum("n_time").alias("n_time")).where("n_time > 2").select(key)
    return found.where("n > 2").unionByName(found.where("n = 2").join(enough, key, "left_semi"))


def radius_extraction(points: DataFrame, tracks: DataFrame, values: list[str], key: str, radius: float = 50.0, half: float = 2700.0, mission: str | None = "satellite_id") -> DataFrame:
    """J5, J6. points with their columns of `radius_means`, nulls where they have none."""
    return points.join(radius_means(points, tracks, values, key, radius, half, mission), key, "left")


def gridded(tracks: DataFrame, grid: DataFrame, values: list[str], step: float = 3600.0, half: float = 1800.0, limit: float = 35.0, neighbours: int = 8, weight=None, order: str = "src_id") -> DataFrame:
    """J7, J8, W3. Weighted means on grid points by time slot: of the `neighbours` nearest rows (by distance, then `order`)
    within `limit` km, for each value, of the rows that have it; for the first also the weighted deviation and the number of rows.

    grid: lat_idx, lon_idx, lat, lon. The grid is the side that is listed under 27 cubes, and only its cubes near tracks meet any row.
    weight: a function Column -> Column of the distance; `distance_weight` by default.
    """
    weight = weight or (lambda d: distance_weight(d, limit))
    s = slot(F.col("time"), step)
    rows = tracks.withColumn("slot", s).where(F.abs(F.col("time") - s * step) < half).withColumn("cell", cell3(F.col("lat"), F.col("lon"), limit))
    at = grid.select("lat_idx", "lon_idx", F.col("lat").alias("glat"), F.col("lon").alias("glon")).withColumn("cell", F.explode(touching(cell3(F.col("glat"), F.col("glon"), limit))))
    near = rows.join(at, "cell").withColumn("d", great_circle_km(F.col("glat"), F.col("glon"), F.col("lat"), F.col("lon"))).where(F.col("d") <= limit)
    w = Window.partitionBy("slot", "lat_idx", "lon_idx").orderBy("d", order)
    near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= neighbours).withColumn("w", weight(F.col("d")))
    own = lambda v: F.when(F.col(v).isNotNull(), F.col("w"))  # noqa: E731  weights of the rows that have the value
    mean = lambda v: F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(own(v)))
    v = values[0]
    v1, v2 = F.sum(own(v)), F.sum(own(v) * own(v))
    about = F.sum(F.col("w") * F.col(v) * F.col(v)) - F.pow(F.sum(F.col("w") * F.col(v)), 2) / v1
    std = F.when(F.count(v) > 1, F.sqrt(F.greatest(F.try_divide(v1, v1 * v1 - v2) * about, F.lit(0.0))))
    return near.groupBy("slot", "lat_idx", "lon_idx").agg(*[mean(x).alias(x) for x in values], std.alias(f"{v}_std"), F.count("*").alias("n"), F.min_by(v, F.when(F.col(v).isNotNull(), F.struct("d", order))).alias(f"{v}_nearest"))


def gridded_qc(df: DataFrame, hs: str = "hs", wnd: str = "wnd", max_hs: float = 20.0, max_wnd: float = 60.0) -> DataFrame:
    """J9, first stage. Grid points with plausible values, some spread and rows behind them."""
    ok = (F.col(hs) > 0.01) & (F.col(wnd) > 0.01) & (F.col(hs) < max_hs) & (F.col(wnd) < max_wnd) & (F.col(f"{hs}_std") > 0.001) & (F.col("n") > 0)
    return df.where(ok)


def gridded_final(df: DataFrame, waves: tuple[str, ...] = ("hs", "hs_cal"), winds: tuple[str, ...] = ("wnd", "wnd_cal"), hs_range: tuple[float, float] = (0.1, 20.0), wnd_range: tuple[float, float] = (0.2, 60.0), least_depth: float = 80.0, least_coast: float = 50.0) -> DataFrame:
    """J9, second stage. Values outside their range become null; points stay whose first height is in range, in water of at least
    `least_depth`, at least `least_coast` from the coast (columns depth and distcoast)."""
    cut = {c: F.when(F.col(c).between(*r), F.col(c)) for cs, r in ((waves, hs_range), (winds, wnd_range)) for c in cs if c in df.columns}
    return df.withColumns(cut).where((F.col(waves[0]) >= hs_range[0]) & (F.col("depth") >= least_depth) & (F.col("distcoast") >= least_coast))


def along_track(tracks: DataFrame, keys: list[str], values: list[str], step: float = 3600.0, half: float = 1800.0, limit: float = 35.0, order: tuple[str, ...] = ("time", "src_id"), distance=great_circle_km) -> DataFrame:
    """A20, W4. Means of track segments: by mission and time slot, rows are cut by their distance from the slot's first row.

    Longitude is that of the middle row (round(n / 2), half to even, from 0), which avoids averaging over 0/360. The window is
    a mission's slot, so no partition holds a mission.
    """
    s = slot(F.col("time"), step)
    rows = tracks.withColumn("slot", s).where(F.abs(F.col("time") - s * step) < half)
    w = Window.partitionBy(*keys, "slot").orderBy(*order)
    first = lambda c: F.first(c).over(w)
    rows = rows.withColumns({"_la": first("lat"), "_lo": first("lon"), "_n": F.count("*").over(Window.partitionBy(*keys, "slot"))}).where("_n >= 2")
    rows = rows.withColumn("segment", F.floor(distance(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")) / limit).cast("int"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "slot", "segment").orderBy(*order)) - 1)
    n = F.count("*")
    lons = F.sort_array(F.collect_list(F.struct(F.col("_r").alias("r"), F.col("lon").alias("lon"))))
    out = ranked.groupBy(*keys, "slot", "segment").agg(n.alias("n"), F.avg("time").alias("time"), F.avg("lat").alias("lat"), lons.alias("_l"), *[F.avg(v).alias(v) for v in values])
    mid = F.least(F.bround(F.col("n") / 2).cast("int"), F.col("n").cast("int") - 1)
    return out.withColumn("lon", F.element_at("_l", mid + 1)["lon"]).drop("_l")


def along_track_final(segments: DataFrame, keys: list[str], hs: tuple[float, float] = (0.1, 20.0), wnd: tuple[float, float] = (0.2, 60.0), least_depth: float = 80.0, least_coast: float = 50.0, time: tuple[float, float] | None = None, check: bool = True) -> DataFrame:
    """A20. Segments of `along_track` over deep and open water with heights and winds strictly within their ranges, in the time window (ends included);
    without check, the window only. A mission with at most two left has none.

    segments: keys, time, wdepth, distcoast, hs, wnd.
    """
    ok = F.col("time").between(*time) if time else F.lit(True)
    if check:
        ok = ok & (F.col("wdepth") >= least_depth) & (F.col("distcoast") >= least_coast)
        for c, (low, high) in (("hs", hs), ("wnd", wnd)):
            ok = ok & (F.col(c) > low) & (F.col(c) < high)
    return numerous(segments.where(ok), keys)


#: Class codes of storm natures; any other is 1.
NATURE_CODES = {"TS": 5, "SS": 4, "ET": 3, "DS": 2}


def footprint_radius(lat: Column) -> Column:
    """Radius (km) of a storm: 500 to 20 degrees, 1000 from 40, a line between."""
    a = F.abs(lat)
    return F.when(a <= 20, 500.0).when(a >= 40, 1000.0).otherwise(500.0 + (a - 20) * 25.0)


def ocean_runs(cells: DataFrame, ocean: str) -> DataFrame:
    """lat_idx, first, last: runs of neighbouring cells of a latitude for which the boolean column holds."""
    run = F.col("lon_idx") - F.row_number().over(Window.partitionBy("lat_idx").orderBy("lon_idx"))
    return cells.where(F.col(ocean)).select("lat_idx", "lon_idx").distinct().withColumn("_r", run).groupBy("lat_idx", "_r").agg(F.min("lon_idx").alias("first"), F.max("lon_idx").alias("last")).drop("_r")


def storm_footprints(storms: DataFrame, lat0: float, dlat: float, nlat: int, lon0: float, dlon: float, nlon: int, step: float = 10800.0, within: float = 5401.0, cells: DataFrame | None = None, ocean: str = "ocean") -> DataFrame:
    """J15. Cells of each 3-hourly slot that a storm covers: slot, lat_idx, lon_idx, code (of the last storm row). Sparse: other cells are 0, land
    (see `storm_map`) -1.

    A storm row lists the slots within reach and, for each latitude that it reaches, the span of longitudes in the circle around its grid-snapped
    centre. With cells (lat_idx, lon_idx and the boolean column `ocean`), spans are cut to the runs of ocean, so that only cells that are kept are ever listed.
    storms: row_no, time, nature, lat, lon (0..360).
    """
    t = F.col("time")
    slots = F.sequence(F.ceil((t - within) / step).cast("bigint"), F.floor((t + within) / step).cast("bigint"))
    code = F.lit(1)
    for name, n in NATURE_CODES.items():
        code = F.when(F.col("nature") == name, n).otherwise(code)
    s = storms.select("row_no", code.alias("code"), F.explode(slots).alias("slot"), nearest_index(F.col("lat"), lat0, dlat, nlat).alias("ci"), nearest_index(F.col("lon"), lon0, dlon, nlon, True).alias("cj"))
    s = s.withColumn("clat", lat0 + F.col("ci") * dlat).withColumn("radius", footprint_radius(F.col("clat")))
    reach = F.ceil(F.col("radius") / 111.19 / dlat).cast("int")
    s = s.withColumn("lat_idx", F.explode(F.sequence(F.greatest(F.col("ci") - reach, F.lit(0)), F.least(F.col("ci") + reach, F.lit(nlat - 1)))))
    s = s.withColumn("la", lat0 + F.col("lat_idx") * dlat)
    # half a span: from the spherical law of cosines, then set right by the distance itself, which decides
    a, b = F.radians("clat"), F.radians("la")
    q = F.try_divide(F.cos(F.col("radius") / EARTH_KM) - F.sin(a) * F.sin(b), F.cos(a) * F.cos(b))
    k = F.floor(F.degrees(F.acos(F.greatest(F.least(q, F.lit(1.0)), F.lit(-1.0)))) / dlon)
    inside = lambda k: great_circle_km(F.col("clat"), F.lit(0.0), F.col("la"), k * dlon) <= F.col("radius")
    s = s.withColumn("k", F.least(F.coalesce(k, F.lit(nlon)), F.lit(nlon // 2 - 1)).cast("int"))
    s = s.withColumn("k", F.when(inside(F.col("k") + 1), F.col("k") + 1).when(inside(F.col("k")), F.col("k")).otherwise(F.col("k") - 1)).where("k >= 0")
    whole = 2 * F.col("k") + 1 >= nlon
    low = F.pmod(F.col("cj") - F.col("k"), F.lit(nlon))
    high = low + 2 * F.col("k")
    spans = F.when(whole, F.array(F.struct(F.lit(0).alias("x"), F.lit(nlon - 1).alias("y")))).when(high < nlon, F.array(F.struct(low.alias("x"), high.alias("y")))).otherwise(
        F.array(F.struct(low.alias("x"), F.lit(nlon - 1).alias("y")), F.struct(F.lit(0).alias("x"), (high - nlon).alias("y")))
    )
    s = s.select("row_no", "code", "slot", "lat_idx", F.inline(spans))
    if cells is not None:
        s = s.join(ocean_runs(cells, ocean), "lat_idx").where((F.col("first") <= F.col("y")) & (F.col("last") >= F.col("x")))
        s = s.withColumns({"x": F.greatest("x", "first"), "y": F.least("y", "last")})
    s = s.withColumn("lon_idx", F.explode(F.sequence("x", "y")))
    return s.groupBy("slot", "lat_idx", "lon_idx").agg(F.max_by("code", "row_no").alias("code"))


def storm_map(footprints: DataFrame, cells: DataFrame, slots: DataFrame, ocean: str = "ocean") -> DataFrame:
    """J15. The whole map: slot, lat_idx, lon_idx, code of every cell at every slot: -1 on land, 0 where no storm is. slots: slot, a table of times."""
    every = cells.select("lat_idx", "lon_idx", ocean).crossJoin(F.broadcast(slots.select("slot")))  # a map has all its cells
    found = every.join(footprints, ["slot", "lat_idx", "lon_idx"], "left")
    return found.select("slot", "lat_idx", "lon_idx", F.when(F.col(ocean), F.coalesce("code", F.lit(0))).otherwise(-1).alias("code"))
