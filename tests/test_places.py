"""Axes, polygons, storms, counts in time, gridding with gaps, final checks, files of a wanted size: against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellframe.functions import columns as c
from swellframe.operators import geo, interp, qc, zones
from swellframe.plans import QUERIES
from swellframe.sources import sinks, tables, texts


def km(a, b, x, y):
    a, b, x, y = map(math.radians, (a, b, x, y))
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2)))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 200])
def test_nearest_on_any_axis(spark, size):
    """Brute force with ties to the lower index; beyond both ends; halfway points."""
    rng = np.random.default_rng(size)
    axis = sorted(set(np.round(rng.uniform(-90, 90, size), 1).tolist()))
    x = rng.uniform(-100, 100, 300).tolist() + axis + [(a + b) / 2 for a, b in zip(axis, axis[1:])] + [None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [(r["x"], r["i"], r["k"]) for r in df.select("x", c.axis_nearest(axis, F.col("x")).alias("i"), c.axis_count(axis, F.col("x")).alias("k")).collect()]
    for v, i, k in got:
        assert (i, k) == ((None, None) if v is None else (int(np.argmin(np.abs(np.array(axis) - v))), sum(a <= v for a in axis)))


def test_nearest_longitude_goes_on_beyond_the_seam(spark):
    axis = [10.0, 100.0, 101.0, 350.0]
    df = spark.createDataFrame([(0.0,), (1.0,), (359.0,), (4.0,), (225.5,), (225.6,)], "x double")
    assert [r["i"] for r in df.select(c.axis_nearest(axis, F.col("x"), 360.0).alias("i")).collect()] == [3, 0, 3, 0, 2, 3]


def test_interpolation_between_uneven_axes(spark):
    """Exact on fields that are linear along each axis; on grid points, at the ends, outside, across the seam."""
    lats, lons, times = [-60.0, -10.0, 0.0, 3.0, 80.0], [5.0, 90.0, 100.0, 340.0], [0.0, 10.0, 100.0]
    field = [(t, i, j, lats[i] + 3 * lons[j] + 0.5 * times[t]) for t in range(3) for i in range(5) for j in range(4)]
    f = spark.createDataFrame(field, "t_idx int, lat_idx int, lon_idx int, v double")
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), float(t)) for i, (a, b, t) in enumerate(zip(rng.uniform(-60, 80, 40), rng.uniform(5, 340, 40), rng.uniform(0, 100, 40)))]
    rows += [(90, 80.0, 340.0, 100.0), (91, -60.0, 5.0, 0.0), (92, 81.0, 90.0, 0.0), (93, 0.0, 4.0, 0.0), (94, 0.0, 90.0, 101.0), (95, None, 90.0, 1.0)]
    r = spark.createDataFrame(rows, "id int, lat double, lon double, time double")
    got = {x["id"]: x["v"] for x in interp.on_axes(r, f, ["v"], "id", lats, lons, times).collect()}
    for i, a, b, t in rows:
        assert got[i] == (None if i in (92, 93, 94, 95) else pytest.approx(a + 3 * b + 0.5 * t))
    got = {x["id"]: x["v"] for x in interp.on_axes(r, f, ["v"], "id", lats, lons, times, 360.0).collect()}
    assert got[93] == pytest.approx(3 * (5 * 24 / 25 + 340 * 1 / 25)) and got[0] == pytest.approx(rows[0][1] + 3 * rows[0][2] + 0.5 * rows[0][3])


def even_odd(rings, x, y):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                inside = not inside
    return inside


def table(spark, shapes):
    rows = [(i, i, [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in rings]) for i, rings in shapes.items()]
    return spark.createDataFrame(rows, "zone_id int, zone_order int, rings array<array<struct<lon: double, lat: double>>>")


@pytest.mark.parametrize(("tile", "slab"), [(4.0, 1.0), (0.7, 0.3), (400.0, 200.0)])
def test_polygons_with_holes_and_parts(spark, tile, slab):
    """A ragged coast with a hole and an island in it, boxes on whole degrees, spikes; cells on both sides of every edge."""
    rng = np.random.default_rng(3)
    angle = np.linspace(0, 2 * np.pi, 700, endpoint=False)
    coast = [(100 + float(r * np.cos(t)), float(r * np.sin(t)) / 2) for t, r in zip(angle, 20 + 8 * np.sin(9 * angle) + rng.uniform(-1, 1, 700), strict=True)]
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = {1: [coast, square(96, -3, 6), square(98, -1, 2)], 2: [square(110, 0, 20), square(140, 5, 3)], 3: [[(60, -40), (75, 40), (61, -35)]]}
    cells = [(i, float(y), float(x)) for i, (x, y) in enumerate(zip(rng.uniform(55, 150, 4000), rng.uniform(-45, 45, 4000), strict=True))]
    got = {r["id"]: r["zone_id"] for r in zones.tagged(spark.createDataFrame(cells, "id int, lat double, lon double"), table(spark, shapes), "id", tile=tile, slab=slab).collect()}
    assert got == {i: max([k for k, rings in shapes.items() if even_odd(rings, x, y)], default=0) for i, y, x in cells}


def test_polygons_across_the_seam_and_land(spark):
    ring = [(170.0, -10.0), (-170.0, -10.0), (-170.0, 10.0), (170.0, 10.0)]
    also = [(-5.0, 20.0), (5.0, 20.0), (5.0, 30.0), (-5.0, 30.0)]
    cells = [(1, 0.0, 175.0), (2, 0.0, -175.0), (3, 0.0, 185.0), (4, 0.0, 0.0), (5, 0.0, 165.0), (6, 25.0, 358.0), (7, 25.0, -2.0), (8, 25.0, 3.0), (9, 25.0, 10.0)]
    df = spark.createDataFrame(cells, "id int, lat double, lon double").withColumn("dry", F.col("id") == 8)
    got = {r["id"]: r["zone_id"] for r in zones.tagged(df, table(spark, {4: [ring], 5: [also]}), "id", land="dry").collect()}
    assert got == {1: 4, 2: 4, 3: 4, 4: 0, 5: 0, 6: 5, 7: 5, 8: None, 9: 0}


def test_a_cell_meets_the_edges_of_its_tile_only(spark):
    """A coast of 100,000 corners: most tiles have no edges, and those that have some have few."""
    n = 100_000
    t = F.col("id") * (2 * math.pi / n)
    r = 20 + F.sin(t * 40) + F.sin(t * 6007) / 50
    ring = spark.range(n).select(F.struct((100 + r * F.cos(t)).alias("lon"), (r * F.sin(t)).alias("lat")).alias("p"), "id").groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "p"))).alias("a"))
    p = ring.select(F.lit(1).alias("zone_id"), F.lit(1).alias("zone_order"), F.transform("a", lambda x: x.p).alias("ring"))
    own = zones.index(p, 0.5, 0.1).select(F.size("edges").alias("n"), "inside")
    sizes = own.agg(F.max("n").alias("most"), F.count_if(F.col("inside") & (F.col("n") == 0)).alias("whole")).first()
    assert sizes["most"] < 1500 and sizes["whole"] > 10_000


def covered(storms, lat0, dlat, nlat, lon0, dlon, nlon, ocean):
    out = {}
    for no, time, nature, lat, lon in storms:
        code = {"TS": 5, "SS": 4, "ET": 3, "DS": 2}.get(nature, 1)
        ci = max(0, min(nlat - 1, math.ceil((lat - lat0) / dlat - 0.5)))
        cj = math.ceil((lon - lon0) / dlon - 0.5) % nlon
        cla = lat0 + ci * dlat
        radius = 500.0 if abs(cla) <= 20 else 1000.0 if abs(cla) >= 40 else 500 + (abs(cla) - 20) * 25
        for slot in range(math.ceil((time - 5401) / 10800), math.floor((time + 5401) / 10800) + 1):
            for i in range(nlat):
                for j in range(nlon):
                    if (i, j) in ocean and km(cla, lon0 + cj * dlon, lat0 + i * dlat, lon0 + j * dlon) <= radius and out.get((slot, i, j), (-1,))[0] < no:
                        out[slot, i, j] = (no, code)
    return {k: v[1] for k, v in out.items()}


def test_storms_over_ocean_at_poles_and_seam(spark):
    grid = {"lat0": -90.0, "dlat": 3.0, "nlat": 61, "lon0": 0.0, "dlon": 4.0, "nlon": 90}
    storms = [(1, 0.0, "TS", 88.0, 10.0), (2, 10.0, "ET", -90.0, 0.0), (3, 0.0, "SS", 0.0, 359.0), (4, 100.0, "NR", 35.0, 1.0), (5, 5400.0, "DS", 84.0, 200.0), (6, 30000.0, "TS", -79.0, 357.0)]
    rng = np.random.default_rng(5)
    wet = {(i, j): bool(rng.random() < 0.7 or i == 30) for i in range(61) for j in range(90)}
    s = spark.createDataFrame(storms, "row_no long, time double, nature string, lat double, lon double")
    cells = spark.createDataFrame([(i, j, w) for (i, j), w in wet.items()], "lat_idx int, lon_idx int, ocean boolean")
    rows = lambda df: {(r["slot"], r["lat_idx"], r["lon_idx"]): r["code"] for r in df.collect()}
    assert rows(geo.storm_footprints(s, **grid)) == covered(storms, **grid, ocean=set(wet))
    found = geo.storm_footprints(s, **grid, cells=cells)
    want = covered(storms, **grid, ocean={k for k, w in wet.items() if w})
    assert rows(found) == want
    whole = rows(geo.storm_map(found, cells, found.select("slot").distinct()))
    assert whole == {(t, i, j): want.get((t, i, j), 0) if w else -1 for t in {k[0] for k in want} for (i, j), w in wet.items()}


def test_counts_in_time(spark):
    """Strictly less than the half width; rows and points on the borders of buckets; microseconds; two rows a point in the plan's step."""
    rng = np.random.default_rng(6)
    times = rng.uniform(-20000, 20000, 400).round(6).tolist() + [0.0, 0.0, 5400.0, 2700.0, -2700.0, 8100.0, 0.000001] * 2
    points = rng.uniform(-20000, 20000, 100).round(6).tolist() + [0.0, 2700.0, 5400.0, -2700.0, 2700.000001, 2700.0]
    t = spark.createDataFrame([(x,) for x in times], "time double")
    p = spark.createDataFrame(list(enumerate(points)), "id int, time double")
    got = {r["id"]: r["n_time"] for r in geo.counts_in_time(p, t, 2700.0).collect()}
    micros = [round(x * 1e6) for x in times]
    assert got == {i: sum(abs(m - round(x * 1e6)) < 2_700_000_000 for m in micros) for i, x in enumerate(points)}


def test_means_and_missions_around_points(spark):
    """Brute force over poles, seam and bucket borders; keys that several points share count their rows in time together; missions of any type, ties, nulls."""
    rng = np.random.default_rng(8)
    at = [(0.0, 0.0), (89.9, 10.0), (-90.0, 0.0), (20.0, 179.9), (45.0, 359.9), (-33.0, 120.0)]
    spot = lambda: (min(90.0, max(-90.0, (p := at[rng.integers(len(at))])[0] + rng.normal(0, 0.3))), p[1] + rng.normal(0, 0.3) / max(0.1, math.cos(math.radians(p[0]))))
    when = lambda: float(rng.choice([rng.uniform(0, 90000), rng.integers(0, 30) * 2700.0]))
    track = [(when(), *spot(), [None, "b", "a", "c"][rng.integers(4)], None if rng.random() < 0.2 else float(rng.random())) for _ in range(700)]
    points = [(int(rng.integers(0, 300)), when(), *spot()) for _ in range(400)]
    points += [(400 + i, when(), 60.0, 60.0 + 3 * i) for i in range(20)]
    track += [(p[1] + d, p[2], p[3], m, 1.0) for p in points[-20:] for d, m in ((0.0, "b"), (2699.0, "a"))]
    t = spark.createDataFrame(track, "time double, lat double, lon double, satellite_id string, hs double")
    p = spark.createDataFrame(points, "id int, time double, lat double, lon double")
    rows = geo.radius_means(p, t, ["hs"], "id").collect()
    got = {r["id"]: (r["n"], r["satellite_id"], r["hs"]) for r in rows}
    want = {}
    for key in {x[0] for x in points}:
        near = [(x, r) for x in points if x[0] == key for r in track if abs(r[0] - x[1]) < 2700]
        hit = [r for x, r in near if km(x[2], x[3], r[1], r[2]) <= 50]
        if len(near) > 2 and len(hit) >= 2:
            names, values = [r[3] for r in hit if r[3]], [r[4] for r in hit if r[4] is not None]
            want[key] = (len(hit), min(set(names), key=lambda m: (-names.count(m), m)) if names else None, pytest.approx(np.mean(values)) if values else None)
    assert got == want and len(rows) == len(want) > 100 and sum(n == 2 for n, *_ in want.values()) > 20
    plain = {r["id"]: r["hs"] for r in geo.radius_means(p, t, ["hs"], "id", mission=None).collect()}
    assert plain == {k: v and pytest.approx(v) for k, (_, _, v) in got.items()}


def records_dealt(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_few_copies_are_dealt_to_find_the_commonest_mission(spark):
    """Records that the query writes to shuffles on the 0.01 tables, without broadcasts: less than twenty for each row, and no pairs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = records_dealt(spark)
        n = QUERIES["T2_commonest_mission"](spark, "/root/testdata/sf0.01").count()
        assert n == 10000 and 0 < records_dealt(spark) - before < 20 * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_gridding_weighs_the_rows_that_have_the_value(spark):
    tracks = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 3.0, None), (2, 1.0, 0.1, 0.0, 5.0, 4.0)], "src_id int, time double, lat double, lon double, hs double, hs_cal double")
    grid = spark.createDataFrame([(0, 0, 0.0, 0.0)], "lat_idx int, lon_idx int, lat double, lon double")
    r = geo.gridded(tracks, grid, ["hs", "hs_cal"]).first()
    assert r["hs_cal"] == pytest.approx(4.0) and r["n"] == 2 and 3 < r["hs"] < 5
    assert geo.gridded(tracks, grid, ["hs_cal", "hs"]).first()["hs_cal_nearest"] == 4.0


def test_final_segments(spark):
    rows = [("a", 0.0, 100.0, 60.0, h, 5.0) for h in (1.0, 2.0, 3.0, 25.0, 0.1, 20.0)] + [("a", 0.0, 79.0, 60.0, 1.0, 5.0), ("a", 0.0, 100.0, 49.0, 1.0, 5.0), ("a", 0.0, 100.0, 60.0, 1.0, 0.2), ("b", 0.0, 100.0, 60.0, 1.0, 5.0), ("b", 0.0, 100.0, 60.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "satellite_id string, time double, wdepth double, distcoast double, hs double, wnd double")
    assert [(r["satellite_id"], r["hs"]) for r in geo.along_track_final(df, ["satellite_id"]).collect()] == [("a", 1.0), ("a", 2.0), ("a", 3.0)]
    assert geo.along_track_final(df, ["satellite_id"], check=False).count() == 9
    assert geo.along_track_final(df, ["satellite_id"], time=(1.0, 2.0)).count() == 0


def test_checked_tiles_and_every_third_time(spark):
    cols = "mission string, time double, wdepth double, distcoast double, swh_std double, sig0_std double, n_obs int, qc double, swh double, swh_cal double, wspd double, wspd_cal double"
    good = ("JASON3", 5.0, 100.0, 60.0, 0.1, 0.1, 20, 1.0, 2.0, 2.0, 5.0, 5.0)
    bad = [(*good[:k], v, *good[k + 1 :]) for k, v in ((1, 99.0), (2, 79.0), (3, 49.0), (6, 16), (8, 0.1), (9, None), (10, 60.0))]
    of = lambda rows, **kw: tables.checked_tiles(spark.createDataFrame(rows, cols), 0.0, 10.0, **kw).count()
    assert of([good] * 3 + bad) == 3 and of([good] * 2 + bad) == 0 and of([good] * 2 + bad, only_time=True) == 8
    t = spark.createDataFrame([(None, i // 2) for i in range(20)] + [("s", 5), ("s", None)], "k string, time int")
    assert sorted(((r["k"] or ""), r["time"]) for r in qc.every_kth(t, 3, ["k"]).collect()) == [("", x) for x in (0, 0, 3, 3, 6, 6, 9, 9)] + [("s", 5)]


def test_codes_of_missing_values_that_are_values_elsewhere(spark, tmp_path):
    (tmp_path / "41001.txt").write_text("#YY MM DD hh mm WDIR WSPD GST WVHT MWD PRES ATMP\n2020 01 02 03 00 99 9.0 99.0 99.00 99 999.0 999.0\n2020 01 02 04 00 999 99.0 9.0 2.00 999 9999.0 9.9\n")
    a, b = texts.stdmet(spark, str(tmp_path / "41001.txt")).orderBy("time").collect()
    assert (a["wind_dir"], a["wind_spd"], a["gust"], a["hs"], a["dm"], a["mslp"], a["air_temp"]) == (99.0, 9.0, None, None, 99.0, 999.0, None)
    assert (b["wind_dir"], b["wind_spd"], b["gust"], b["hs"], b["dm"], b["mslp"], b["air_temp"]) == (None, None, 9.0, 2.0, None, None, 9.9)


def test_a_large_month_gets_several_files_and_another_month_stays(spark, tmp_path):
    path = str(tmp_path / "m")
    df = lambda n, day, run="r": spark.range(n).select(F.lit(run).alias("run_id"), (F.lit(day * 86400.0) + F.col("id") % 7).alias("valid_time"), (F.col("id") * 0.5).alias("model_hs"))
    sinks.write_matchups(df(5000, 10).unionByName(df(10, 45)), path, rows_per_file=1000)
    files = lambda month: [f for f in os.listdir(f"{path}/run_id=r/month_start={month}") if f.endswith(".parquet")]
    assert len(files("1970-01-01")) >= 5 and len(files("1970-02-01")) <= 2
    sinks.write_matchups(df(20, 46), path, rows_per_file=1000)
    got = {str(r["month_start"]): r["count"] for r in spark.read.parquet(path).groupBy("month_start").count().collect()}
    assert got == {"1970-01-01": 5000, "1970-02-01": 20}
