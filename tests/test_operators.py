"""Operators on small hand-made frames: boundaries, ties, brute force and closed loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellframe.functions import columns as c
from swellframe.functions import spectra as sp
from swellframe.operators import ensemble, geo, interp, qc, stats, timejoin, windows, zones


def test_metrics_formulas_and_minimum(spark):
    rng = np.random.default_rng(1)
    o = rng.uniform(1, 5, 50)
    m = o + rng.normal(0.1, 0.3, 50)
    rows = [("a", float(x), float(y)) for x, y in zip(m, o)] + [("one", 1.0, 1.0), ("zero", 1.0, 0.0), ("zero", 2.0, 0.0), ("null", None, 1.0)]
    got = {r["g"]: r for r in stats.metrics(spark.createDataFrame(rows, "g string, model_hs double, obs_hs double"), ["g"]).collect()}
    d = m - o
    r = got["a"]
    want = {
        "bias": m.mean() - o.mean(), "rmse": math.sqrt((d**2).mean()), "nbias": (m.mean() - o.mean()) / abs(o.mean()), "nrmse": math.sqrt((d**2).sum() / (o**2).sum()),
        "scrmse": math.sqrt((d**2).mean() - d.mean() ** 2), "si": math.sqrt(((d - d.mean()) ** 2).sum() / (o**2).sum()), "hh": math.sqrt((d**2).sum() / (m * o).sum()), "cc": np.corrcoef(m, o)[0, 1],
    }
    assert all(r[k] == pytest.approx(v) for k, v in want.items())
    assert set(got) == {"a", "zero"} and got["zero"]["nbias"] is None and got["zero"]["si"] is None


def test_pair_qc_edges(spark):
    rows = [(0.0, 1.0), (1.0, 20.0), (1.0, 4.0), (1.0, 4.01), (2.0, 2.0), (None, 1.0)]
    got = qc.pairs_qc(spark.createDataFrame(rows, "model_hs double, obs_hs double"), 0.0, 20.0, 3.0).collect()
    assert [tuple(r) for r in got] == [(1.0, 4.0), (2.0, 2.0)]
    got = qc.ranged(spark.createDataFrame([(0.0,), (30.0,), (-0.01,), (30.01,), (float("nan"),)], "hs double")).collect()
    assert [r["hs"] for r in got] == [0.0, 30.0, None, None, None]


def test_lead_on_edge_counts_twice(spark):
    p = spark.createDataFrame([(24.0, 1.0, 1.5), (24.0, 2.0, 2.0), (30.0, 3.0, 3.0)], "lead_h double, model_hs double, obs_hs double")
    bins = spark.createDataFrame([("a", 0.0, 24.0), ("b", 24.0, 72.0)], "bin string, lo double, hi double")
    assert {r["bin"]: r["n"] for r in stats.lead_metrics(p, bins).collect()} == {"a": 2, "b": 3}


def test_l_moments_with_ties(spark):
    x = [1.0, 1.0, 2.0, 3.5, 3.5, 3.5, 7.0]
    r = stats.l_moments(spark.createDataFrame([("g", v) for v in x], "g string, x double"), ["g"], "x").first()
    n, s = len(x), sorted(x)
    b = [sum(math.comb(i, k) * v for i, v in enumerate(s)) / (n * math.comb(n - 1, k)) for k in range(4)]
    l2, l3, l4 = 2 * b[1] - b[0], 6 * b[2] - 6 * b[1] + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]
    assert (r["l_cv"], r["l_skewness"], r["l_kurtosis"]) == pytest.approx((l2 / b[0], l3 / l2, l4 / l2))


def test_window_average_is_strict_and_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    obs = [(int(s), float(t), float(v)) for s, t, v in zip(rng.integers(0, 3, 300), rng.integers(0, 40000, 300), rng.random(300))] + [(0, 1800.0, 5.0), (0, 5400.0, 7.0)]
    steps = [(s, h * 3600) for s in range(3) for h in range(12)] * 2
    o, m = spark.createDataFrame(obs, "station int, time double, hs double"), spark.createDataFrame(steps, "station int, valid_time long")
    got = {(r["station"], r["valid_time"]): (r["hs"], r["n"]) for r in timejoin.window_average(m, o, ["station"], ["hs"]).collect()}
    want = {}
    for s, t in set(steps):
        v = [x for a, b, x in obs if a == s and abs(b - t) < 1800]
        if v:
            want[s, t] = (pytest.approx(np.mean(v)), len(v))
    assert got == want


def test_slot_lookup_limits(spark):
    rows = spark.createDataFrame([(1, 5400.0), (2, 5400.1), (3, 16200.0)], "id int, time double").withColumn("cell", F.lit(1))
    table = spark.createDataFrame([(0, 1, 7), (10800, 1, 8)], "time long, cell int, code int")
    of = lambda strict: {r["id"]: r["code"] for r in timejoin.slot_lookup(rows, table, ["cell"], 5400.0, 10800.0, strict).collect()}
    assert of(False) == {1: 7, 2: 8, 3: 8} and of(True) == {1: None, 2: 8, 3: None}


def test_gap_filling(spark):
    x = [None, 1.0, None, None, None, None, 6.0, None, None, None, None, None]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "s string, t int, x double")
    got = [r["x"] for r in windows.filled(df, ["s"], "t", "x", 3).orderBy("t").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, 6.0, 6.0, 6.0, 6.0, None, None]


def test_smoothing_reflects(spark):
    x = [1.0, 5.0, 2.0]
    w = windows.gaussian_weights()
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "s string, i int, v double")
    got = [r["smooth"] for r in windows.smoothed(df, ["s"], "i", "v").orderBy("i").collect()]
    wide = (x + x[::-1]) * 5
    assert got == pytest.approx([sum(w[k + 4] * wide[(i + k) % 6] for k in range(-4, 5)) for i in range(3)])


def test_radius_extraction_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    track = [(i, float(t), float(la), float(lo), float(v), int(m)) for i, (t, la, lo, v, m) in enumerate(zip(rng.uniform(0, 20000, 400), rng.uniform(-1, 1, 400), rng.uniform(-1, 1, 400) % 360, rng.random(400), rng.integers(0, 3, 400)))]
    pts = [(i, float(t), float(la), float(lo)) for i, (t, la, lo) in enumerate(zip(rng.uniform(0, 20000, 40), rng.uniform(-1, 1, 40), rng.uniform(-1, 1, 40)))]
    t = spark.createDataFrame(track, "src_id int, time double, lat double, lon double, hs double, satellite_id int")
    p = spark.createDataFrame(pts, "point int, time double, lat double, lon double")
    got = {r["point"]: (r["n"], r["hs"]) for r in geo.radius_extraction(p, t, ["hs"], "point").collect()}

    def km(a, b, x, y):
        a, b, x, y = map(math.radians, (a, b, x, y))
        return 2 * 6371 * math.asin(math.sqrt(math.sin((x - a) / 2) ** 2 + math.cos(a) * math.cos(x) * math.sin((y - b) / 2) ** 2))

    for i, tm, la, lo in pts:
        near = [r for r in track if abs(r[1] - tm) < 2700]
        hit = [r[4] for r in near if km(la, lo, r[2], r[3]) <= 50]
        want = (len(hit), pytest.approx(np.mean(hit))) if len(near) > 2 and len(hit) >= 2 else (None, None)
        assert got[i] == want


def test_trilinear_is_exact_on_linear_fields(spark):
    f = spark.createDataFrame([(t, i, j, 2.0 + i + 3 * j + 0.5 * t) for t in range(3) for i in range(4) for j in range(5) if (i, j) != (3, 4)], "t_idx int, lat_idx int, lon_idx int, v double")
    rows = spark.createDataFrame([(1, 1.5, 2.25, 30.0), (2, 3.0, 0.0, 0.0), (3, 3.5, 1.0, 0.0), (4, 2.5, 3.5, 10.0), (5, 1.0, 1.0, 61.0)], "id int, lat double, lon double, time double")
    got = {r["id"]: r["v"] for r in interp.trilinear(rows, f, ["v"], "id", 0.0, 1.0, 4, 0.0, 1.0, 5, 0.0, 30.0, 3).collect()}
    assert got[1] == pytest.approx(2 + 1.5 + 6.75 + 0.5) and got[2] == pytest.approx(5.0) and got[3] is None and got[4] is None and got[5] is None


def test_nearest_index_ties_and_wrap(spark):
    df = spark.createDataFrame([(0.5, 359.5), (0.51, 359.4), (-5.0, 0.2)], "lat double, lon double")
    got = geo.nearest_cell(df, 0.0, 1.0, 3, 0.0, 1.0, 360).collect()
    assert [(r["lat_idx"], r["lon_idx"]) for r in got] == [(0, 359), (1, 359), (0, 0)]


def test_zones_last_polygon_wins(spark):
    ring = lambda *p: [{"lon": float(a), "lat": float(b)} for a, b in p]
    polygons = spark.createDataFrame([(1, 1, ring((0, 0), (20, 0), (20, 20), (0, 20))), (2, 2, ring((10, 10), (30, 10), (10, 30)))], "zone_id int, zone_order int, ring array<struct<lon: double, lat: double>>")
    cells = spark.createDataFrame([(1, 5.0, 5.0), (2, 12.0, 12.0), (3, 29.0, 29.0), (4, 25.0, 11.0)], "id int, lat double, lon double")
    assert {r["id"]: r["zone_id"] for r in zones.tagged(cells, polygons, "id").collect()} == {1: 1, 2: 2, 3: 0, 4: 2}


def test_storm_footprint_radius_and_last_row(spark):
    s = spark.createDataFrame([(1, 0.0, "TS", 0.0, 0.0), (2, 100.0, "ET", 0.0, 2.0)], "row_no long, time double, nature string, lat double, lon double")
    got = {(r["slot"], r["lat_idx"], r["lon_idx"]): r["code"] for r in geo.storm_footprints(s, -90.0, 1.0, 181, 0.0, 1.0, 360).collect()}
    assert got[0, 90, 356] == 5 and got[0, 90, 1] == 3 and (0, 90, 355) not in got and (0, 90, 7) not in got and {k[0] for k in got} == {0}


def test_ensemble_scores(spark):
    rng = np.random.default_rng(3)
    m = rng.random((20, 6))
    y = rng.random(20)
    df = spark.createDataFrame([(i, [float(x) for x in a], float(b)) for i, (a, b) in enumerate(zip(m, y))], "id int, m array<double>, y double")
    got = df.select(ensemble.crps(F.col("m"), F.col("y")).alias("c"), ensemble.spread(F.col("m")).alias("s"), ensemble.brier(F.col("m"), F.col("y"), 0.5).alias("b")).collect()
    for r, a, b in zip(got, m, y):
        assert r["c"] == pytest.approx(np.abs(a - b).mean() - np.abs(a[:, None] - a).mean() / 2)
        assert r["s"] == pytest.approx(a.std(ddof=1)) and r["b"] == pytest.approx(((a >= 0.5) != (b >= 0.5)).mean())
    h = ensemble.rank_histogram(spark.createDataFrame([(1, [1.0] * 3, 1.0), (2, [0.0, 1.0, 2.0], 0.5)], "id int, m array<double>, y double"), "m", "y", ["id"], 3).collect()
    assert len(h) == 4 and sum(r["n"] for r in h) == 2


def test_jonswap_keeps_height_and_flip_is_an_involution(spark):
    df = spark.createDataFrame([(2.0, 9.0, 40.0)], "hs double, tp double, d double")
    freq, dirs = F.array(*[F.lit(0.04 + 0.005 * i) for i in range(80)]), F.array(*[F.lit(float(i)) for i in range(0, 360, 10)])
    e = df.select("hs", freq.alias("f"), dirs.alias("th"), sp.jonswap(F.col("hs"), F.col("tp"), F.col("d"), freq, dirs).alias("e"))
    r = e.select(sp.bulk_height(F.col("f"), F.col("th"), F.col("e")).alias("h"), sp.bulk_direction(F.col("f"), F.col("th"), F.col("e")).alias("dir"), sp.peak_frequency(F.col("f"), F.transform("e", sp.total)).alias("fp")).first()
    assert r["h"] == pytest.approx(2.0 * 4.004 / 4, rel=1e-6) and r["dir"] == pytest.approx(220.0, abs=0.1) and r["fp"] == pytest.approx(1 / 9, abs=0.005)
    twice = e.select(sp.flipped(F.col("th"), F.col("e")[20]).alias("z"), "th", "e").select(sp.flipped(F.transform("z", lambda x: x.d), F.transform("z", lambda x: x.v)).alias("z"), F.col("e")[20].alias("row")).first()
    assert [x["v"] for x in twice["z"]] == pytest.approx(twice["row"])


def test_distances(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (50.0, 10.0, 50.5, 10.5), (1.0, 1.0, 1.0, 1.0), (0.0, 359.9, 0.0, 0.1)], "a double, b double, x double, y double")
    got = df.select(c.great_circle_km(*[F.col(k) for k in "abxy"]).alias("s"), c.ellipsoid_km(*[F.col(k) for k in "abxy"]).alias("e")).collect()
    assert got[0]["e"] == pytest.approx(111.3195, abs=1e-3) and got[1]["e"] == pytest.approx(got[1]["s"], rel=0.006) and got[2]["e"] == 0 and got[3]["s"] == pytest.approx(22.239, abs=1e-3)


def test_parts_of_a_series_agree_with_the_whole(spark):
    """Gaps and roll-overs across parts, parts without a value, series that begin or end with gaps."""
    import random

    from swellframe.operators import windows

    r = random.Random(5)
    rows = [(k, i * 7, None if r.random() < 0.6 or 20 <= i < 60 else r.random(), r.randint(1, 28)) for k in (1, 2, None) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, t bigint, x double, day int").repartition(3)
    for limit in (None, 3):
        whole = sorted(windows.filled(df, ["k"], "t", "x", limit).collect(), key=str)
        assert len(whole) == len(rows) and whole == sorted(windows.filled(df, ["k"], "t", "x", limit, 50).collect(), key=str)
    whole = sorted(windows.rolled_months(df, ["k"], "t", "day").collect(), key=str)
    assert len(whole) == len(rows) and whole == sorted(windows.rolled_months(df, ["k"], "t", "day", 33).collect(), key=str)


def test_as_of_far_back_and_answers_by_keys(spark):
    from swellframe.operators import timejoin

    rows = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("a", 900000.0), ("b", 1.0), (None, 3.0)], "k string, time double")
    steps = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", 7.0)], "k string, step_time double")
    got = timejoin.as_of(rows, steps, ["k"], width=10.0).collect()
    assert sorted((x["k"], x["time"], x["step_time"]) for x in got if x["step_time"]) == [("a", 5.0, 3.0), ("a", 5.0, 3.0), ("a", 900000.0, 3.0)] and len(got) == 5
    table = spark.createDataFrame([("a", 6.0, 1), ("a", 4.0, 2), ("b", 50.0, 3)], "k string, time double, v int")
    near = timejoin.nearest_in_time(rows, table, ["k"], ["v"], 2.0)
    assert sorted((x["k"] or "", x["time"], x["v"] or 0) for x in near.collect()) == [("", 3.0, 0), ("a", 5.0, 2), ("a", 5.0, 2), ("a", 900000.0, 0), ("b", 1.0, 0)]
    model = spark.createDataFrame([(100000,), (200000,)], "valid_time bigint")
    seen = spark.createDataFrame([(1.0,), (95000.0,), (210000.0,), (220000.0,)], "time double")
    assert [x["time"] for x in timejoin.within_extent(seen, model).orderBy("time").collect()] == [95000.0, 210000.0]
    assert timejoin.within_extent(seen, model.limit(0)).count() == 0


def test_csv_at_any_size(spark, tmp_path):
    from swellframe.sources import sinks

    df = spark.range(10).selectExpr("id", "id / 7 as hs")
    assert sinks.write_altimeter_csv(df, str(tmp_path / "a")) and spark.read.csv(str(tmp_path / "a"), header=True).count() == 10
    assert not sinks.write_altimeter_csv(df, str(tmp_path / "b"), most_rows=10) and not (tmp_path / "b").exists()
