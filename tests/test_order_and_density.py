"""Order statistics and densities: against NumPy, with narrowing that a low limit forces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from swellframe.operators import density, order, stats, windows


def test_percentiles_of_groups_of_any_shape(spark):
    """Continuous, lognormal with a far tail, few distinct values, constant, single, infinite and missing ones; null keys."""
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(-1, 1, 5000), "tail": np.exp(rng.normal(0, 6, 5000)), "few": rng.integers(0, 3, 4000) * 1.5, "constant": np.full(700, 2.5), "one": np.array([7.0]),
        "huge": np.clip(rng.normal(0, 1, 300), -3, 3) * 0.2e308, None: rng.normal(0, 1, 3000),
    }
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = (0.0, 0.01, 0.5, 0.95, 0.999, 1.0)
    got = {r["g"]: r for r in order.percentiles(df, ["g"], "x", at, [F.avg("_x").alias("mean")], limit=100).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert got[k]["n"] == len(xs) and got[k]["q"] == pytest.approx([float(np.quantile(xs, p)) for p in at], rel=1e-12), k
        assert k == "huge" or got[k]["mean"] == pytest.approx(xs.mean())
    whole = order.percentiles(df.where("g = 'few'"), [], "x", (0.5,)).first()
    assert whole["q"] == [np.quantile(groups["few"], 0.5)]


def test_narrowing_sorts_few_values(spark):
    """Only the values of bins that hold a wanted rank are sorted, at most the limit in a bin."""
    df = spark.range(100_000).select(F.lit(1).alias("_k"), (F.pmod(F.col("id") * 7919, F.lit(100_003)) * 1.0).alias("_x"))
    bins = order._groups(df, []).withColumn("want", F.array(F.lit(0), F.lit(50_000)).cast("array<bigint>"))
    ended, values = order.narrowed(df, order.stored(bins, "t"), 500)
    sizes = [r["n"] for r in values.groupBy("_path").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 2 and max(sizes) <= 500 and ended.count() == 2


@pytest.mark.parametrize("limit", [None, 60])
def test_l_moments_by_bins(spark, limit):
    rng = np.random.default_rng(2)
    groups = {"a": np.exp(rng.normal(0, 2, 3000)), "b": rng.integers(0, 5, 1000) * 1.0, None: rng.normal(5, 1, 80)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs], "g string, x double").repartition(4)
    got = {r["g"]: r for r in order.probability_weighted(df, ["g"], "x", limit).collect()}
    for k, xs in groups.items():
        n, s = len(xs), np.sort(xs)
        for j in range(4):
            want = sum(math.comb(i, j) * v for i, v in enumerate(s)) / (n * math.comb(n - 1, j))
            assert got[k][f"b{j}"] == pytest.approx(want, rel=1e-9)
    few = stats.l_moments(spark.createDataFrame([("x", float(i)) for i in range(3)], "g string, x double"), ["g"], "x")
    assert few.collect() == []


PAIRS = [(1.0, 2.0), (2.0, 3.0), (3.0, 4.0), (None, 100.0)]


def test_pairs_that_lack_a_side_count_nowhere(spark):
    df = spark.createDataFrame([(*p, "g", 1) for p in PAIRS], "model_hs double, obs_hs double, g string, k int")
    assert stats.metrics(df, ["g"]).first()["bias"] == -1.0
    r = stats.metrics_by_strata(df, ["g", "k"]).collect()
    assert len(r) == 2 and all(x["n"] == 3 and x["bias"] == -1.0 for x in r)
    t = stats.taylor(df, ["g"]).first()
    assert t["sd_obs"] == pytest.approx(np.std([2, 3, 4])) and t["sd_model"] == pytest.approx(np.std([1, 2, 3])) and t["crmsd"] == 0
    rows = [(float(i), float(i) - 1, "g") for i in range(100)] + [(None, 1000.0 + i, "g") for i in range(20)]
    t = stats.tail_errors(spark.createDataFrame(rows, "model_hs double, obs_hs double, g string"), ["g"]).first()
    assert t["bound"] == pytest.approx(np.quantile([i - 1.0 for i in range(100)], 0.95)) and t["n"] == 5 and t["bias"] == 1.0


def direct_density(x, v, h):
    return np.exp(-(((x[:, None] - v[None]) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))


def test_curves_are_near_the_direct_sum(spark):
    rng = np.random.default_rng(3)
    series = {("a", "obs"): rng.gamma(2, 1, 4000), ("a", "model"): rng.gamma(2, 1.1, 50), ("b", "obs"): rng.normal(50, 0.1, 300), ("b", "flat"): np.full(9, 50.0)}
    df = spark.createDataFrame([(*k, float(x)) for k, xs in series.items() for x in xs], "g string, series string, x double").repartition(3)
    got = {}
    for r in density.density(df, ["g"], "series", "x", sigma=1e-3).collect():  # without smoothing
        got.setdefault((r["g"], r["series"]), []).append((r["i"], r["x"], r["density"]))
    assert set(got) == set(series) - {("b", "flat")}
    for k, rows in got.items():
        _, x, d = map(np.array, zip(*sorted(rows), strict=True))
        v = series[k]
        own = [w for (g, _), w in series.items() if g == k[0]]
        assert len(x) == 100 and x[0] == min(map(min, own)) and x[-1] == pytest.approx(0.99 * max(map(max, own)))
        want = direct_density(x, v, len(v) ** -0.2 * v.std(ddof=1))
        assert np.abs(d - want).max() < 1e-3 * max(want.max(), 1)


def test_curves_are_the_direct_sum(spark):
    """Every value at every point, unbinned and however far away; repeated values, a null, no groups, no rows."""
    rng = np.random.default_rng(6)
    series = {"obs": np.r_[rng.gamma(2, 1, 700), np.full(40, 1.5), 60.0], "model": rng.normal(3, 0.02, 900)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in series.items() for x in xs] + [("obs", None)], "series string, x double").repartition(3)
    got = density.density(df, [], "series", "x", sigma=1e-3).collect()
    assert len(got) == 200
    for k, v in series.items():
        rows = sorted((r["i"], r["x"], r["density"]) for r in got if r["series"] == k)
        _, x, d = map(np.array, zip(*rows, strict=True))
        want = direct_density(x, v, len(v) ** -0.2 * v.std(ddof=1))
        np.testing.assert_allclose(d, want, rtol=1e-9, atol=1e-300)
    assert density.density(df.limit(0), [], "series", "x").count() == 0


def test_density_at_pairs_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    o = rng.gamma(3, 1, 3000)
    m = 0.9 * o + rng.normal(0, 0.3, 3000)
    rows = [(i, float(a), float(b), 5) for i, (a, b) in enumerate(zip(m, o, strict=True))] + [(9998, None, 1.0, 5), (9999, 1.0, None, 5)]
    df = spark.createDataFrame(rows, "id int, model_hs double, obs_hs double, n int").repartition(4)
    got = {r["id"]: r["density"] for r in density.pair_density(df, ["id", "n"]).collect()}
    assert set(got) == set(range(3000))
    h = np.cov(m, o) * 3000 ** (-1 / 3)
    x = np.stack([m, o])
    diff = x[:, :, None] - x[:, None]
    q = np.einsum("iab,ij,jab->ab", diff, np.linalg.inv(h), diff)
    want = np.exp(-q / 2).sum(axis=1) / (3000 * 2 * np.pi * np.sqrt(np.linalg.det(h)))
    assert np.abs(np.array([got[i] for i in range(3000)]) - want).max() < 1e-3 * want.max()
    line = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(9)], "id int, model_hs double, obs_hs double")
    assert density.pair_density(line, ["id"]).collect() == [] and density.pair_density(df.limit(0), ["id"]).collect() == []


@pytest.mark.parametrize(("n", "block"), [(3, 8), (7, 8), (8, 8), (9, 8), (40, 8), (41, 16)])
def test_smoothing_in_blocks(spark, n, block):
    """Blocks with halos give what the whole series gives; short series are mirrored again."""
    rng = np.random.default_rng(n)
    x = rng.random(n)
    w = windows.gaussian_weights()
    mirror = np.concatenate([x, x[::-1]])
    want = [sum(w[k + 4] * mirror[(i + k) % (2 * n)] for k in range(-4, 5)) for i in range(n)]
    df = spark.createDataFrame([(None, i, float(v), str(i)) for i, v in enumerate(x)] + [("b", 0, 5.0, "x")], "s string, i int, v double, c string").repartition(3)
    got = windows.smoothed_columns(df, ["s"], "i", {"a": ("v", 1.0), "b": ("v", 0.5)}, ("c",), block=block).orderBy("i").collect()
    own = [r for r in got if r["s"] is None]
    assert [r["a"] for r in own] == pytest.approx(want) and [r["c"] for r in own] == [str(i) for i in range(n)]
    assert [r["a"] for r in got if r["s"] == "b"] == pytest.approx([5.0])


def test_smoothing_takes_an_exchange_for_each_axis(spark):
    df = spark.createDataFrame([(0, i, j, float(i * j)) for i in range(6) for j in range(7)], "run int, i int, j int, v double")
    out = windows.smoothed_2d(df, ["run"], "i", "j", "v")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    v = np.array([[i * j for j in range(7)] for i in range(6)], float)

    def along(a, sigma):
        w, n = windows.gaussian_weights(sigma), len(a)
        m = np.concatenate([a, a[::-1]])
        return np.array([sum(w[k] * m[(i + k - len(w) // 2) % (2 * n)] for k in range(len(w))) for i in range(n)])

    both = [along(along(v, s).T, s).T for s in (1.0, 0.5)]
    for r in out.collect():
        assert r["smooth"] == pytest.approx((v[r["i"], r["j"]] + both[0][r["i"], r["j"]] + both[1][r["i"], r["j"]]) / 3)
