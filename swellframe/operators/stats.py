"""Summary statistics and error metrics. Sums are aggregated map-side, so groups of any size are safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored, with_their_group
from .order import percentiles, probability_weighted
from .windows import key_of, smoothed

METRICS = ("n", "bias", "rmse", "nbias", "nrmse", "scrmse", "si", "hh", "cc")
#: Percentiles of a summary, and of a quantile-quantile table (1 to 95, then denser).
SUMMARY_P = (0.8, 0.9, 0.95, 0.99, 0.999)
QQ_P = tuple(i / 100 for i in range(1, 96)) + tuple(round(95.5 + 0.3 * i, 1) / 100 for i in range(15))


def _root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def correlation(m: Column, o: Column) -> Column:
    """Pearson correlation of complete pairs; null where either is constant to rounding (the built-in one fails there)."""
    both = m.isNotNull() & o.isNotNull()
    a, b = F.when(both, m), F.when(both, o)
    return F.when((F.var_pop(a) > 1e-12) & (F.var_pop(b) > 1e-12), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def metric_columns(m: Column, o: Column) -> list[Column]:
    """A3. Aggregates of (model, observation) pairs: count, bias, RMSE and its relatives; null where undefined. Pairs that lack a side don't count."""
    both = m.isNotNull() & o.isNotNull()
    m, o = F.when(both, m), F.when(both, o)
    d = m - o
    bias, square = F.avg(m) - F.avg(o), F.avg(d * d)
    enough = F.count(d) >= 2
    out = {
        "n": F.count(d),
        "bias": bias,
        "rmse": F.sqrt(square),
        "nbias": F.try_divide(bias, F.abs(F.avg(o))),
        "nrmse": _root(F.try_divide(F.sum(d * d), F.sum(o * o))),
        "scrmse": _root(square - bias * bias),
        "si": _root(F.try_divide(F.count(d) * F.var_pop(d), F.sum(o * o))),
        "hh": _root(F.try_divide(F.sum(d * d), F.sum(m * o))),
        "cc": correlation(m, o),
    }
    return [c.alias(k) if k == "n" else F.when(enough, c).alias(k) for k, c in out.items()]


def metrics(pairs: DataFrame, keys: list[str], model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A3, A5, A7, A8, A10. Error metrics by group, of groups with two pairs at least."""
    both = pairs.where(F.col(model).isNotNull() & F.col(obs).isNotNull())
    return both.groupBy(*keys).agg(*metric_columns(F.col(model), F.col(obs))).where("n >= 2")


def metrics_by_strata(pairs: DataFrame, keys: list[str], model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A7. Metrics by each key on its own, in one pass: stratum, level, metrics."""
    sets = [[F.col(k)] for k in keys]
    level = F.coalesce(*[F.when(F.grouping(k) == 0, F.coalesce(F.col(k).cast("string"), F.lit("none"))) for k in keys])
    name = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    out = pairs.groupingSets(sets, *[F.col(k) for k in keys]).agg(*metric_columns(F.col(model), F.col(obs)), name.alias("stratum"), level.alias("level"))
    return out.where("n >= 2").select("stratum", "level", *METRICS)


def tail_errors(pairs: DataFrame, keys: list[str], q: float = 0.95, model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A4. Bias and RMSE where the observation exceeds its group's percentile, over pairs that have both sides."""
    m, o = F.col(model).cast("double"), F.col(obs).cast("double")
    good = pairs.where(m.isNotNull() & o.isNotNull()).select(key_of(keys).alias("_k"), *keys, m.alias("_m"), o.alias("_o"))
    top = percentiles(good, ["_k"], "_o", (q,)).select("_k", "n", F.col("q")[0].alias("bound"))
    d = F.col("_m") - F.col("_o")
    tail = with_their_group(good, stored(top, "bounds"), ["_k"]).where(F.col("_o") > F.col("bound"))
    return tail.groupBy(*keys, "bound").agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse")).where("n >= 2")


def summary(df: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """A1. Mean, variance, skewness, excess kurtosis, extremes and high percentiles of values strictly in (low, high)."""
    x = F.col("_x")
    more = [F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"), F.min(x).alias("least"), F.max(x).alias("most")]
    p = percentiles(df.where((F.col(value) > low) & (F.col(value) < high)), keys, value, SUMMARY_P, more)
    names = ["p80", "p90", "p95", "p99", "p999"]
    return p.select("*", *[F.col("q")[i].alias(n) for i, n in enumerate(names)]).drop("q")


def l_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A2. L-CV, L-skewness and L-kurtosis of groups with four values at least."""
    b = [F.col(f"b{k}") for k in range(4)]
    l2, l3, l4 = 2 * b[1] - b[0], 6 * b[2] - 6 * b[1] + b[0], 20 * b[3] - 30 * b[2] + 12 * b[1] - b[0]
    own = probability_weighted(df, keys, value).where("n >= 4")
    return own.select(*keys, F.col("n").cast("double").alias("n"), F.try_divide(l2, b[0]).alias("l_cv"), F.try_divide(l3, l2).alias("l_skewness"), F.try_divide(l4, l2).alias("l_kurtosis"))


def taylor(pairs: DataFrame, keys: list[str], model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A9. Standard deviations, centred RMS difference and correlation of pairs that have both sides."""
    m, o = F.col(model), F.col(obs)
    return pairs.where(m.isNotNull() & o.isNotNull()).groupBy(*keys).agg(F.stddev_pop(o).alias("sd_obs"), F.stddev_pop(m).alias("sd_model"), F.stddev_pop(m - o).alias("crmsd"), correlation(m, o).alias("cc"))


def quantiles(long: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = QQ_P, accuracy: int | None = None) -> DataFrame:
    """A11. Percentiles as rows (p, q): exact, or approximate with a bounded sketch."""
    if accuracy:
        p = long.groupBy(*keys).agg(F.percentile_approx(value, list(at), accuracy).alias("v"))
    else:
        p = percentiles(long, keys, value, at).withColumnRenamed("q", "v")
    return p.select(*keys, F.posexplode("v").alias("i", "q")).withColumn("p", F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1)).select(*keys, "p", "q")


def regression(pairs: DataFrame, keys: list[str], model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A12. Slope and intercept of the model on the observation; null where the observation is constant."""
    m, o = F.col(model), F.col(obs)
    slope = F.try_divide(F.covar_pop(m, o), F.var_pop(o))
    return pairs.where(m.isNotNull() & o.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), slope.alias("slope"), (F.avg(m) - slope * F.avg(o)).alias("intercept"))


def qq_curve(long: DataFrame, keys: list[str], value: str, at: tuple[float, ...] = QQ_P, sigma: float = 1.0) -> DataFrame:
    """A11. The percentiles as the curve is drawn: smoothed along the probabilities: keys, p, q."""
    place = F.array_position(F.array(*map(F.lit, at)), F.col("p")) - 1
    q = quantiles(long, keys, value, at).withColumn("i", place)
    return smoothed(q, keys, "i", "q", sigma, carried=("p",)).select(*keys, "p", F.col("smooth").alias("q"))


def density_2d(pairs: DataFrame, low: float, high: float, bins: int, model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A14. Counts of pairs by square bin."""
    at = lambda c: F.floor((F.col(c) - low) / ((high - low) / bins)).cast("int")
    inside = F.col(model).between(low, high) & F.col(obs).between(low, high)
    return pairs.where(inside).groupBy(at(obs).alias("i"), at(model).alias("j")).agg(F.count("*").alias("n"))


def lead_metrics(pairs: DataFrame, bins: DataFrame, lead: str = "lead_h", model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A6. Metrics by lead interval, both ends included (a lead on an edge counts in both). bins: bin, lo, hi, a small table.

    Leads are few: each distinct one finds its intervals, and pairs join those by their lead.
    """
    of = pairs.select(lead).distinct().join(bins, F.col(lead).between(F.col("lo"), F.col("hi"))).select(lead, "bin")
    return metrics(pairs.join(of, lead), ["bin"], model, obs).select("bin", "n", "bias", "rmse", "si", "cc")


def completeness(df: DataFrame, station: str, lat: str, model: str, obs: str) -> DataFrame:
    """A21. Stations with a known position and at least one valid model and observed value; pairs with both above zero."""
    t = df.groupBy(station).agg(F.max(F.col(lat).isNotNull()).alias("placed"), F.count(model).alias("n_model"), F.count(obs).alias("n_obs"), F.count_if((F.col(model) > 0) & (F.col(obs) > 0)).alias("n_pairs"))
    return t.where("placed and n_model > 0 and n_obs > 0").drop("placed")


def field_summary(field: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A22. Largest, mean and colour-level percentiles of a field by step."""
    p = percentiles(field, keys, value, (0.99, 0.999, 0.99995), [F.max("_x").alias("most"), F.avg("_x").alias("mean")])
    return p.select(*keys, "most", "mean", *[F.col("q")[i].alias(n) for i, n in enumerate(("p99", "p999", "p99995"))])


def colour_level(error_map: DataFrame, values: list[str], q: float = 0.99, keys: list[str] | None = None) -> DataFrame:
    """A8. The level of a map's colours for each value: a high percentile of its absolute cells; null where a value has none."""
    keys = keys or []
    levels = [percentiles(error_map.withColumn(v, F.abs(v)), keys, v, (q,)).select(key_of(keys).alias("_k"), F.col("q")[0].alias(v)) for v in values]
    both = reduce(lambda a, b: a.join(b, "_k", "full"), levels)
    return both.select(*[F.col(f"_k.{k}") for k in keys], *values)


def longest_run(extent: DataFrame) -> DataFrame:
    """A23. The most times that any input has; what a table of all inputs must hold."""
    return extent.agg(F.max("times").alias("longest"))


def time_extent(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """A23. First and last time and the number of distinct times of each input."""
    return df.groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.countDistinct(time).alias("times"))
