"""Queries of the statistics operators (A, F7, F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, ensemble, qc, stats, windows
from . import views as v
from .registry import query, rounded

KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
QC = (0.0, 20.0, 3.0)
QC_SQL = "model_hs > 0 and model_hs < 20 and obs_hs > 0 and obs_hs < 20 and abs(model_hs - obs_hs) <= 3"


def checked(spark, sf_dir):
    return qc.pairs_qc(v.pairs(spark, sf_dir), *QC)


def metric_sql(m: str = "model_hs", o: str = "obs_hs") -> str:
    d = f"({m} - {o})"
    square, bias = f"avg({d} * {d})", f"(avg({m}) - avg({o}))"
    return (
        f"count(*) n, round({bias}, 6) + 0.0 bias, round(sqrt({square}), 6) rmse, round({bias} / nullif(abs(avg({o})), 0), 6) + 0.0 nbias, round(sqrt(sum({d} * {d}) / nullif(sum({o} * {o}), 0)), 6) nrmse, "
        f"round(case when {square} >= {bias} * {bias} then sqrt(greatest({square} - {bias} * {bias}, 0)) end, 6) scrmse, round(sqrt(count(*) * var_pop({d}) / nullif(sum({o} * {o}), 0)), 6) si, "
        f"round(sqrt(sum({d} * {d}) / nullif(sum({m} * {o}), 0)), 6) hh, case when var_pop({m}) > 1e-12 and var_pop({o}) > 1e-12 then round(corr({m}, {o}), 6) end cc"
    )


def _metrics(keys: str, source: str, m: str = "model_hs", o: str = "obs_hs") -> str:
    return f"select {keys}, {metric_sql(m, o)} from {source} group by {keys} having count(*) >= 2"


_PAIRS = v.with_views("pairs")
_OK = _PAIRS + f", ok as (select * from pairs where {QC_SQL}) "


#: Some pairs lack the model, some the observation.
_GAPS = _PAIRS + """, gaps as (select * exclude (model_hs, obs_hs), case when l_partkey % 13 <> 0 then model_hs end model_hs, case when l_orderkey % 7 <> 0 then obs_hs end obs_hs from pairs),
full_pairs as (select * from gaps where model_hs is not null and obs_hs is not null) """


def gappy(spark, sf_dir):
    p = v.pairs(spark, sf_dir)
    return p.withColumns({"model_hs": F.when(F.col("l_partkey") % 13 != 0, F.col("model_hs")), "obs_hs": F.when(F.col("l_orderkey") % 7 != 0, F.col("obs_hs"))})


@query(_OK + _metrics("month", "ok"))
def A3_error_metrics(spark, sf_dir):
    return rounded(stats.metrics(checked(spark, sf_dir), ["month"]))


_X = "(select zone, obs_hs x from pairs where obs_hs > 0.3 and obs_hs < 9.9)"
_M2 = "(avg(x * x) - avg(x) * avg(x))"


@query(
    _PAIRS + "select zone, count(x) n, round(avg(x), 6) mean, round(var_pop(x), 6) variance, "
    f"round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * avg(x) ** 3) / pow({_M2}, 1.5), 4) skewness, round(kurtosis_pop(x), 4) kurtosis, round(min(x), 6) least, round(max(x), 6) most, "
    + ", ".join(f"round(quantile_cont(x, {p}), 6) {n}" for p, n in ((0.8, "p80"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999")))
    + f" from {_X} group by zone"
)
def A1_summary(spark, sf_dir):
    return rounded(stats.summary(v.pairs(spark, sf_dir), ["zone"], "obs_hs", 0.3, 9.9), skewness=4, kurtosis=4)


@query(
    _PAIRS + """, r as (select zone, obs_hs x, row_number() over (partition by zone order by obs_hs)::double i, count(*) over (partition by zone)::double n from pairs),
b as (select zone, max(n) n, avg(x) b0, sum(x * (i - 1)) / max(n * (n - 1)) b1, sum(x * (i - 1) * (i - 2)) / max(n * (n - 1) * (n - 2)) b2, sum(x * (i - 1) * (i - 2) * (i - 3)) / max(n * (n - 1) * (n - 2) * (n - 3)) b3 from r group by zone)
select zone, n, round((2 * b1 - b0) / b0, 5) l_cv, round((6 * b2 - 6 * b1 + b0) / (2 * b1 - b0), 5) l_skewness, round((20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0), 5) l_kurtosis from b where n >= 4"""
)
def A2_l_moments(spark, sf_dir):
    return rounded(stats.l_moments(v.pairs(spark, sf_dir), ["zone"], "obs_hs"), 5)


@query(
    _GAPS + """, q as (select month, quantile_cont(obs_hs, 0.95) b from full_pairs group by month)
select month, round(b, 6) bound, count(*) n, round(avg(model_hs - obs_hs), 6) bias, round(sqrt(avg((model_hs - obs_hs) ** 2)), 6) rmse from full_pairs join q using (month) where obs_hs > b group by month, b having count(*) >= 2"""
)
def A4_tail_errors(spark, sf_dir):
    return rounded(stats.tail_errors(gappy(spark, sf_dir), ["month"]))


def _models(spark, sf_dir):
    """Two models in long form; the second lacks values here and there."""
    p = v.pairs(spark, sf_dir)
    both = F.array(F.struct(F.lit("a").alias("model"), F.col("model_hs").alias("x")), F.struct(F.lit("b").alias("model"), F.when(F.col("l_partkey") % 13 != 0, F.col("obs_hs") * 1.05).alias("x")))
    return p.select(*KEYS, "month", "obs_hs", F.inline(both))


_MODELS = _PAIRS + """, long as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, month, obs_hs, 'a' model, model_hs x from pairs union all select l_orderkey, l_partkey, l_suppkey, l_linenumber, month, obs_hs, 'b', case when l_partkey % 13 <> 0 then obs_hs * 1.05::double end from pairs),
cc as (select * from long semi join (select l_orderkey, l_partkey, l_suppkey, l_linenumber from long where x is not null group by all having count(*) = 2) k using (l_orderkey, l_partkey, l_suppkey, l_linenumber)) """


@query(_MODELS + _metrics("month, model", "cc", "x"))
def A5_monthly_by_model(spark, sf_dir):
    return rounded(stats.metrics(qc.complete_cases(_models(spark, sf_dir), KEYS, "x", 2), ["month", "model"], "x"))


@query(_MODELS + "select model, count(*) n, round(sum(x), 4) total from cc group by model")
def F7_complete_cases(spark, sf_dir):
    return rounded(qc.complete_cases(_models(spark, sf_dir), KEYS, "x", 2).groupBy("model").agg(F.count("*").alias("n"), F.sum("x").alias("total")), 4)


@query(_MODELS + "select model, nbias, si, cc from (" + _metrics("model", "cc", "x") + ")")
def A10_combined_errors(spark, sf_dir):
    return rounded(stats.metrics(qc.complete_cases(_models(spark, sf_dir), KEYS, "x", 2), ["model"], "x").select("model", "nbias", "si", "cc"))


@query(
    _OK + """, bins(bin, lo, hi) as (values ('0-1 d', 0.0, 24.0), ('1-3 d', 24.0, 72.0), ('3-5 d', 72.0, 120.0), ('5-7 d', 120.0, 168.0))
select bin, count(*) n, round(avg(model_hs) - avg(obs_hs), 6) bias, round(sqrt(avg((model_hs - obs_hs) ** 2)), 6) rmse, round(sqrt(count(*) * var_pop(model_hs - obs_hs) / sum(obs_hs * obs_hs)), 6) si, round(corr(model_hs, obs_hs), 6) cc
from ok join bins on lead_h between lo and hi group by bin having count(*) >= 2"""
)
def A6_lead_bins(spark, sf_dir):
    bins = spark.createDataFrame([("0-1 d", 0.0, 24.0), ("1-3 d", 24.0, 72.0), ("3-5 d", 72.0, 120.0), ("5-7 d", 120.0, 168.0)], "bin string, lo double, hi double")
    return rounded(stats.lead_metrics(checked(spark, sf_dir), bins))


@query(_GAPS + " union all ".join(f"(select '{k}' stratum, {k}::varchar as level, {metric_sql()} from full_pairs group by {k} having count(*) >= 2)" for k in ("zone", "status", "month")))
def A7_strata(spark, sf_dir):
    return rounded(stats.metrics_by_strata(gappy(spark, sf_dir), ["zone", "status", "month"]))


@query(_OK + ", c as (select *, (l_suppkey % 90 * 2 - 90)::double lat, (l_partkey % 180 * 2)::double lon from ok) " + _metrics("lat, lon", "c"))
def A8_error_map(spark, sf_dir):
    c = checked(spark, sf_dir).withColumns({"lat": (F.col("l_suppkey") % 90 * 2 - 90).cast("double"), "lon": (F.col("l_partkey") % 180 * 2).cast("double")})
    return rounded(stats.metrics(c, ["lat", "lon"]))


@query(_OK + ", c as (select *, (l_suppkey % 90 * 2 - 90)::double lat, (l_partkey % 180 * 2)::double lon from ok), m as (" + _metrics("lat, lon", "c") + ") select round(quantile_cont(abs(bias), 0.99), 6) bias, round(quantile_cont(abs(rmse), 0.99), 6) rmse from m")
def A8_colour_level(spark, sf_dir):
    return rounded(stats.colour_level(A8_error_map(spark, sf_dir), ["bias", "rmse"]))


@query(_GAPS + "select zone, round(stddev_pop(obs_hs), 6) sd_obs, round(stddev_pop(model_hs), 6) sd_model, round(stddev_pop(model_hs - obs_hs), 6) crmsd, round(corr(model_hs, obs_hs), 6) cc from full_pairs group by zone")
def A9_taylor(spark, sf_dir):
    return rounded(stats.taylor(gappy(spark, sf_dir), ["zone"]))


_QQ = ", ".join(repr(p) for p in stats.QQ_P)


@query(_MODELS + f", l as (select model, unnest([{_QQ}])::double p, unnest(quantile_cont(x, [{_QQ}])) q from cc group by model) select model, p, round(q, 6) q from l")
def A11_quantiles(spark, sf_dir):
    out = stats.quantiles(qc.complete_cases(_models(spark, sf_dir), KEYS, "x", 2), ["model"], "x")
    return out.withColumn("q", F.round("q", 6))


def _gauss(source: str, keys: str, value: str, n: int) -> str:
    """Gaussian smoothing with sigma 1 along i from 0 to n - 1, with mirrored edges."""
    w = windows.gaussian_weights(1.0)
    taps = ", ".join(f"({k - len(w) // 2}, {x!r}::double)" for k, x in enumerate(w))
    m = f"((a.i + k) % {2 * n} + {2 * n}) % {2 * n}"
    own = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"select {', '.join(f'a.{k}' for k in keys.split(', '))}, a.i, sum(w * b.{value}) g from {source} a, (values {taps}) t(k, w), {source} b where {own} and b.i = case when {m} < {n} then {m} else {2 * n - 1} - {m} end group by all"


@query(_MODELS + f", l as (select model, unnest([{_QQ}])::double p, unnest(range(0, {len(stats.QQ_P)}))::int i, unnest(quantile_cont(x, [{_QQ}])) q from cc group by model), g as ({_gauss('l', 'model', 'q', len(stats.QQ_P))}) select model, p, round(g, 6) q from l join g using (model, i)")
def A11_qq_curve(spark, sf_dir):
    return stats.qq_curve(qc.complete_cases(_models(spark, sf_dir), KEYS, "x", 2), ["model"], "x").withColumn("q", F.round("q", 6))


@query(_OK + "select zone, count(*) n, round(regr_slope(model_hs, obs_hs), 6) slope, round(regr_intercept(model_hs, obs_hs), 6) intercept from ok group by zone")
def A12_regression(spark, sf_dir):
    return rounded(stats.regression(checked(spark, sf_dir), ["zone"]))


@query(
    _PAIRS + """, long as (select zone, 'obs' series, obs_hs x from pairs union all select zone, 'model', model_hs from pairs), s as (select zone, series, count(*)::double n, pow(count(*)::double, -0.2) * stddev_samp(x) h, min(x) lo, max(x) hi from long group by all),
e as (select zone, min(lo) lo, max(hi) * 0.99::double hi from s group by 1), g as (select zone, series, n, h, i::int i, e.lo + (e.hi - e.lo) * i / 99 x from s join e using (zone), range(0, 100) r(i)), c as (select zone, series, x v, count(*) c from long group by all),
d as (select g.zone, g.series, g.i, g.x, sum(c * exp(-pow((g.x - v) / h, 2) / 2)) / (n * h * sqrt(2 * pi())) d from g join c using (zone, series) group by g.zone, g.series, g.i, g.x, n, h), """
    + f"k as ({_gauss('d', 'zone, series', 'd', 100)}) select zone, series, i, round(x, 6) x, round(g, 6) density from d join k using (zone, series, i)"
)
def A13_density(spark, sf_dir):
    p = v.pairs(spark, sf_dir)
    both = F.array(F.struct(F.lit("obs").alias("series"), F.col("obs_hs").alias("x")), F.struct(F.lit("model").alias("series"), F.col("model_hs").alias("x")))
    return rounded(density.density(p.select("zone", F.inline(both)), ["zone"], "series", "x"))


_STEPS, _REACH = density.PAIR_STEPS, density.PAIR_STEPS * density.PAIR_REACH


@query(
    _GAPS + f""", t as (select count(*)::double n, avg(model_hs) am, avg(obs_hs) ao, var_samp(model_hs) vm, var_samp(obs_hs) vo, covar_samp(model_hs, obs_hs) c from full_pairs), s as (select n, am, ao, pow(n, -1.0::double / 6) * sqrt(vm) l, pow(n, -1.0::double / 6) * c / sqrt(vm) k, pow(n, -1.0::double / 6) * sqrt(vo - c * c / vm) r from t),
w as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, n, l, r, (model_hs - am) / l * {_STEPS} u, (obs_hs - ao - k * (model_hs - am) / l) / r * {_STEPS} v from full_pairs, s), b as (select *, floor(u)::bigint x, floor(v)::bigint y, u - floor(u) a, v - floor(v) b from w),
g as materialized (select x + i x, y + j y, sum((case i when 1 then a else 1 - a end) * (case j when 1 then b else 1 - b end)) w from b, range(0, 2) p(i), range(0, 2) q(j) group by 1, 2), taps as (select k, exp(-pow(k / {_STEPS}.0::double, 2) / 2) e from range(-{_REACH}, {_REACH} + 1) r(k)),
o as (select distinct x + i x, y + j y from b, range(0, 2) p(i), range(0, 2) q(j)), h as materialized (select x + k x, y, sum(w * e) w from g, taps group by 1, 2), z as materialized (select o.x, o.y, sum(h.w * e) d from o, taps join h on h.x = o.x and h.y = o.y + k group by 1, 2)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(((1 - a) * (1 - b) * z00.d + a * (1 - b) * z10.d + (1 - a) * b * z01.d + a * b * z11.d) / (n * 2 * pi() * l * r), 6) density
from b join z z00 on z00.x = b.x and z00.y = b.y join z z10 on z10.x = b.x + 1 and z10.y = b.y join z z01 on z01.x = b.x and z01.y = b.y + 1 join z z11 on z11.x = b.x + 1 and z11.y = b.y + 1"""
)
def A14_pair_density(spark, sf_dir):
    """The density at each pair, as points of a scatter are coloured."""
    return rounded(density.pair_density(gappy(spark, sf_dir), KEYS).select(*KEYS, "density"))


@query(_OK + "select floor(obs_hs / 0.5)::int i, floor(model_hs / 0.5)::int j, count(*) n from ok where obs_hs between 0 and 12 and model_hs between 0 and 12 group by all")
def A14_density_2d(spark, sf_dir):
    return stats.density_2d(checked(spark, sf_dir), 0.0, 12.0, 24)


def _joined(spark, sf_dir):
    """Members as an array beside the control's observation, lead and status."""
    keys = [*KEYS, "obs_hs", "lead_h"]
    return ensemble.joined_members(v.members(spark, sf_dir), keys, 11, carried=("status", "month"))


_JOINED = v.with_views("members") + """, m1 as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, obs_hs, lead_h, member, min(model_hs) x, min({'status': status, 'month': month}) own from members group by all),
j as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, obs_hs, lead_h, list(x order by member) xs, arg_min(own, member) own from m1 group by all having count(*) = 11) """


@query(_JOINED + "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(obs_hs, 6) obs_hs, lead_h, round(xs[1], 6) control, round(xs[11], 6) last_member, own.status, own.month from j")
def J17_ensemble_join(spark, sf_dir):
    j = _joined(spark, sf_dir)
    return rounded(j.select(*KEYS, "obs_hs", "lead_h", F.col("members")[0].alias("control"), F.col("members")[10].alias("last_member"), "status", "month"))


@query(_JOINED + "select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(list_avg(xs), 6) mean from j")
def A19_ensemble_mean(spark, sf_dir):
    return rounded(_joined(spark, sf_dir).select(*KEYS, ensemble.mean_of_members(F.col("members")).alias("mean")))


@query(_JOINED + "select lead_h, count(*) n, round(avg(list_stddev_samp(xs)), 6) spread from j group by lead_h")
def A16_spread(spark, sf_dir):
    return rounded(_joined(spark, sf_dir).groupBy("lead_h").agg(F.count("*").alias("n"), F.avg(ensemble.spread(F.col("members"))).alias("spread")))


@query(_JOINED + ", e as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, obs_hs, lead_h, unnest(xs) x from j), a as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, lead_h, obs_hs, avg(abs(x - obs_hs)) near from e group by all), p as (select a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.obs_hs, a.lead_h, sum(abs(a.x - b.x)) / 121 apart from e a join e b using (l_orderkey, l_partkey, l_suppkey, l_linenumber, obs_hs, lead_h) group by all) select lead_h, count(*) n, round(avg(near - apart / 2), 6) crps from a join p using (l_orderkey, l_partkey, l_suppkey, l_linenumber, obs_hs, lead_h) group by lead_h")
def A17_crps(spark, sf_dir):
    return rounded(_joined(spark, sf_dir).groupBy("lead_h").agg(F.count("*").alias("n"), F.avg(ensemble.crps(F.col("members"), F.col("obs_hs"))).alias("crps")))


@query(_JOINED + ", e as (select lead_h, obs_hs, unnest(xs) x from j) select lead_h, round(avg(((x >= 5)::int - (obs_hs >= 5)::int) ** 2), 6) brier from e group by lead_h")
def A18_brier(spark, sf_dir):
    return rounded(ensemble.brier_score(_joined(spark, sf_dir), ["lead_h"], "members", "obs_hs", 5.0))


@query(_JOINED + ", t as (select avg(obs_hs) t from j), e as (select lead_h, obs_hs, t, unnest(xs) x from j, t) select lead_h, round(avg(((x >= t)::int - (obs_hs >= t)::int) ** 2), 6) brier from e group by lead_h")
def A18_brier_at_mean(spark, sf_dir):
    """Without a threshold: that of the mean observation."""
    return rounded(ensemble.brier_score(_joined(spark, sf_dir), ["lead_h"], "members", "obs_hs"))


#: A tie's place drawn by integer arithmetic on the keys.
_DRAW = "l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber"


@query(_JOINED + f", r as (select 1 + len(list_filter(xs, lambda x: x < obs_hs)) + ({_DRAW}) % (len(list_filter(xs, lambda x: x = obs_hs)) + 1) as rank from j), c as (select rank, count(*) n from r group by 1) select k::int as rank, coalesce(n, 0)::bigint n, coalesce(n, 0) / (select count(*) from r) share from range(1, 13) e(k) left join c on c.rank = k")
def A15_rank_histogram(spark, sf_dir):
    return ensemble.rank_histogram(_joined(spark, sf_dir), "members", "obs_hs", KEYS, 11, draw=F.expr(_DRAW))


_BELOW = _JOINED + ", r as (select len(list_filter(xs, lambda x: x < obs_hs)) below, len(list_filter(xs, lambda x: x = obs_hs)) ties from j) select below::int below, ties::int ties, count(*) n from r group by all"


@query(_BELOW)
def A15_rank_and_ties(spark, sf_dir):
    m = _joined(spark, sf_dir)
    below, ties = F.size(F.filter("members", lambda x: x < F.col("obs_hs"))), F.size(F.filter("members", lambda x: x == F.col("obs_hs")))
    return m.groupBy(below.alias("below"), ties.alias("ties")).agg(F.count("*").alias("n"))


@query(_PAIRS + ", s as (select station, case when station % 7 <> 0 then 1.0 end lat, case when station % 5 <> 0 then model_hs end m, case when station % 11 <> 0 then obs_hs end o from pairs) select station, count(m) n_model, count(o) n_obs, count(*) filter (m > 0 and o > 0) n_pairs from s group by station having max((lat is not null)::int) = 1 and count(m) > 0 and count(o) > 0")
def A21_completeness(spark, sf_dir):
    p = v.pairs(spark, sf_dir)
    s = p.select("station", F.when(F.col("station") % 7 != 0, 1.0).alias("lat"), F.when(F.col("station") % 5 != 0, F.col("model_hs")).alias("m"), F.when(F.col("station") % 11 != 0, F.col("obs_hs")).alias("o"))
    return stats.completeness(s, "station", "lat", "m", "o")


@query(v.with_views("field") + "select valid_time, round(max(hs), 6) most, round(avg(hs), 6) mean, round(quantile_cont(hs, 0.99), 6) p99, round(quantile_cont(hs, 0.999), 6) p999, round(quantile_cont(hs, 0.99995), 6) p99995 from field group by valid_time")
def A22_field_summary(spark, sf_dir):
    return rounded(stats.field_summary(v.field(spark, sf_dir), ["valid_time"], "hs"))


@query(v.with_views("points") + "select cycle, min(valid_time) as first, max(valid_time) as last, count(distinct valid_time) times from points group by cycle")
def A23_time_extent(spark, sf_dir):
    return stats.time_extent(v.points(spark, sf_dir), ["cycle"], "valid_time")


@query(v.with_views("points") + "select max(times) longest from (select count(distinct valid_time) times from points group by station, cycle)")
def A23_longest_run(spark, sf_dir):
    return stats.longest_run(stats.time_extent(v.points(spark, sf_dir), ["station", "cycle"], "valid_time"))


@query(_PAIRS + f"select month, {metric_sql()} from (select *, (l_partkey % 3000)::double depth, l_suppkey % 120 - 60 lat, l_linenumber cyclone from pairs) where depth > 80 and depth <= 2500 and lat between -30 and 30 and cyclone > 2 group by month having count(*) >= 2")
def F8_stratum(spark, sf_dir):
    p = v.pairs(spark, sf_dir).withColumns({"depth": (F.col("l_partkey") % 3000).cast("double"), "lat": F.col("l_suppkey") % 120 - 60, "cyclone": F.col("l_linenumber")})
    return rounded(stats.metrics(qc.stratum(p, (80, 2500), (-30, 30), 2), ["month"]))


@query(_PAIRS + f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, round(model_hs, 6) model_hs, round(obs_hs, 6) obs_hs from pairs where {QC_SQL}")
def F5_pair_qc(spark, sf_dir):
    return rounded(checked(spark, sf_dir).select(*KEYS, "model_hs", "obs_hs"))
