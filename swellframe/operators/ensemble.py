"""Ensembles: the join of members, and scores that are row-local in the array of members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_members(long: DataFrame, keys: list[str], members: int, member: str = "member", value: str = "model_hs", carried: tuple[str, ...] = ()) -> DataFrame:
    """J17. Keys that every member has: keys, members (array in member order), and the carried columns of the control, the first member.
    Repeated keys of a member count once.

    Rows are dealt by their keys once; grouping by key and member, then by key, needs no further exchange. No join per member.
    """
    own = F.struct(*carried) if carried else F.lit(None)
    dealt = long.select(*keys, member, F.struct(F.col(value).alias("v"), own.alias("own")).alias("_v")).repartition(*keys)
    once = dealt.groupBy(*keys, member).agg(F.min("_v").alias("_v"))
    grouped = once.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(member, "_v"))).alias("_m")).where(F.size("_m") == members)
    more = [F.col("_m")[0]["_v"]["own"][c].alias(c) for c in carried]
    return grouped.select(*keys, F.transform("_m", lambda s: s["_v"]["v"]).alias("members"), *more)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def mean_of_members(members: Column) -> Column:
    """A19."""
    kept = F.filter(members, lambda x: x.isNotNull())
    return F.try_divide(_total(kept), F.size(kept))


def spread(members: Column) -> Column:
    """A16. Sample standard deviation."""
    n, m = F.size(members), _total(members) / F.size(members)
    return F.sqrt(_total(F.transform(members, lambda x: (x - m) * (x - m))) / (n - 1))


def crps(members: Column, obs: Column) -> Column:
    """A17. Mean distance to the observation less half the mean distance between members, by the sorted array."""
    n = F.size(members)
    between = _total(F.transform(F.sort_array(members), lambda x, i: (2 * i - n + 1) * x)) / (n * n)
    return _total(F.transform(members, lambda x: F.abs(x - obs))) / n - between


def brier(members: Column, obs: Column, threshold: Column | float, kind: str = "member") -> Column:
    """A18. Share of members that disagree with the observation on x >= threshold, or the square of the probability error."""
    hit = (obs >= threshold).cast("double")
    if kind == "probability":
        return F.pow(_total(F.transform(members, lambda x: (x >= threshold).cast("double"))) / F.size(members) - hit, 2)
    return _total(F.transform(members, lambda x: F.pow((x >= threshold).cast("double") - hit, 2))) / F.size(members)


def brier_score(joined: DataFrame, keys: list[str], members: str, obs: str, threshold: float | None = None, kind: str = "member") -> DataFrame:
    """A18. Mean Brier score by keys: keys, brier. Without a threshold, it is the mean of all observations."""
    rows = joined.select(*keys, F.col(members).alias("_m"), F.col(obs).alias("_o"))
    if threshold is None:
        mean = joined.agg(F.avg(obs).alias("_t"))
        rows = rows.crossJoin(F.broadcast(mean))  # one row
    return rows.groupBy(*keys).agg(F.avg(brier(F.col("_m"), F.col("_o"), F.lit(threshold) if threshold is not None else F.col("_t"), kind)).alias("brier"))


def rank_of(members: Column, obs: Column, keys: list[str], seed: int = 1, draw: Column | None = None) -> Column:
    """A15. Rank of the observation, from 1; among ties a place drawn by a hash of the keys, or by a number of the caller."""
    below = F.size(F.filter(members, lambda x: x < obs))
    ties = F.size(F.filter(members, lambda x: x == obs))
    return 1 + below + F.pmod(F.xxhash64(F.lit(seed), *keys) if draw is None else draw, ties + 1).cast("int")


def rank_histogram(df: DataFrame, members: str, obs: str, keys: list[str], size: int, seed: int = 1, draw: Column | None = None) -> DataFrame:
    """A15. rank, n, share of every rank from 1 to size + 1."""
    counted = df.groupBy(rank_of(F.col(members), F.col(obs), keys, seed, draw).alias("rank")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    every = total.select("total", F.explode(F.sequence(F.lit(1), F.lit(size + 1))).alias("rank"))
    out = every.join(counted, "rank", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("rank", "n", F.try_divide(F.col("n"), F.col("total")).alias("share"))
