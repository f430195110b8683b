"""Exact order statistics of groups of any size, by histograms that are narrowed.

A group's values are counted in bins between its least and largest value (summed before the shuffle). Prefix sums over the bins give the
rank that each begins with, so that those bins that hold a wanted rank are known, and only their values are binned again, between the least and
largest of the bin. That ends where a bin holds one value only, which needs no further look, or at most `limit` values, which one task
sorts. No task holds more values of a group, and nothing but counts of bins is shuffled for the rest. L-moments want all ranks: every bin is narrowed, and the
bins, with the rank that each begins with, give the sums over ranks of the whole.

Values are finite numbers; nulls, NaN and infinities are missing. Groups without values give no row. Null keys are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored, with_their_group
from .windows import key_of

#: Values of a bin that one task sorts.
LIMIT = 50_000
#: Most bins that a group, or a bin, is cut into.
BINS = 1 << 16
_AT = ["_k", "_path"]


def _values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.select(key_of(keys).alias("_k"), x.alias("_x")).where(F.abs(x) < float("inf"))


def _groups(rows: DataFrame, extra: list[Column]) -> DataFrame:
    """A bin for each group: n, lo, hi, below (ranks before it), and the extra aggregates of _x."""
    own = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"), *extra)
    return own.withColumns({"_path": F.lit(""), "below": F.lit(0).cast("bigint")})


def narrowed(rows: DataFrame, bins: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The bins that end the search, and the values of those among them that have to be sorted.

    bins: stored, _k, _path, n, lo, hi, below, want (ranks, or null for all). Values: _k, _path, _x, below, want.
    """
    limit = limit or LIMIT
    names = [*_AT, "n", "lo", "hi", "below", "want"]
    bins = bins.select(*names)
    rows = rows.withColumn("_path", F.lit(""))
    ended, values = [], []
    while True:
        flat, small = F.col("lo") == F.col("hi"), F.col("n") <= limit
        ended.append(bins.where(flat | small))
        values.append(with_their_group(rows, bins.where(~flat & small), _AT).select(*_AT, "_x", "below", "want"))
        large = bins.where(~flat & ~small)
        if large.limit(1).isEmpty():
            return reduce(DataFrame.unionByName, ended), reduce(DataFrame.unionByName, values)
        cuts = F.least(F.lit(BINS), F.greatest(F.lit(2), F.ceil(F.col("n") * 4 / limit)))
        share = (F.col("_x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # never decreases with x, nor overflows
        own = with_their_group(rows, large.withColumn("cuts", cuts.cast("int")).drop("below", "want"), _AT)
        own = own.select(*_AT, "_x", F.least(F.floor(share * F.col("cuts")).cast("int"), F.col("cuts") - 1).alias("_bin"))
        counted = own.groupBy(*_AT, "_bin").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*_AT).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = counted.withColumn("_before", before).join(large.select(*_AT, F.col("below").alias("_b"), F.col("want").alias("_w")), _AT)
        found = found.withColumn("below", F.col("_b") + F.col("_before"))
        found = found.withColumn("want", F.filter("_w", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))))
        deeper = F.concat("_path", F.lit("."), F.col("_bin").cast("string"))
        bins = stored(found.where("want is null or size(want) > 0").withColumn("_path", deeper).select(*names), "bins")
        rows = own.select("_k", deeper.alias("_path"), "_x")


def percentiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], extra: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """keys, n, q (array: the percentiles in the order of `at`, between two values on the line between them), and `extra`, aggregates of the column _x."""
    rows = _values(df, keys, value)
    place = lambda p: (F.col("n") - 1) * p
    shares = F.array(*[F.lit(float(p)) for p in at])
    ranks = F.flatten(F.transform(shares, lambda p: F.array(F.floor(place(p)), F.ceil(place(p))))).cast("array<bigint>")
    groups = stored(_groups(rows, extra or []).withColumn("want", F.array_distinct(ranks)), "groups")
    bins, values = narrowed(rows, groups, limit)
    rank = F.row_number().over(Window.partitionBy(*_AT).orderBy("_x")) - 1 + F.col("below")
    ordered = values.withColumn("r", rank.cast("bigint")).where(F.array_contains("want", F.col("r"))).select("_k", "r", F.col("_x").alias("v"))
    flat = bins.where("lo = hi").select("_k", F.explode("want").alias("r"), F.col("lo").alias("v"))
    found = flat.unionByName(ordered).groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("_v"))  # two for each of `at`
    out = groups.join(found, "_k")

    def between(p: Column) -> Column:
        low = F.floor(place(p)).cast("bigint")
        a, b = F.element_at("_v", low), F.element_at("_v", F.ceil(place(p)).cast("bigint"))
        return a + (place(p) - low) * (b - a)

    own = [F.col(f"_k.{k}") for k in keys]
    more = [c for c in groups.columns if c not in (*_AT, "n", "lo", "hi", "below", "want")]
    return out.select(*own, "n", *more, F.transform(shares, between).alias("q"))


def _choose(n: Column, k: int) -> Column:
    """n choose k, as a double."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (n - i) / (i + 1)
    return out


def probability_weighted(df: DataFrame, keys: list[str], value: str, limit: int | None = None) -> DataFrame:
    """keys, n, b0 to b3: the unbiased probability-weighted moments, mean of x times (rank choose k) / (n - 1 choose k), ranks from 0.

    A bin's own sums over its own ranks give those over ranks that begin elsewhere: (i + s choose k) = sum over j of (i choose j) (s choose k - j).
    """
    rows = _values(df, keys, value)
    groups = stored(_groups(rows, []).withColumn("want", F.lit(None).cast("array<bigint>")), "groups")
    bins, values = narrowed(rows, groups, limit)
    i = (F.row_number().over(Window.partitionBy(*_AT).orderBy("_x")) - 1).cast("double")
    sums = values.withColumn("_i", i).groupBy("_k", "_path", "below").agg(*[F.sum(F.col("_x") * _choose(F.col("_i"), j)).alias(f"s{j}") for j in range(4)])
    flat = bins.where("lo = hi").select("_k", "_path", "below", *[(F.col("lo") * _choose(F.col("n").cast("double"), j + 1)).alias(f"s{j}") for j in range(4)])
    start = F.col("below").cast("double")
    moved = lambda k: reduce(lambda a, b: a + b, [F.col(f"s{j}") * _choose(start, k - j) for j in range(k + 1)])
    total = flat.unionByName(sums.select(*flat.columns)).groupBy("_k").agg(*[F.sum(moved(k)).alias(f"t{k}") for k in range(4)])
    n = F.col("n").cast("double")
    b = [F.try_divide(F.col(f"t{k}"), n * _choose(n - 1, k)).alias(f"b{k}") for k in range(4)]
    return groups.select("_k", "n").join(total, "_k").select(*[F.col(f"_k.{k}") for k in keys], "n", *b)
