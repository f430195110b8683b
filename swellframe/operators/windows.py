"""Ordered operators: gap filling, clocks that roll over, indices, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _block(order: str, block: float | None) -> Column:
    return F.lit(0).cast("bigint") if block is None else F.floor(F.col(order) / block)


def key_of(keys: list[str]) -> Column:
    """Keys as one value, whose nulls are equal in joins as they are in groups."""
    return F.struct(*keys) if keys else F.lit(0)


def filled(df: DataFrame, keys: list[str], order: str, value: str, limit: int | None = None, block: float | None = None) -> DataFrame:
    """W1. Gaps filled linearly in row order, at most `limit` rows from their start; the last value is repeated after the
    end (as far), and nothing stands before the first. `order` is unique within the keys.

    block: width of the parts, in units of a numeric `order`, that are worked on apart; what each needs of those before and after
    it (rows, last and next value) comes from a table with a row per part. Without it a series is one part.
    """
    own = ["_key", "_part"]
    w, down = Window.partitionBy(*own).orderBy(order), Window.partitionBy(*own).orderBy(F.desc(order))
    sofar = (Window.unboundedPreceding, 0)
    df = df.withColumns({"_key": key_of(keys), "_part": _block(order, block)}).withColumn("_n", F.row_number().over(w))
    at = F.when(F.col(value).isNotNull(), F.struct(F.col("_n").cast("bigint").alias("n"), F.col(value).alias("x")))
    df = df.withColumns({"_a": F.last(at, True).over(w.rowsBetween(*sofar)), "_b": F.last(at, True).over(down.rowsBetween(*sofar))})
    parts = df.groupBy(*own).agg(F.count("*").alias("_rows"), F.max(at).alias("_last"), F.min(at).alias("_first"))
    up, back = Window.partitionBy("_key").orderBy("_part"), Window.partitionBy("_key").orderBy(F.desc("_part"))
    others = (Window.unboundedPreceding, -1)
    parts = parts.withColumn("_skip", F.coalesce(F.sum("_rows").over(up.rowsBetween(*others)), F.lit(0)))
    moved = lambda c: F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.n") + F.col("_skip")).alias("n"), F.col(f"{c}.x").alias("x")))
    parts = parts.select(*own, "_skip", F.last(moved("_last"), True).over(up.rowsBetween(*others)).alias("_pa"), F.last(moved("_first"), True).over(back.rowsBetween(*others)).alias("_pb"))
    df = df.join(parts, own)
    a, b, n = F.coalesce(moved("_a"), F.col("_pa")), F.coalesce(moved("_b"), F.col("_pb")), F.col("_n") + F.col("_skip")
    line = F.when(b.isNull(), a.x).otherwise(a.x + (b.x - a.x) * F.try_divide(n - a.n, b.n - a.n))
    near = F.lit(True) if limit is None else (n - a.n) <= limit
    return df.withColumn(value, F.coalesce(F.col(value), F.when(a.isNotNull() & near, line))).drop("_key", "_part", "_n", "_a", "_b", "_skip", "_pa", "_pb")


def carried(df: DataFrame, keys: list[str], order: str, value: Column, into: str, block: float) -> DataFrame:
    """The last value that is not null up to each row, in the order of a numeric column that is unique within the keys. Parts as in `filled`: the last
    value of the parts before comes from a table with a row per part."""
    own = ["_key", "_part"]
    sofar = Window.partitionBy(*own).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_key": key_of(keys), "_part": _block(order, block), "_v": value}).withColumn("_own", F.last("_v", True).over(sofar))
    parts = df.groupBy(*own).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
    before = F.last("_last", True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return df.join(parts.select(*own, before.alias("_before")), own).withColumn(into, F.coalesce("_own", "_before")).drop(*own, "_v", "_own", "_before")


def rolled_months(df: DataFrame, keys: list[str], order: str, day: str, block: float | None = None) -> DataFrame:
    """W2. months: how often the day has fallen below that of the row before, for clocks that give day and hour only.

    block: as in `filled`; parts carry over how often the day fell before them, and the last day.
    """
    own = ["_key", "_part"]
    w = Window.partitionBy(*own).orderBy(order)
    fell = F.when(F.col(day) < F.lag(day).over(w), 1).otherwise(0)
    df = df.withColumns({"_key": key_of(keys), "_part": _block(order, block)}).withColumn("_f", fell)
    df = df.withColumn("_m", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = df.groupBy(*own).agg(F.sum("_f").alias("_falls"), F.min_by(day, order).alias("_first"), F.max_by(day, order).alias("_last"))
    up = Window.partitionBy("_key").orderBy("_part")
    parts = parts.withColumn("_edge", F.when(F.col("_first") < F.lag("_last").over(up), 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_falls")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_edge").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return df.join(parts.select(*own, before.alias("_before")), own).withColumn("months", F.col("_m") + F.col("_before")).drop("_key", "_part", "_f", "_m", "_before")


def lead_index(df: DataFrame, keys: list[str], time: str = "valid_time") -> DataFrame:
    """W5. lead_idx: the place of each time in its cycle, from 0."""
    return df.withColumn("lead_idx", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)


def gaussian_weights(sigma: float = 1.0, radius: int | None = None) -> list[float]:
    radius = int(4 * sigma + 0.5) if radius is None else radius
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def reflected(i: Column, n: Column) -> Column:
    """An index beyond an edge, mirrored so that the edge value is repeated."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def smoothed_columns(df: DataFrame, keys: list[str], index: str, values: dict[str, tuple[str, float]], carried: tuple[str, ...] = (), block: int = 4096) -> DataFrame:
    """W6. Gaussian smoothing along a dense index from 0, with mirrored edges: keys, index, the carried columns, and for each of `values`,
    out -> (value, sigma), its smoothing.

    A series is cut into blocks; a row also goes to a neighbouring block that it is within reach of. Each block, an array with its halo, is
    convolved in place: one exchange, and no row per tap. A series that is shorter than the reach is mirrored again.
    """
    taps = {out: gaussian_weights(sigma) for out, (_, sigma) in values.items()}
    reach = max(len(w) for w in taps.values()) // 2
    block = max(block, 2 * reach)
    i = F.col(index)
    b = F.floor(i / block)
    near = F.array(b, F.when(i % block < reach, b - 1), F.when(block - i % block <= reach, b + 1))
    entry = F.struct(i.alias("i"), *[F.col(v).cast("double").alias(f"v{k}") for k, (v, _) in enumerate(values.values())], *[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)])
    rows = df.select(key_of(keys).alias("_k"), entry.alias("_e"), F.explode(F.filter(near, lambda x: x >= 0)).alias("_b"))
    own = rows.groupBy("_k", "_b").agg(F.sort_array(F.collect_list("_e")).alias("_a"))  # at most block + 2 reach
    first, size = F.element_at("_a", 1)["i"], F.element_at("_a", -1)["i"] + 1  # without rows of the next block, the last of the series
    own = own.select("_k", "_b", "_a", first.alias("_first"), size.alias("_size"))

    def at(e: Column) -> Column:
        made = []
        for k, (out, w) in enumerate(taps.items()):
            terms = [F.coalesce(x * F.get("_a", (reflected(e["i"] + (j - len(w) // 2), F.col("_size")) - F.col("_first")).cast("int"))[f"v{k}"], F.lit(0.0)) for j, x in enumerate(w)]
            made.append(sum(terms[1:], terms[0]).alias(out))
        return F.struct(e["i"].alias(index), *made, *[e[f"c{k}"].alias(c) for k, c in enumerate(carried)])

    core = F.filter("_a", lambda e: F.floor(e["i"] / block) == F.col("_b"))
    out = own.select("_k", F.inline(F.transform(core, at)))
    return out.select(*[F.col(f"_k.{k}") for k in keys], index, *taps, *carried)


def smoothed(df: DataFrame, keys: list[str], index: str, value: str, sigma: float = 1.0, carried: tuple[str, ...] = ()) -> DataFrame:
    """W6. keys, index, smooth, and the carried columns."""
    return smoothed_columns(df, keys, index, {"smooth": (value, sigma)}, carried)


def smoothed_2d(field: DataFrame, keys: list[str], i: str, j: str, value: str, sigma: float = 1.0) -> DataFrame:
    """W7. Mean of the field, its smoothing with sigma and with sigma / 2; separable: an exchange along one axis, and one along the other."""
    along = smoothed_columns(field, [*keys, j], i, {"_s1": (value, sigma), "_s2": (value, sigma / 2)}, (value,))
    out = smoothed_columns(along, [*keys, i], j, {"_t1": ("_s1", sigma), "_t2": ("_s2", sigma / 2)}, (value,))
    return out.withColumn("smooth", (F.col(value) + F.col("_t1") + F.col("_t2")) / 3).select(*keys, i, j, value, "smooth")
