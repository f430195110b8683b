"""Joins in time: window averages, as-of lookups, intersections. Interval conditions become equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import key_of


def window_average(model: DataFrame, obs: DataFrame, keys: list[str], values: list[str], half: float = 1800.0, model_time: str = "valid_time", obs_time: str = "time") -> DataFrame:
    """J1. For each distinct (keys, model time): the mean of each value over observations less than `half` seconds away.

    Each model time looks at the two buckets of width 2*half that its window touches; each observation is in one.
    """
    width = 2 * half
    steps = model.select(*keys, model_time).distinct()
    low = F.floor((F.col(model_time) - half) / width).cast("bigint")
    steps = steps.select(*keys, model_time, F.explode(F.array(low, low + 1)).alias("bucket"))
    seen = obs.select(*keys, obs_time, *values, F.floor(F.col(obs_time) / width).cast("bigint").alias("bucket"))
    near = F.abs(F.col(obs_time) - F.col(model_time)) < half
    return steps.join(seen, [*keys, "bucket"]).where(near).groupBy(*keys, model_time).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))


def slot_lookup(rows: DataFrame, table: DataFrame, on: list[str], within: float, step: float, strict: bool = False, time: str = "time", table_time: str = "time", value: str = "code") -> DataFrame:
    """J2. The value of the first table time within reach of each row, at the row's keys; null if there is none.

    Table times are multiples of `step`; a row has at most 1 + 2*within/step of them, and they are listed rather than searched.
    """
    t = F.col(time)
    if strict:
        first, last = F.floor((t - within) / step) + 1, F.ceil((t + within) / step) - 1
    else:
        first, last = F.ceil((t - within) / step), F.floor((t + within) / step)
    slots = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
    # rows with the same keys and time have the same answer, so it is found once for each and joined back by them
    asked = rows.select(*on, F.col(time).alias("_t"), F.explode(slots).alias("_slot")).distinct()
    of = table.select(*on, F.round(F.col(table_time) / step).cast("bigint").alias("_slot"), F.col(value).alias("_value"))
    got = asked.join(of, [*on, "_slot"]).groupBy(*on, "_t").agg(F.min_by("_value", "_slot").alias(value))
    return rows.withColumn("_t", t).join(got, [*on, "_t"], "left").select(*rows.columns, value)


def as_of(rows: DataFrame, steps: DataFrame, keys: list[str], time: str = "time", step_time: str = "step_time", width: float = 864000.0) -> DataFrame:
    """J11. The last step time at or before each row's time, by a running maximum over both sorted together; null before the first.

    Series are cut into buckets of `width` seconds, so that no window holds a whole one. A bucket without a step before a row takes the last
    step of the buckets before it, however far back, from a table with a row per bucket.
    """
    bucket = F.floor(F.col("_t") / width)
    a = rows.withColumns({"_t": F.col(time), "_at": F.lit(1), "_last": F.lit(None).cast(steps.schema[step_time].dataType)})
    b = steps.select(*keys, F.col(step_time).alias("_t"), F.lit(0).alias("_at"), F.col(step_time).alias("_last")).distinct()
    both = a.unionByName(b, allowMissingColumns=True).withColumns({"_key": key_of(keys), "_bucket": bucket})
    own = ["_key", "_bucket"]
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*own).agg(F.max("_last").alias("_end")).select(*own, F.max("_end").over(before).alias("_before"))
    w = Window.partitionBy(*own).orderBy("_t", "_at").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_own", F.max("_last").over(w)).where("_at = 1").join(carried, own)
    return out.withColumn(step_time, F.coalesce("_own", "_before")).select(*rows.columns, step_time)


def with_cycle(df: DataFrame, keys: list[str], time: str = "valid_time") -> DataFrame:
    """P7. cycle, the first time of each file (keys), and lead, the time since then. Minima are summed before they meet the rows."""
    first = df.groupBy(*keys).agg(F.min(time).alias("cycle"))
    return df.join(first, keys).withColumn("lead", F.col(time) - F.col("cycle"))


def within_extent(rows: DataFrame, model: DataFrame, margin: float = 10800.0, time: str = "time", model_time: str = "valid_time") -> DataFrame:
    """A23. Rows within the model's time range and `margin` seconds around it, as a filter with two constants that reaches the scan."""
    low, high = model.agg(F.min(model_time), F.max(model_time)).first()
    return rows.where(F.lit(False)) if low is None else rows.where(F.col(time).between(float(low) - margin, float(high) + margin))


def fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """J16. Rows of the first source, and of the second for keys that the first has nothing of."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def hour_matched(a: DataFrame, b: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """J19. Rows of two series whose times agree when cut to the hour; columns of b other than keys get the suffix _b."""
    hour = F.floor(F.col(time) / 3600).cast("bigint")
    right = b.select(*keys, hour.alias("hour"), *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    return a.withColumn("hour", hour).join(right, [*keys, "hour"])


def nearest_in_time(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], within: float, time: str = "time") -> DataFrame:
    """J19. The values of the table row nearest in time (the earlier on a tie), at most `within` seconds away."""
    low = F.floor((F.col(time) - within) / (2 * within)).cast("bigint")
    asked = rows.select(*keys, F.col(time).alias("_t"), F.explode(F.array(low, low + 1)).alias("_b")).distinct()
    of = table.select(*keys, F.floor(F.col(time) / (2 * within)).cast("bigint").alias("_b"), F.struct(F.col(time), *values).alias("_v"))
    gap = F.abs(F.col("_t") - F.col(f"_v.{time}"))
    got = asked.join(of, [*keys, "_b"]).where(gap <= within).groupBy(*keys, "_t").agg(F.min_by("_v", F.struct(gap, F.col(f"_v.{time}"))).alias("_v"))
    out = rows.withColumn("_t", F.col(time)).join(got, [*keys, "_t"], "left")
    return out.select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def appended(*parts: DataFrame) -> DataFrame:
    """U1. Cycles, years or lead files one after the other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def common_times(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """U2. Keys that both have."""
    return a.select(*columns).intersect(b.select(*columns))


def stacked(parts: dict[int, DataFrame], name: str = "satellite_id") -> DataFrame:
    """U4. Missions stacked, each with its id."""
    return appended(*[p.withColumn(name, F.lit(i)) for i, p in parts.items()])
