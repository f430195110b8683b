"""Spectral resampling between band tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def band_overlap(bands: DataFrame, keys: list[str], first: float, step: float, n: int) -> DataFrame:
    """J20. Power of bands (keys, i, p, lo, hi) on a fine axis: keys, g, x. A fine frequency takes the first band that holds it,
    edges included; its value is 100 * p * step / width. Each band lists the frequencies it holds, so nothing is searched.
    """
    lo, hi = F.ceil((F.col("lo") - first) / step - 1e-6).cast("int"), F.floor((F.col("hi") - first) / step + 1e-6).cast("int")
    inside = F.when(lo <= hi, F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n - 1))))
    each = bands.where((lo <= n - 1) & (hi >= 0)).withColumn("k", F.explode(inside))
    best = each.groupBy(*keys, "k").agg(F.min_by(F.struct("p", (F.col("hi") - F.col("lo")).alias("w")), "i").alias("b"))
    return best.select(*keys, (first + F.col("k") * step).alias("g"), (100 * F.col("b.p") * step / F.col("b.w")).alias("x"))
