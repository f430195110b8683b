"""Kernel densities in work that is linear in rows.

Curves are direct sums: each distinct value meets the points of its curve, 100 whatever the rows. Densities at pairs bin pairs to a fine grid: a value between
two grid points goes to both, in proportion to its nearness (linear binning), so that rows are summed before any shuffle and the kernel meets grid points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored, with_their_group
from .windows import key_of, smoothed

#: Grid points in a bandwidth of pairs, and bandwidths that their kernel reaches; TILE points make a side of what one task convolves.
PAIR_STEPS, PAIR_REACH, TILE = 8, 5, 256


def density(long: DataFrame, keys: list[str], series: str, value: str, points: int = 100, sigma: float = 1.0) -> DataFrame:
    """A13. Gaussian kernel densities of each series (observations, models) on one axis for all series of a group, from the least value to 0.99 of the
    largest, then smoothed: keys, series, i, x, density. Bandwidth n ** (-1/5) sample deviations of the series.

    Every value meets every point: equal values are counted first, and sums of a task's values leave it as one row for each point of a curve.
    """
    own = [*keys, series]
    rows = long.where(F.col(value).isNotNull()).select(key_of(own).alias("_k"), F.col(value).cast("double").alias("_x"))
    stats = rows.groupBy("_k").agg(F.count("*").alias("n"), F.stddev_samp("_x").alias("s"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    stats = stats.withColumn("_g", F.struct(*[F.col(f"_k.{k}") for k in keys]) if keys else F.lit(0))
    axis = stats.groupBy("_g").agg(F.min("lo").alias("a"), (F.max("hi") * 0.99).alias("b"))
    bandwidth = F.pow("n", F.lit(-0.2)) * F.col("s")
    stats = stats.where("n > 1 and s > 0").join(axis, "_g").select("_k", "n", bandwidth.alias("h"), "a", ((F.col("b") - F.col("a")) / (points - 1)).alias("step"))
    stats = stored(stats, "curves")
    every = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    counted = with_their_group(rows.groupBy("_k", "_x").agg(F.count("*").alias("c")), stats, ["_k"])
    z = (F.col("a") + F.col("step") * F.col("i") - F.col("_x")) / F.col("h")
    total = counted.select("*", every).groupBy("_k", "i").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("t"))
    d = F.col("t") / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    raw = stats.select("*", every).join(total, ["_k", "i"]).select(*[F.col(f"_k.{k}") for k in own], "i", (F.col("a") + F.col("step") * F.col("i")).alias("x"), d.alias("d"))
    return smoothed(raw, own, "i", "d", sigma, carried=("x",)).select(*own, "i", "x", F.col("smooth").alias("density"))


def _convolved(group: pa.Table) -> pa.Table:
    """A tile's cells (cx, cy from its corner, w, n) to those with pairs (x, y, n) and the kernel sums at their four corners."""
    reach = PAIR_STEPS * PAIR_REACH
    size = TILE + 1 + 2 * reach
    x, y = (group[c].to_numpy() - group[t].to_numpy() * TILE for c, t in (("x", "tx"), ("y", "ty")))
    w = np.zeros((size, size))
    np.add.at(w, (x + reach, y + reach), group["w"].to_numpy())
    off = np.arange(size)[None] - np.arange(TILE + 1)[:, None] - reach
    kernel = np.where(np.abs(off) <= reach, np.exp(-((off / PAIR_STEPS) ** 2) / 2), 0.0)
    d = kernel @ w @ kernel.T
    own = np.flatnonzero((group["n"].to_numpy() > 0) & (x >= 0) & (x < TILE) & (y >= 0) & (y < TILE))
    a, b = x[own], y[own]
    cells = group.take(pa.array(own)).select(["x", "y", "n"])
    for name, i, j in (("d00", 0, 0), ("d10", 1, 0), ("d01", 0, 1), ("d11", 1, 1)):
        cells = cells.append_column(name, pa.array(d[a + i, b + j]))
    return cells


def pair_density(pairs: DataFrame, keys: list[str], model: str = "model_hs", obs: str = "obs_hs") -> DataFrame:
    """A14. The Gaussian kernel density of (model, observation) at each pair: keys (carried along), model, obs, density. The bandwidth matrix is the sample covariance
    times n ** (-1/3); no rows where it is singular.

    In coordinates in which it is the identity the kernel is a product, and sums along one axis, then the other. Pairs are binned to a grid there; tiles of the grid, with
    a halo of the kernel's reach, are convolved apart, and each pair reads its density between the four grid points around it.
    """
    m, o = F.col(model).cast("double"), F.col(obs).cast("double")
    rows = pairs.where((F.abs(m) < float("inf")) & (F.abs(o) < float("inf"))).select(F.struct(*keys).alias("_keys"), m.alias("_m"), o.alias("_o"))
    s = rows.agg(F.count("*").alias("_n"), F.avg("_m").alias("_am"), F.avg("_o").alias("_ao"), F.var_samp("_m").alias("_vm"), F.var_samp("_o").alias("_vo"), F.covar_samp("_m", "_o").alias("_c"))
    f = F.pow("_n", F.lit(-1.0 / 6.0))
    s = s.where("_vm > 0 and _vo - _c * _c / _vm > 1e-12 * _vo")
    s = s.select("_n", "_am", "_ao", (f * F.sqrt("_vm")).alias("_l"), (f * F.col("_c") / F.sqrt("_vm")).alias("_k"), (f * F.sqrt(F.col("_vo") - F.col("_c") * F.col("_c") / F.col("_vm"))).alias("_r"))
    white = rows.crossJoin(F.broadcast(stored(s, "kernel")))  # one row
    u = (F.col("_m") - F.col("_am")) / F.col("_l")
    white = white.withColumn("_u", u * PAIR_STEPS).withColumn("_v", (F.col("_o") - F.col("_ao") - F.col("_k") * u) / F.col("_r") * PAIR_STEPS)
    white = white.withColumns({"x": F.floor("_u"), "y": F.floor("_v")}).withColumns({"_u": F.col("_u") - F.col("x"), "_v": F.col("_v") - F.col("y")})

    side = lambda c, i: F.col(c) if i else 1 - F.col(c)
    corners = [F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"), (side("_u", i) * side("_v", j)).alias("w"), F.lit(int(not i and not j)).alias("n")) for i in (0, 1) for j in (0, 1)]
    cells = white.select(F.inline(F.array(*corners))).groupBy("x", "y").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    reach = PAIR_STEPS * PAIR_REACH

    def tiles(c: str):  # a point on the far side of a tile counts as its own
        return F.sequence(F.floor((F.col(c) - reach - 1) / TILE), F.floor((F.col(c) + reach) / TILE))

    dealt = cells.withColumn("tx", F.explode(tiles("x"))).withColumn("ty", F.explode(tiles("y"))).where((F.col("x") - F.col("tx") * TILE <= TILE + reach) & (F.col("y") - F.col("ty") * TILE <= TILE + reach))
    summed = dealt.groupBy("tx", "ty").applyInArrow(_convolved, "x bigint, y bigint, n bigint, d00 double, d10 double, d01 double, d11 double")
    found = with_their_group(white, stored(summed, "tiles"), ["x", "y"])
    a, b = F.col("_u"), F.col("_v")
    d = (1 - a) * (1 - b) * F.col("d00") + a * (1 - b) * F.col("d10") + (1 - a) * b * F.col("d01") + a * b * F.col("d11")
    return found.select(*[F.col(f"_keys.{k}") for k in keys], F.col("_m").alias(model), F.col("_o").alias(obs), (d / (F.col("_n") * 2 * F.pi() * F.col("_l") * F.col("_r"))).alias("density"))
