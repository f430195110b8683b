"""Tables that are written once to the folder that driver and executors share, and joins of rows with a table of their groups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups (of a few numbers, or a few hundred ranks) that are broadcast.
BROADCAST_GROUPS = 20_000
#: Rows of a number or two that are broadcast.
BROADCAST_ROWS = 200_000


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests) only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once and read again: later jobs neither recompute nor lose them."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_few(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, of a number or two each, stored and counted; marked for broadcast if they are few (BROADCAST_ROWS)."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else kept


def with_their_group(rows: DataFrame, groups: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """rows joined with the group that they belong to. groups: stored, one row for each value of `on` (not null), with `n`, the rows that it has.

    Few groups are broadcast (they are counted first). Of many, those with a thousandth of the rows or more, at most a thousand, are broadcast, and
    the others meet their rows by shuffle: no task gathers the rows of a common key.
    """
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on)
    total = groups.agg(F.sum(n).alias("n")).first()["n"]
    is_hot = F.col(n) * 1000 >= F.lit(total)
    hot, others = F.broadcast(groups.where(is_hot)), groups.where(~is_hot)
    rest = rows.join(F.broadcast(groups.where(is_hot).select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(others, on))
