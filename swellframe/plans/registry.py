"""Registered queries: name, function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, decimals: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, and never a negative zero, so that two engines' sums agree."""
    return df.select(*[(F.round(c, own.get(c, decimals)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
