"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = {"hs": "m", "tm": "s", "tp": "s", "dm": "degrees", "dp": "degrees", "wnd": "m/s", "distcoast": "km", "depth": "m", "lat": "degrees", "lon": "degrees"}


def _unit(name: str) -> str | None:
    return next((u for k, u in UNITS.items() if name == k or name.endswith(f"_{k}")), None)


def write_parts(df: DataFrame, path: str, by: list[str], order: list[str], rows_per_file: int) -> None:
    """Parquet files of about so many rows under a folder for each value of `by`, in order. Only the folders that have rows are replaced.

    Rows are dealt by ranges over `by`, then `order`, then a hash of the row, as many as the counted rows ask for: a large folder gets
    several files, each of a stretch, and small ones share a task.
    """
    parts = max(1, -(-df.count() // rows_per_file))
    ties = F.xxhash64(*[c for c in df.columns if c not in (*by, *order)])
    dealt = df.repartitionByRange(parts, *by, *order, ties).sortWithinPartitions(*by, *order)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_matchups(df: DataFrame, path: str, time: str = "valid_time", partition_by: tuple[str, ...] = ("run_id", "month_start"), rows_per_file: int = 4_000_000) -> None:
    """K1. Parquet by run and month; measures as float, times as they are, units as column metadata. See `write_parts`; a month that is written again
    replaces its own rows only."""
    cols = []
    for c, t in df.dtypes:
        x = F.col(c).cast("float") if t == "double" and not c.endswith("time") and c != "cycle" else F.col(c)
        cols.append(x.alias(c, metadata={"units": u}) if (u := _unit(c)) else x.alias(c))
    out = df.select(*cols).withColumn("month_start", F.date_trunc("month", F.timestamp_seconds(time)).cast("date"))
    by = [c for c in partition_by if c in out.columns]
    write_parts(out, path, by, [time], rows_per_file)


def write_altimeter_csv(df: DataFrame, path: str, exact: tuple[str, ...] = ("time", "sat_time"), most_rows: int | None = None) -> bool:
    """K2. CSV files with a header, measures rounded to 3 decimals, at any size; with most_rows, only if there are fewer rows (counted
    where they are, the input is then read twice). Whether it was written."""
    if most_rows is not None and df.count() >= most_rows:
        return False
    cols = [F.round(c, 3).alias(c) if t in ("double", "float") and c not in exact else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_extraction(df: DataFrame, path: str, values: tuple[str, ...]) -> None:
    """K3. Tab-separated, values with three decimals, NaN where missing."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))).otherwise("NaN").alias(c) for c in values]
    rest = [F.col(c).cast("string").alias(c) for c in df.columns if c not in values]
    df.select(*rest, *shown).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def compacted(fields: DataFrame, keep: list[str], lat: tuple[float, float] = (-79.0, 90.0), decimals: int = 2) -> DataFrame:
    """K4. Kept variables between two latitudes, rounded."""
    t = dict(fields.dtypes)
    cols = [F.round(c, decimals).alias(c) if t[c] == "double" and c not in ("lat", "lon", "valid_time", "cycle") else F.col(c) for c in keep]
    return fields.where(F.col("lat").between(*lat)).select(*cols)


def write_archive(fields: DataFrame, path: str, keep: list[str], rows_per_file: int = 4_000_000) -> None:
    """K4. The compacted archive, by member and cycle, sorted by time and place; see `write_parts`."""
    write_parts(compacted(fields, keep), path, ["member", "cycle"], ["valid_time", "lat", "lon"], rows_per_file)
