"""Append-only logs, partitioned by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class AppendOnly(ValueError):
    pass


def append(rows: DataFrame, path: str, ts: str = "ts", by: str = "month", mode: str = "append") -> None:
    """Add rows under year and month (or quarter); nothing is ever written over."""
    if mode != "append":
        raise AppendOnly("a log only grows")
    part = F.quarter(ts) if by == "quarter" else F.month(ts)
    rows.withColumns({"year": F.year(ts), by: part}).write.mode("append").partitionBy("year", by).parquet(path)


def tenant(spark: SparkSession, path: str, company: int) -> DataFrame:
    """One tenant's rows; the predicate reaches the scan."""
    return spark.read.parquet(path).where(F.col("company_id") == company)


def manifest(spark: SparkSession, path: str, file_type: str | None = None, company: str | None = None, license: str | None = None, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Entries of a corpus manifest, filtered; what isn't given doesn't filter. One JSON array, or an entry a line."""
    rows = spark.read.option("multiLine", not lines).json(path)
    for name, value in (("file_type", file_type), ("company_tag", company), ("license", license)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows if limit is None else rows.orderBy("url").limit(limit)
