"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.tables import shared_dir, stored, table

__all__ = ["earlier", "id_crc", "shared_dir", "small", "stored", "table"]


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that few texts at a time become Python objects."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text, unsigned."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def earlier(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same ``by`` that come before by ``order``.

    ``rows`` should hold numbers only, ``order`` should tell all rows of a
    group apart, and ``by`` isn't null. Rows are dealt by ranges of both, so a
    group of any size is spread over many tasks; only one sum for each range
    and group meets in a task.
    """
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_in", F.coalesce(F.sum(value).over(until(Window.partitionBy(*by, "_range").orderBy(*order))), F.lit(0)))
    sums = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(until(Window.partitionBy(*by).orderBy("_range"))), F.lit(0))).drop("_sum")
    return inside.join(starts, [*by, "_range"]).withColumn(name, F.col("_in") + F.col("_start")).select(*rows.columns, name)
