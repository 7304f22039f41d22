"""Queries that all rows must meet, dealt out as a grid of blocks.

Queries come in blocks and rows in stripes; a tile is one block and one stripe,
and one task. Each query is sent to every stripe and each row to every block,
so nothing is broadcast, and no pair of a query and a row becomes a row of its
own. ``bounds`` says how large tiles get.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    x = F.col(vector)
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))), F.lit(False))


def bounds(df: DataFrame, n_queries: int, n_rows: int, block: int, least: int, most: int | None = None) -> tuple[int, int]:
    """Numbers of blocks and stripes: at most ``block`` queries in a block, about ``least`` rows in a stripe or more, ``most`` at most.

    Between these the cluster decides: a tile for each of its cores, and no more
    stripes, as each has results of all queries to be merged.
    """
    blocks = max(1, -(-n_queries // block))
    stripes = max(1, min(-(-n_rows // least), -(-df.sparkSession.sparkContext.defaultParallelism // blocks)))
    return blocks, max(stripes, -(-n_rows // most)) if most else stripes


def tiles(queries: DataFrame, rows: DataFrame, blocks: int, stripes: int) -> DataFrame:
    """Both sides dealt to their tiles, each partition one tile with its queries first.

    ``queries`` has a ``key`` of its own for each row. Columns that one side
    lacks are null there; ``_side`` is 0 for queries and 1 for rows.
    """
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    stripe = F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int")
    at = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    q = queries.withColumn("_block", block).withColumn("_stripe", at(stripes)).withColumn("_side", F.lit(0))
    r = rows.withColumn("_stripe", stripe).withColumn("_block", at(blocks)).withColumn("_side", F.lit(1))
    both = q.unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_tile", F.col("_block") * stripes + F.col("_stripe")).drop("_block", "_stripe")
    return both.repartitionById(blocks * stripes, "_tile").sortWithinPartitions("_tile", "_side")


def by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, Iterator[pa.RecordBatch]]]:
    """(queries, batches of rows) of each tile; tiles without queries or rows are left out."""
    parts = _runs(batches)
    held: pa.RecordBatch | None = next(parts, None)
    while held is not None:
        tile, queries = held["_tile"][0].as_py(), []
        while held is not None and held["_tile"][0].as_py() == tile and held["_side"][0].as_py() == 0:
            queries.append(held)
            held = next(parts, None)
        mine: list[pa.RecordBatch | None] = [held]

        def rows() -> Iterator[pa.RecordBatch]:
            while mine[0] is not None and mine[0]["_tile"][0].as_py() == tile:
                yield mine[0]
                mine[0] = next(parts, None)

        some = rows()
        first = next(some, None)
        if queries and first is not None:
            yield pa.Table.from_batches(queries), chain([first], some)
        for _ in some:
            pass
        held = mine[0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices that hold one side of one tile each."""
    for b in batches:
        if b.num_rows:
            mark = b["_tile"].to_numpy().astype(np.int64) * 2 + b["_side"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                yield b.slice(x, y - x)


def matrices(vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for the vectors of each length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)]


def merged(found: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group with their ``rank``, without the group's first row flagged ``own``.

    Each tile gave ``most`` + 1 rows of a group at most, so this merge sees
    that many for each stripe; Spark cuts before the shuffle too.
    """
    w = Window.partitionBy(*by)
    top = found.withColumn("_n", F.row_number().over(w.orderBy(*order, F.desc("own")))).where(F.col("_n") <= most + 1)
    top = top.withColumn("_own", F.min(F.when(F.col("own"), F.col("_n"))).over(w)).where("_own is null or _n <> _own")
    rank = F.col("_n") - F.when(F.col("_n") > F.col("_own"), 1).otherwise(0)
    return top.withColumn("rank", rank.cast("int")).where(F.col("rank") <= most).drop("_n", "_own", "own")
