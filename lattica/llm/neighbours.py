"""Nearest neighbours by a block matrix join.

Vectors are coded in 8 bits, each with a scale of its own. A tile of queries
and rows is one product of their codes; with the length of what coding lost on
either side it bounds every inner product from below and above. Pairs whose
upper bound reaches what a query has already are computed again in double
precision from the original vectors, and a heap for each query keeps the best.
The bounds hold for every pair, so the result is exact.

Which rows: vectors that are null, empty, zero or hold a null or a component
that isn't finite take no part, nor do rows without an id, as no result could
name them. Vectors meet those of their own length only. Repeated rows are rows
of their own: each is a query with a result of its own, and a candidate of the
others; a query leaves out one row that equals itself. Without rows the result
is empty. Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import bounds, by_tile, matrices, merged, tiles, usable
from .common import stored

#: Queries of a block, rows that a stripe has at least, and rows of a product.
BLOCK, STRIPE, ROWS = 4096, 2048, 2048
#: Columns whose products of codes a float holds exactly, and what rounding may add to a bound.
EXACT, SLACK = 1024, 1e-9
TINY = np.finfo(np.float64).tiny


class Coded:
    """Vectors as 8-bit codes, with scale, length of the coded vector, of the original, and of the difference."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.scale = np.maximum(np.abs(self.x).max(axis=1) / 127, TINY)
        self.codes = np.rint(self.x / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.near, self.length, self.lost = (np.sqrt((v * v).sum(axis=1)) for v in (near, self.x, self.x - near))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of codes, without rounding."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        out += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return out


def between(q: Coded, r: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products."""
    mid = products(q.codes, r.codes) * q.scale[:, None] * r.scale
    lost = np.outer(q.near, r.lost) + np.outer(q.lost, r.length)
    lost += SLACK * (np.outer(q.length, r.length) + TINY)
    return mid - lost, mid + lost


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b, added up from the first component to the last."""
    out = np.empty(len(i))
    step = max(1, (1 << 20) // a.shape[1])
    for k in range(0, len(i), step):
        s = slice(k, k + step)
        out[s] = np.cumsum(a[i[s]] * b[j[s]], axis=1)[:, -1]
    return out


class Best:
    """The best rows of each query of a tile, by heaps of (score, -id, own) with the worst on top."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: int):
        self.ids, self.q, self.most = ids, Coded(vectors), most
        self.heaps: list[list] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for k in range(0, len(ids), ROWS):
            self._meet(ids[k : k + ROWS], Coded(vectors[k : k + ROWS]))

    def _meet(self, ids: np.ndarray, r: Coded) -> None:
        low, high = between(self.q, r)
        need = self.least
        if len(ids) > self.most:
            # What this many rows of the tile reach at least.
            busy = np.flatnonzero((high >= need[:, None]).sum(axis=1) > 2 * self.most)
            reach = np.partition(low[busy], -self.most, axis=1)[:, -self.most]
            need = need.copy()
            need[busy] = np.maximum(need[busy], reach)
        i, j = np.nonzero(high >= need[:, None])
        scores = exact(self.q.x, r.x, i, j)
        order = np.lexsort((ids[j], -scores, i))
        i, j, scores = i[order], j[order], scores[order]
        first = np.searchsorted(i, np.arange(len(self.ids)))
        keep = (np.arange(len(i)) - first[i] < self.most) & (scores >= self.least[i])
        i, j, scores = i[keep], j[keep], scores[keep]
        own = self.ids[i] == ids[j]
        own[own] = (self.q.x[i[own]] == r.x[j[own]]).all(axis=1)
        for q, item in zip(i.tolist(), zip(scores.tolist(), (-ids[j]).tolist(), own.tolist())):
            heap = self.heaps[q]
            if len(heap) < self.most:
                heapq.heappush(heap, item)
            else:
                heapq.heappushpop(heap, item)
            if len(heap) == self.most:
                self.least[q] = heap[0][0]


FOUND = "key long, query_id long, vec_id long, score double, own boolean"


def nearest(rows: DataFrame, asked: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the largest inner product with each row for which ``asked`` holds.

    All other rows are candidates; ties go to the smaller id. Fewer than ``k``
    come where there are fewer.
    """
    element = rows.schema[vector].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"
    nonzero = F.exists(F.col(vector), lambda v: v != 0)
    good = rows.where(usable(vector) & F.coalesce(nonzero, F.lit(False)) & F.col(key).isNotNull())
    same = good.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    queries = stored(same.where("asked").select(F.monotonically_increasing_id().alias("key"), "id", "v"), "queries")
    n = same.count()
    blocks, stripes = bounds(rows, queries.count(), n, BLOCK, STRIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, parts in by_tile(batches):
            keys, ids = q["key"].to_numpy(), q["id"].to_numpy()
            best = {x.shape[1]: (at, Best(ids[at], x, k + 1)) for at, x in matrices(q["v"])}
            for b in parts:
                names = b["id"].to_numpy()
                for at, x in matrices(b["v"]):
                    if x.shape[1] in best:
                        best[x.shape[1]][1].meet(names[at], x)
            for at, found in best.values():
                rows_ = [(keys[at[n]], ids[at[n]], -i, s, o) for n, heap in enumerate(found.heaps) for s, i, o in heap]
                if rows_:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), kinds)], names=["key", "query_id", "vec_id", "score", "own"])

    found = tiles(queries, same.select("id", "v"), blocks, stripes).mapInArrow(run, FOUND)
    top = merged(found, ["key"], [F.desc("score"), F.col("vec_id")], k)
    return top.select("query_id", "rank", "vec_id", "score")
