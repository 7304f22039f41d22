"""Hard negatives by branch and bound in ball trees.

Each stripe of rows is one ball tree in one task. A node's centre and radius
bound the inner products of an anchor with all of its rows from above and from
below; a node is left out if that range misses the window of scores that an
anchor asks for, if it lies strictly beneath the anchor's present k-th score
(an equal score could still win by its id), or if its labels can't count.
The trees are searched twice: for the positives of each anchor, rows of its own
label; and, once all stripes agree on those, for the negatives, rows of other
labels within each positive's window. Scores are whole numbers, so results
are exact.

Which rows: those with a null label or vector, or with a component that is
null or not finite, take no part, nor do rows without an id or components.
Vectors meet those of their own length only. Repeated rows are rows of their
own: each is an anchor, a positive and a negative by itself, and an anchor
leaves out one row that equals itself. An anchor without positives, or without
negatives in a window, has no rows in the result. Scores beyond 64 bits are
errors. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import bounds, by_tile, matrices, merged, tiles, usable
from .common import stored

#: Anchors of a block; rows that a tree has at least and at most; rows of a leaf.
BLOCK, STRIPE, TREE, LEAF = 4096, 2048, 16_384, 64
#: Below this, sums of products of whole numbers are exact in double precision.
WHOLE = 2.0**53
NONE, ANY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    """Rows in an order in which each node is a run of rows; nodes know centre, radius and range of labels."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        points, order = x.astype(np.float64), np.arange(len(x))
        self.nodes: list[tuple] = []
        self.children: list[tuple[int, int]] = []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = len(self.nodes)
            if parent >= 0:
                self.children[parent] = (*self.children[parent], own)
            here = points[order[a:b]]
            centre = here.mean(axis=0)
            away = np.sqrt(((here - centre) ** 2).sum(axis=1))
            of = labels[order[a:b]]
            self.nodes.append((a, b, centre, away.max(), of.min(), of.max()))
            self.children.append(())
            if b - a > LEAF and away.max() > 0:
                one = here[away.argmax()]
                other = here[((here - one) ** 2).sum(axis=1).argmax()]
                along = here @ (other - one)
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(along, half)]
                todo += [(a, a + half, own), (a + half, b, own)]
        self.x, self.points, self.ids, self.labels = x[order], points[order], ids[order], labels[order]
        self.most = np.abs(self.points).max()

    def search(self, s: Search) -> None:
        """Offer each row that can count to each query of ``s``; the child that seems nearer comes first."""
        todo = [(0, np.arange(len(s.ids)))]
        while todo:
            node, active = todo.pop()
            a, b, centre, radius, low, high = self.nodes[node]
            active = active[s.may(active, centre, radius, low, high)]
            if not len(active):
                continue
            if not self.children[node]:
                for k in range(a, b, LEAF):  # equal rows stay in one leaf, however many
                    s.meet(active, self, slice(k, min(b, k + LEAF)))
                continue
            mean = s.points[active].mean(axis=0)
            todo += [(child, active) for child in sorted(self.children[node], key=lambda c: mean @ self.nodes[c][2])]


class Search:
    """Queries of one length, and the ``most`` best rows so far of each: scores, ids, and whether a row is the query's own."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, most: int, same: bool, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.x, self.points, self.ids, self.labels, self.same = x, x.astype(np.float64), ids, labels, same
        self.length = np.sqrt((self.points**2).sum(axis=1))
        self.low = np.full(len(ids), NONE) if low is None else low
        self.high = np.full(len(ids), ANY) if high is None else high
        self.scores, self.found = np.full((len(ids), most), NONE), np.full((len(ids), most), ANY)
        self.own = np.zeros((len(ids), most), bool)
        self.most_x = np.abs(self.points).max()

    def may(self, active: np.ndarray, centre: np.ndarray, radius: float, low: int, high: int) -> np.ndarray:
        """Of which queries a node may hold a row that counts."""
        of = self.labels[active]
        some = (low <= of) & (of <= high) if self.same else ~((low == of) & (of == high))
        mid, reach = self.points[active] @ centre, self.length[active] * radius
        slack = 1 + 1e-9 * self.length[active] * (np.sqrt((centre**2).sum()) + radius)
        top, bottom = mid + reach + slack, mid - reach - slack
        return some & (top >= self.scores[active, -1]) & (top >= self.low[active]) & (bottom <= self.high[active])

    def meet(self, active: np.ndarray, tree: BallTree, rows: slice) -> None:
        if self.x.shape[1] * max(self.most_x, 1) * max(tree.most, 1) < WHOLE:
            scores = (self.points[active] @ tree.points[rows].T).astype(np.int64)
        else:
            scores = (self.x[active].astype(object) @ tree.x[rows].astype(object).T).astype(np.int64)
        alike = self.labels[active][:, None] == tree.labels[rows]
        fits = (alike == self.same) & (scores >= self.low[active][:, None]) & (scores <= self.high[active][:, None]) & (scores >= self.scores[active, -1][:, None])
        some = fits.any(axis=1)
        active, scores, fits = active[some], scores[some], fits[some]
        if not len(active):
            return
        ids = np.broadcast_to(tree.ids[rows], scores.shape)
        own = np.zeros(scores.shape, bool)
        if self.same:
            for i, j in zip(*np.nonzero(fits & (ids == self.ids[active][:, None]))):
                own[i, j] = np.array_equal(self.x[active[i]], tree.x[rows][j])
        scores = np.concatenate([self.scores[active], np.where(fits, scores, NONE)], axis=1)
        ids = np.concatenate([self.found[active], np.where(fits, ids, ANY)], axis=1)
        own = np.concatenate([self.own[active], own & fits], axis=1)
        best = np.lexsort((ids, ~scores), axis=1)[:, : self.scores.shape[1]]  # ~ turns the order round, without overflow
        for table, new in ((self.scores, scores), (self.found, ids), (self.own, own)):
            table[active] = np.take_along_axis(new, best, axis=1)


FOUND = "key long, id long, found long, score long, own boolean"


def _searched(queries: DataFrame, rows: DataFrame, most: int, same: bool, grid: tuple[int, int]) -> DataFrame:
    """The ``most`` best rows of each query in each stripe; ``queries`` (key, id, label, v) may have low and high."""
    ranged = "low" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, parts in by_tile(batches):
            r = pa.Table.from_batches(list(parts))  # at most a tree's rows
            ids, labels = r["id"].to_numpy(), r["label"].to_numpy()
            trees = {x.shape[1]: BallTree(x, ids[at], labels[at]) for at, x in matrices(r["v"])}
            of = {c: q[c].to_numpy() for c in ("key", "id", "label", *(("low", "high") if ranged else ()))}
            for at, x in matrices(q["v"]):
                if x.shape[1] not in trees:
                    continue
                window = (of["low"][at], of["high"][at]) if ranged else ()
                s = Search(x, of["id"][at], of["label"][at], most, same, *window)
                trees[x.shape[1]].search(s)
                n, k = np.nonzero((s.scores != NONE) | (s.found != ANY))
                yield pa.RecordBatch.from_pydict({"key": of["key"][at][n], "id": of["id"][at][n], "found": s.found[n, k], "score": s.scores[n, k], "own": s.own[n, k]})

    return tiles(queries, rows, *grid).mapInArrow(run, FOUND)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """Hard negatives of rows (id, label, v array<long>): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row for which ``anchor`` holds, its ``positives`` best other rows
    of the same label; for each of those the ``negatives`` best rows of other
    labels whose score is from ``least`` to ``most`` hundredths of the
    positive's. Higher scores come first, ties by smaller id.
    """
    good = rows.where(usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    good = stored(good.select(F.col("id").cast("long"), F.col("label").cast("long"), "v", F.coalesce(anchor, F.lit(False)).alias("anchor")), "rows")
    of = stored(good.where("anchor").select(F.monotonically_increasing_id().alias("key"), "id", "label", "v"), "anchors")
    good = good.select("id", "label", "v")
    n, n_anchors = good.count(), of.count()
    order = [F.desc("score"), F.col("found")]
    near = _searched(of, good, positives + 1, True, bounds(rows, n_anchors, n, BLOCK, STRIPE, TREE))
    near = merged(near, ["key"], order, positives).select(F.col("key").alias("anchor_key"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    near = stored(near.withColumn("key", F.monotonically_increasing_id()), "positives")
    # Whole hundreds and rest apart, so that nothing leaves 64 bits.
    p = F.col("positive_score")
    rest = F.pmod(p, F.lit(100))
    hundreds = F.expr("(positive_score - pmod(positive_score, 100)) div 100")
    low = hundreds * least + F.ceil(rest * least / 100).cast("long")
    high = hundreds * most + F.floor(rest * most / 100).cast("long")
    asked = near.join(of.withColumnRenamed("key", "anchor_key"), "anchor_key").select("key", "id", "label", "v", low.alias("low"), high.alias("high"))
    hard = _searched(asked, good, negatives, False, bounds(rows, n_anchors * positives, n, BLOCK, STRIPE, TREE))
    hard = merged(hard, ["key"], order, negatives).select("key", "rank", F.col("id").alias("anchor_id"), F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(near.select("key", "positive_id", "positive_score"), "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
