"""Vectors as rows: point sets, exact filtered top-k, and edge vectors.

Scores are dot products in double precision, rounded to six places, and ties
go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.tables import stored

from .blocks import bounds, by_tile, matrices, tiles

DIGITS = 6
#: Queries that are sent to all tasks together.
BLOCK = 4096


def dot(a: str, b: str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its length; null if that is zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def upsert(points: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Points with ``new`` in place of those with the same key."""
    return points.join(new, key, "left_anti").unionByName(new)


def write_collection(points: DataFrame, path: str) -> None:
    """Points (model_id, ...) as a collection with a folder for each model, so that a search reads one model's only."""
    points.write.mode("append").partitionBy("model_id").parquet(path)


def remove(points: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return points.join(gone, key, "left_anti")


def patch(points: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Payload columns of ``changes`` over those of the points; nulls change nothing, vectors stay."""
    fields = [c for c in changes.columns if c not in key]
    both = points.join(changes.select(*key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    return both.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).select(*points.columns)


def fetch(points: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """Points of the given ids; unknown ids are left out."""
    return points.join(ids, key, "left_semi")


def postings(points: DataFrame) -> DataFrame:
    """(company_id, unit_id, ..., key): an inverted index of active points by the units that may read them (``scope_ids``).

    Kept beside the points, so that a scope selects the lists of its units and
    no array of any other point is looked at.
    """
    live = points.where("lifecycle = 'active'")
    return live.select("company_id", F.explode(F.array_distinct("scope_ids")).alias("unit_id"), "sensitivity", "doc_id", "chunk_id")


def prefilter(index: DataFrame, scope: DataFrame, labels: list[str]) -> DataFrame:
    """(company_id, user_id, doc_id, chunk_id): what each reader of ``scope`` (company_id, user_id, unit_id) may find, once each."""
    lists = index.where(F.col("sensitivity").isin(labels))
    return lists.join(scope, ["company_id", "unit_id"]).select("company_id", "user_id", "doc_id", "chunk_id").distinct()


def over_fetch(limit: int, factor: int = 4, most: int = 10_000) -> int:
    """How many candidates to ask for so that enough remain after the gate."""
    return min(limit * max(1, factor), most)


def meet(points: DataFrame, queries: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Every point beside every query, or those that agree in the columns ``on``.

    Queries are counted and sent to all tasks in blocks of at most ``BLOCK``,
    so points stay where they are, whatever share of them one tenant has, and
    what is sent has a bound.
    """
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for k in range(blocks):
        some = F.broadcast(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k))
        pairs = points.join(some, on) if on else points.crossJoin(some)
        found = pairs if found is None else found.unionByName(pairs)
    return found


#: Rows of a stripe at least, rows of a product, pairs that a task holds before it drops the lesser ones.
STRIPE, ROWS, HELD = 2048, 2048, 1 << 21


def search(points: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best points (key, v) of each query (query_id, q), keys being long.

    Queries and points meet in a grid of tiles, so no pair becomes a row of
    its own. A tile is a matrix product; the pairs that may be among a query's
    k best are added up again as ``dot`` does, and each tile gives little more
    than k rows for a query. A pair without a score (null, or of two lengths)
    comes behind all others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, parts in by_tile(batches):
            ids = q["query_id"].to_numpy()
            found = {x.shape[1]: _Best(x, k) for _, x in matrices(q["q"])} if len(q) else {}
            where = {x.shape[1]: at for at, x in matrices(q["q"])}
            rest: dict[int, np.ndarray] = {d: np.zeros(0, np.int64) for d in found}
            blank = np.flatnonzero(q["q"].is_null().to_numpy(zero_copy_only=False) if q["q"].num_chunks else [])
            every = np.zeros(0, np.int64)
            for b in parts:
                keys = b["key"].to_numpy()
                known = b["v"].is_valid().to_numpy(zero_copy_only=False)
                every = np.sort(np.concatenate([every, keys]))[:k]
                met = np.full(len(keys), -1)
                for at, x in matrices(b["v"]):
                    at, x = at[known[at]], x[known[at]]
                    met[at] = x.shape[1]
                    if x.shape[1] in found:
                        found[x.shape[1]].meet(keys[at], x)
                for d in rest:
                    rest[d] = np.sort(np.concatenate([rest[d], keys[met != d]]))[:k]
            for d, best_ in found.items():
                mine = np.setdiff1d(np.arange(len(where[d])), np.searchsorted(where[d], blank[np.isin(blank, where[d])]))
                i, names, scores = best_.rows()
                ok = np.isin(i, mine)
                i, names, scores = i[ok], names[ok], scores[ok]
                yield _rows(ids[where[d]][i], names, scores)
                few = mine[np.bincount(i, minlength=len(where[d]))[mine] < k]
                if len(few) and len(rest[d]):
                    yield _rows(np.repeat(ids[where[d]][few], len(rest[d])), np.tile(rest[d], len(few)), None)
            if len(blank) and len(every):
                yield _rows(np.repeat(ids[blank], len(every)), np.tile(every, len(blank)), None)

    scored = _grid(points.select(F.col(key).cast("long").alias("key"), whole("v")), queries.select("query_id", whole("q"))).mapInArrow(run, "query_id long, key long, score double")
    return best(scored.select("query_id", F.col("key").alias(key), F.round("score", DIGITS).alias("score")), k, key)


def whole(v: str) -> Column:
    """The vector in double precision; null if it holds a null."""
    return F.when(F.forall(v, lambda x: x.isNotNull()), F.col(v).cast("array<double>")).alias(v)


def _grid(points: DataFrame, queries: DataFrame) -> DataFrame:
    queries = stored(queries.select(F.monotonically_increasing_id().alias("_q"), "*"), "queries")
    blocks, stripes = bounds(points, queries.count(), points.count(), BLOCK, STRIPE)
    # ``tiles`` deals queries by ``key``, which names points here.
    q = queries.withColumnRenamed("_q", "key")
    return tiles(q, points, blocks, stripes)


def _rows(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray | None) -> pa.RecordBatch:
    scores = pa.nulls(len(ids), pa.float64()) if scores is None else pa.array(scores, pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), scores], names=["query_id", "key", "score"])


def in_order(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of rows i of a and j of b, added up from the first component to the last."""
    out = np.zeros(len(i))
    step = max(1, (1 << 20) // max(1, a.shape[1]))
    for k in range(0, len(i) if a.shape[1] else 0, step):
        s = slice(k, k + step)
        out[s] = np.cumsum(a[i[s]] * b[j[s]], axis=1)[:, -1]
    return out


class _Best:
    """The best rows of each query of a tile; equal scores beyond k go by key, near ones stay for rounding to decide."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.size = np.sqrt((q * q).sum(axis=1)) if q.shape[1] else np.zeros(len(q))
        self.top = np.full((len(q), k), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def meet(self, keys: np.ndarray, x: np.ndarray) -> None:
        for a in range(0, len(keys), ROWS):
            self._meet(keys[a : a + ROWS], x[a : a + ROWS])

    def _meet(self, keys: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            near = self.q @ x.T
            near[~np.isfinite(near)] = np.inf  # decided by what is added up in order
            most = np.partition(near, -self.k, axis=1)[:, -self.k :] if len(keys) > self.k else near
            self.top = np.partition(np.concatenate([self.top, most], axis=1), -self.k, axis=1)[:, -self.k :]
            # Rounding moves a score by half a unit of the last place, adding up in another order by far less.
            slack = 2 * 10.0**-DIGITS + 1e-12 * self.size * np.sqrt((x * x).sum(axis=1).max(initial=0))
            need = self.top.min(axis=1) - np.where(np.isfinite(slack), slack, np.inf)
            i, j = np.nonzero(near >= np.where(np.isnan(need), -np.inf, need)[:, None])
            self.held.append((i, keys[j], in_order(self.q, x, i, j)))
        self.n += len(i)
        if self.n > HELD:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, score), the lesser ones dropped: at most k rows of each score, and none below the k-th by more than rounding can tell."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, keys, scores = (np.concatenate(c) for c in zip(*self.held))
        rank = np.where(np.isnan(scores), np.inf, scores)
        order = np.lexsort((keys, ~np.isnan(scores), -rank, i))
        i, keys, scores, rank = i[order], keys[order], scores[order], rank[order]
        at = np.arange(len(i))
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (rank[1:] != rank[:-1]) | (np.isnan(scores[1:]) != np.isnan(scores[:-1]))
        run = at - np.maximum.accumulate(np.where(new, at, 0))
        first = np.searchsorted(i, i)
        count = np.searchsorted(i, i, "right") - first
        kth = np.where(count >= self.k, rank[np.minimum(first + self.k - 1, len(i) - 1)], -np.inf)
        keep = (run < self.k) & (rank >= kth - 2 * 10.0**-DIGITS)
        self.held = [(i[keep], keys[keep], scores[keep])]
        self.n = int(keep.sum())
        return self.held[0]


def products(points: DataFrame, queries: DataFrame, carried: list[str]) -> DataFrame:
    """(query_id, carried..., score): ``dot`` of every point (carried..., v) with every query (query_id, q); null where lengths differ.

    As many rows as pairs, so this is as long as its result. They come from
    tiles in batches, and nothing of them is shuffled.
    """
    kinds = {f.name: f.dataType for f in points.schema}
    schema = ", ".join(["query_id long", *[f"{c} {kinds[c].simpleString()}" for c in carried], "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, parts in by_tile(batches):
            ids, q = q["query_id"], q["q"].combine_chunks()
            n, qs = len(ids), list(matrices(q))
            known = q.is_valid().to_numpy(zero_copy_only=False)
            for b in parts:
                for a in range(0, b.num_rows, 64):
                    part = b.slice(a, 64)
                    scores = np.zeros((part.num_rows, n))
                    good = np.zeros((part.num_rows, n), bool)
                    for at, x in matrices(part["v"]):
                        for to, y in qs:
                            if x.shape[1] == y.shape[1]:
                                out = np.zeros((len(at), len(to)))
                                for d in range(x.shape[1]):
                                    out += x[:, d][:, None] * y[:, d]
                                scores[np.ix_(at, to)] = out
                                good[np.ix_(at, to)] = True
                    good &= part["v"].is_valid().to_numpy(zero_copy_only=False)[:, None] & known
                    take = pa.array(np.repeat(np.arange(part.num_rows), n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(ids.to_numpy(), part.num_rows)), *[part[c].take(take) for c in carried], pa.array(scores.ravel(), mask=~good.ravel())], names=["query_id", *carried, "score"],
                    )

    points = points.select(*carried, whole("v"))
    return _grid(points, queries.select("query_id", whole("q"))).mapInArrow(run, schema)


def best(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The ``k`` rows of the highest score of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    # Spark pushes a limit on row_number below the shuffle.
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def share(mine: Column, other: Column) -> Column:
    """Authority shares: clamped to 0..100, at least 10 each, unless both are equal."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    floor = lambda c: F.greatest(F.lit(10.0), clamp(c).cast("double"))
    return floor(mine) / (floor(mine) + floor(other))


def edge_vectors(edges: DataFrame, weight: float = 0.65) -> DataFrame:
    """Adds ``vector`` and ``outcome`` to edges with both endpoint vectors and the type's.

    Needs auth_s, auth_t, v_s, v_t, v_type. The endpoints count by their
    authority, together ``weight``; the type counts for the rest.
    """
    s = share(F.col("auth_s"), F.col("auth_t"))
    t = share(F.col("auth_t"), F.col("auth_s"))
    parts = F.arrays_zip("v_s", "v_t", "v_type")
    mixed = F.transform(parts, lambda p: (weight * (s * p["v_s"] + t * p["v_t"]) + (1 - weight) * p["v_type"]).cast("float"))
    whole = F.col("v_s").isNotNull() & F.col("v_t").isNotNull()
    same = (F.size("v_s") == F.size("v_t")) & (F.size("v_s") == F.size("v_type"))
    outcome = F.when(~whole, "missing endpoint vector").when(F.col("v_type").isNull(), "missing type vector").when(~same, "dimensions differ").when(norm(F.col("mixed")) == 0, "zero vector").otherwise("completed")
    out = edges.withColumn("mixed", F.when(whole & same, mixed)).withColumn("outcome", outcome)
    return out.withColumn("vector", F.when(F.col("outcome") == "completed", unit(F.col("mixed")))).drop("mixed")


def index_edges(events: DataFrame, live: DataFrame, models: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, points) of events (event_id, edge_id, model_id) that ask for the points of edges to be made.

    ``live`` has the edges with ``edge_version`` and what ``edge_vectors``
    needs, ``models`` (model_id, enabled), ``indexed`` the points so far
    (edge_id, model_id, indexed_version, vector). An edge that is gone is
    NoEdge; one whose version is indexed already, Superseded, and nothing is
    computed for it; a model without a collection, ModelDisabled; one that
    lacks a vector waits (retry). The rest is Completed, once for each edge and
    model however many events ask, and its point takes the place of an older one.
    """
    e = events.join(live.select("edge_id", "edge_version"), "edge_id", "left")
    e = e.join(indexed.select("edge_id", "model_id", "indexed_version"), ["edge_id", "model_id"], "left").join(models.select("model_id", "enabled"), "model_id", "left")
    before = F.when(F.col("edge_version").isNull(), "NoEdge").when(F.col("indexed_version") >= F.col("edge_version"), "Superseded").when(~F.coalesce("enabled", F.lit(False)), "ModelDisabled")
    e = e.withColumn("_before", before)
    todo = e.where("_before is null").select("edge_id", "model_id").distinct()
    made = edge_vectors(todo.join(live, "edge_id")).select("edge_id", "model_id", F.col("edge_version").alias("indexed_version"), "vector", F.when(F.col("outcome") == "completed", "Completed").otherwise(F.concat(F.lit("retry: "), "outcome")).alias("_made"))
    outcomes = e.join(made.select("edge_id", "model_id", "_made"), ["edge_id", "model_id"], "left").select(*events.columns, F.coalesce("_before", "_made").alias("outcome"))
    new = made.where("_made = 'Completed'").drop("_made")
    return outcomes, upsert(indexed.select(*new.columns), new, ["edge_id", "model_id"])


def search_edges(points: DataFrame, queries: DataFrame, states: list[str], least: float, k: int) -> DataFrame:
    """As ``search`` over edge vectors, by review state and least confidence (six places)."""
    found = points.where(F.col("review_state").isin(states))
    if least > 0:
        found = found.where(F.round(F.col("confidence").cast("double"), 6) >= round(least, 6))
    return search(found, queries, k, "edge_id")


def revise_types(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Type vectors after an upsert: revision 1, or one more where text or vector changed."""
    both = registry.alias("r").join(new.alias("n"), "edge_type", "full")
    same = F.col("r.text").eqNullSafe(F.col("n.text")) & F.col("r.v").eqNullSafe(F.col("n.v"))
    revision = F.when(F.col("r.revision").isNull(), 1).when(F.col("n.text").isNull() | same, F.col("r.revision")).otherwise(F.col("r.revision") + 1)
    return both.select("edge_type", F.coalesce("n.text", "r.text").alias("text"), F.coalesce("n.v", "r.v").alias("v"), revision.alias("revision"))


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; late ones change nothing."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), version).alias("x")).select(*key, "x.*")
