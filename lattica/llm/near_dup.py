"""Near-duplicates: MinHash signatures and a multi-index Hamming join.

A document is the set of its word shingles. Documents with equal sets are one
class. Each class gets a signature of ``POSITIONS`` minima of 8 bits. Two sets
of similarity s differ in each position with a chance of at most 1 - s.

The join finds every pair of signatures that differ in at most ``DISTANCE``
positions: the positions are split into ``CHUNKS`` chunks, and since
``2 * CHUNKS > DISTANCE`` some chunk differs in one position at most. So each
chunk, with each of its positions masked in turn, is a key, and two signatures
within the distance share a key. A pair beyond the distance is found too
unless every chunk differs twice; at s = 0.8 the chance to lose a pair is
below 1e-5, and it falls fast with s. Candidates are compared by signature,
with ``LIMIT`` positions of tolerance (beyond it at s = 0.8: about 2e-6), and
then confirmed on the full sets.

Keys are handled without forming all pairs of a group of copies:

1. For each key its least class is its hub. Each class is compared with its
   hubs only. What is confirmed makes components. ``ROUNDS`` more rounds with
   other hubs follow for keys that still hold more than one component.
2. What is left are keys with several components. Such a key belongs to its
   least component; per component, the classes outside it (strays) are
   compared with those classes of its keys whose sizes allow the similarity
   (bands of sizes, each with its neighbours), in blocks of at most ``BLOCK``
   classes and ``BLOCK_BYTES``: first by signature, and what may reach the
   similarity by full sets. A pair within a component couldn't change the
   result any more, and components only grow, so after this nothing is left.
   In this step a row has at most three times as many copies as its component
   has blocks of the other side in a band.

Sets are compared as sets of 64-bit hashes of shingles. Two texts count as
copies if 128 bits of hashes of their sets are equal.

So a group of n like documents costs about n comparisons, while documents of
different components that share a key are always compared; those comparisons
happen inside tasks and don't become rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

POSITIONS, CHUNKS, DISTANCE, LIMIT, ROUNDS = 64, 11, 21, 28, 1
BLOCK, BLOCK_BYTES, SALTS = 512, 4 << 20, 16
#: So many rows of a few numbers may be sent to all tasks.
SENT = 200_000
#: Words that a worker remembers before it begins anew.
CACHE = 150_000
_MULTIPLY = np.random.default_rng(7).integers(1, 2**32, POSITIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_MIX = np.random.default_rng(11).integers(1, 2**32, POSITIONS, dtype=np.uint64).astype(np.uint32)


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles.

    Words are runs of anything but the six ASCII white-space characters, with
    A-Z lowered. A text of fewer than ``n`` words (but one at least) is one
    shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], dtype=np.uint64)
    size = min(n, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        total = _scramble(total * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(total)


def signature(hashes: np.ndarray) -> bytes:
    """The low byte of the least value under each of ``POSITIONS`` hash functions."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 2**32 - 1, np.uint32)
    for k in range(0, len(low), 8192):  # bounded memory for very long texts
        part = (low[k : k + 8192] ^ _MIX[:, None]) * _MULTIPLY[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    # A product's high bits are the better mixed ones.
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


SETS = "doc_id long, row long, n_shingles long, set_hash long, set_check long, signature binary"


def signed(docs: DataFrame, words: int, row: str | None = None) -> DataFrame:
    """Size, two hashes and signature of every document's shingle set, with its number ``row`` if it has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in small(batches):
            if len(known) > CACHE:
                known.clear()
            got = [shingles(t, words, known) for t in b["text"].to_pylist()]
            raw = [g.tobytes() for g in got]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b["doc_id"],
                "row": b["row"],
                "n_shingles": pa.array(list(map(len, got)), pa.int64()),
                "set_hash": pa.array([xxhash.xxh3_64_intdigest(r) - 2**63 for r in raw], pa.int64()),
                "set_check": pa.array([xxhash.xxh64_intdigest(r, 5) - 2**63 for r in raw], pa.int64()),
                "signature": pa.array([signature(g) if len(g) else None for g in got], pa.binary()),
            })

    number = F.lit(None) if row is None else F.col(row)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.cast("long").alias("row"), "text").mapInArrow(run, SETS)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, hashes): the sorted shingle hashes of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in small(batches):
            if len(known) > CACHE:
                known.clear()
            got = [shingles(t, words, known).tobytes() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(got, pa.binary())], names=["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, hashes binary")


def _chunks(positions: int = POSITIONS, chunks: int = CHUNKS) -> list[range]:
    ends = [positions * k // chunks for k in range(chunks + 1)]
    return [range(a, b) for a, b in zip(ends, ends[1:])]


def keys_of(signatures: DataFrame) -> DataFrame:
    """(key, id): every chunk with each of its positions masked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = [np.random.default_rng(p).integers(1, 2**63, 256, dtype=np.uint64) for p in range(POSITIONS)]
        for b in batches:
            sigs = np.frombuffer(b"".join(b["signature"].to_pylist()), np.uint8).reshape(-1, POSITIONS)
            each = np.stack([salt[p][sigs[:, p]] for p in range(POSITIONS)], axis=1) if len(sigs) else np.zeros((0, POSITIONS), np.uint64)
            out = np.empty_like(each)
            for chunk in _chunks():
                whole = np.bitwise_xor.reduce(each[:, chunk.start : chunk.stop], axis=1)
                for p in chunk:
                    out[:, p] = _scramble((whole ^ each[:, p]) + np.uint64(p * 0x632BE59BD9B4E019 % 2**64))
            ids = np.repeat(b["id"].to_numpy(), POSITIONS)
            yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return signatures.select("id", "signature").mapInArrow(run, "key long, id long")


def alike(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the wanted similarity."""
    about = members.select("id", "n_shingles", "signature")
    pairs = pairs.join(about.toDF("a", "na", "sa"), "a").join(about.toDF("b", "nb", "sb"), "b")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, POSITIONS) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= LIMIT))

    return pairs.mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` of their union in common.

    Only the texts that ``pairs`` names are read into sets once more.
    """
    # Written, so that Spark's own size check chooses the kind of join.
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    full = full_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), words)
    pairs = pairs.join(full.toDF("a", "ha"), "a").join(full.toDF("b", "hb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b["ha"], b["hb"]):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _spread(rows: DataFrame, facts: DataFrame, on: list[str], by: Column, most: int) -> DataFrame:
    """``rows`` with the one row of ``facts``, of at most ``most`` rows, for their ``on``.

    Up to ``SENT`` facts are sent to all tasks, some 10 MB. Beyond that the
    rows of a frequent key meet copies of its fact in ``SALTS`` tasks. Such
    copies are small when shuffled and large in memory, so Spark's size check
    would send too many to the driver: that join is by merging.
    """
    if most <= SENT:
        return rows.join(F.broadcast(facts), on)
    facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    return rows.join(facts.hint("merge"), [*on, "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the least id that each linked id reaches.

    Large-star and small-star steps alternate until nothing changes; each round
    is stored, so a lost executor costs one round at most.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        nodes = 2 * edges.count()  # at most
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Large star: larger neighbours go to the least one.
        large = _spread(both.where("v > u"), least, ["u"], F.xxhash64("v"), nodes).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours and the node itself go to the least one.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _spread(large, lowest, ["u"], F.xxhash64("v"), nodes)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small, "edges")
        # Stars are the fixed points: every edge leads to a node that has none to a lesser one.
        if edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            return edges.toDF("id", "component")


def link(docs: DataFrame, words: int = 5, percent: int = 80, row: str | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked if their sets of ``words``-word shingles have at least
    ``percent`` per cent of their union in common. ``component_id`` is the
    least doc_id that is reachable. Null and empty texts have no shingles and
    are linked with nothing. Rows that share a doc_id count as one document
    per text (each gets a row); a null doc_id is its own component, null.
    Other columns are ignored; an empty input gives an empty result. ``row``
    names a column of unique numbers; then each result has it too, as ``row``,
    and ``repeats``: whether a row of a lower number has the same doc_id and
    the same words (null doc_ids and texts without words repeat nothing).
    """
    all_sets = stored(signed(docs, words, row), "sets")
    full = all_sets.where("n_shingles > 0 and doc_id is not null")
    # Equal sets are one class, named by its least doc_id; copies end here.
    first = ["set_hash", "set_check", "n_shingles"]
    named = stored(full.groupBy(*first).agg(F.min("doc_id").alias("id")), "classes")
    members = full.join(named.withColumnRenamed("id", "doc_id"), [*first, "doc_id"]).dropDuplicates([*first, "doc_id"])
    members = stored(members.select(F.col("doc_id").alias("id"), "n_shingles", "signature"), "members")
    found = components(near_links(members, docs, words, percent))
    by_class = named.join(found, "id", "left").select(*first, F.coalesce("component", "id").alias("component"))
    rows = all_sets.join(by_class, first, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = [F.col("doc_id"), F.col("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")]
    if row is None:
        return rows.select(*out)
    again = full.groupBy("doc_id", *first).agg(F.min("row").alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(stored(again, "again"), ["doc_id", *first], "left")
    return rows.select(*out, "row", F.coalesce(F.col("row") > F.col("_least"), F.lit(False)).alias("repeats"))


def _mixed(keys: DataFrame, links: DataFrame | None, turn: int) -> DataFrame:
    """(key, id, part, low, hub, hub_part) for keys that hold several components."""
    if links is None:
        part = keys.withColumn("part", F.col("id"))
    else:
        part = keys.join(components(links), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    # The first hub of a key is its least class, later ones depend on the turn.
    order = F.xxhash64("id", F.lit(turn)) if turn else F.lit(0)
    mixed = part.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct(order.alias("o"), "id", "part")).alias("hub")).where("low < high")
    return part.join(mixed.select("key", "low", F.col("hub.id").alias("hub"), F.col("hub.part").alias("hub_part")), "key")


def near_links(members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect all that is linked."""
    keys = keys_of(members)
    several = keys.groupBy("key").count().where("count > 1").select("key")
    keys = stored(keys.join(several, "key"), "keys")
    links = tried = None
    for turn in range(ROUNDS + 1):
        pairs = _mixed(keys, links, turn).where("part <> hub_part").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(alike(pairs, members, percent), "alike")
        tried = pairs if tried is None else tried.union(pairs)
        new = confirm(pairs, docs, words, percent)
        links = stored(new if links is None else links.union(new), "links")
    # Each class once for each component that owns a key of it.
    owned = _mixed(keys, links, 0).groupBy("low", "id", "part").agg(F.lit(1).alias("n")).drop("n")
    # Sizes in one band differ by less than the similarity allows, so a partner
    # is in the same band or beside it.
    band = F.floor(F.ln("n_shingles") / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n_shingles").cast("int")
    owned = stored(owned.join(members, "id").select("low", "id", "part", "n_shingles", "signature", band.alias("band")), "owned")
    likely = _in_blocks(owned, F.lit(POSITIONS), lambda rows: _survivors(rows, percent), "low long, id long")
    likely = stored(owned.join(likely.distinct(), ["low", "id"], "left_semi").select("low", "id", "part", "signature", "band"), "likely")
    ids = stored(likely.select(F.col("id").alias("doc_id")).distinct(), "ids")
    full = full_sets(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), words)
    last = _in_blocks(likely.join(full, "id"), F.octet_length("hashes"), lambda rows: _linked(rows, percent), "a long, b long")
    return stored(links.union(last), "links")


def _in_blocks(rows: DataFrame, size: Column, run, schema: str) -> DataFrame:
    """Call ``run`` on each block of strays of a component with each block of all its classes.

    ``rows`` is (low, id, part, band, ...); strays are not of the component
    ``low``. Only bands of sizes that lie beside each other meet.
    """
    # A class (side 1) lies in its own band; a stray (side 0) also meets the bands beside its own.
    own = F.array(F.struct(F.lit(1).alias("_side"), F.col("band").alias("_band")))
    strays = F.array(*[F.struct(F.lit(0).alias("_side"), (F.col("band") + k).alias("_band")) for k in (-1, 0, 1)])
    sided = rows.withColumn("_at", F.explode(F.when(F.col("part") != F.col("low"), F.concat(own, strays)).otherwise(own)))
    sided = stored(sided.select(*rows.columns, size.cast("long").alias("_size"), "_at.*"), "sided")
    group = ["low", "_band"]
    each = lambda k: F.greatest(F.ceil(F.count_if(F.col("_side") == k) / BLOCK), F.ceil(F.sum(F.when(F.col("_side") == k, F.col("_size")).otherwise(0)) / BLOCK_BYTES), F.lit(1))
    # A band needs both sides.
    blocks = sided.groupBy(*group).agg(each(0).alias("_x"), each(1).alias("_y"), (F.min("_side") != F.max("_side")).alias("_both")).where("_both").drop("_both")
    # A large component's blocks are dealt one by one, not by component.
    placed = _spread(sided, blocks, group, F.xxhash64("id", F.lit(1)), sided.count())
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("_side") == 0, F.col("_x")).otherwise(F.col("_y"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("_side") == 0, F.col("_y")).otherwise(F.col("_x")).cast("int") - 1)
    placed = placed.withColumn("_mine", mine).withColumn("_other", F.explode(others))
    bx = F.when(F.col("_side") == 0, F.col("_mine")).otherwise(F.col("_other"))
    by = F.when(F.col("_side") == 0, F.col("_other")).otherwise(F.col("_mine"))
    placed = placed.withColumns({"_bx": bx, "_by": by}).select(*rows.columns, "_side", "_band", "_bx", "_by")
    return placed.repartition(*group, "_bx", "_by").groupBy(*group, "_bx", "_by").applyInArrow(run, schema)


def _sides(rows: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Strays, all classes, and which pairs may be alike by signature and aren't connected yet."""
    rows = rows.combine_chunks()
    side = rows["_side"].to_numpy()
    x, y = (rows.filter(pa.array(side == k)) for k in (0, 1))
    sx, sy = (np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint8).reshape(-1, POSITIONS) for t in (x, y))
    px, py, ix, iy = (t[c].to_numpy() for c in ("part", "id") for t in (x, y))
    may = px[:, None] != py[None, :]
    # Two strays meet twice; once is enough.
    both = (px != x["low"].to_numpy())[:, None] & (py != y["low"].to_numpy())[None, :]
    may &= ~both | (ix[:, None] < iy[None, :])
    far = np.zeros(may.shape, np.uint8)
    for k in range(POSITIONS):
        far += sx[:, k, None] != sy[None, :, k]
    return x, y, may & (far <= LIMIT)


def _survivors(rows: pa.Table, percent: int) -> pa.Table:
    x, y, may = _sides(rows)
    nx, ny = (t["n_shingles"].to_numpy() for t in (x, y))
    may &= 100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :])
    ids = np.concatenate([x["id"].to_numpy()[may.any(axis=1)], y["id"].to_numpy()[may.any(axis=0)]])
    return pa.table({"low": pa.array(np.full(len(ids), rows["low"][0].as_py() if len(ids) else 0)), "id": pa.array(ids)})


def _linked(rows: pa.Table, percent: int) -> pa.Table:
    """One link for each stray and each component that it belongs to."""
    x, y, may = _sides(rows)
    of_y = [np.frombuffer(v.as_buffer(), np.uint64) for v in y["hashes"]]
    ny = np.array([len(v) for v in of_y])
    all_y, ends = (np.concatenate(of_y) if of_y else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(ny)])
    before = np.zeros(len(all_y) + 1, np.int32)
    part, ids, a, b = y["part"].to_numpy(), y["id"].to_numpy(), [], []
    for k in np.flatnonzero(may.any(axis=1)):
        mine = np.frombuffer(x["hashes"][int(k)].as_buffer(), np.uint64)
        at = np.flatnonzero(may[k])
        if 4 * len(at) < len(ny):
            common = np.array([np.isin(of_y[j], mine, assume_unique=True).sum() for j in at])
        else:
            place = np.searchsorted(mine, all_y)
            np.minimum(place, len(mine) - 1, out=place)
            before[1:] = np.cumsum(mine[place] == all_y, dtype=np.int32)
            common = np.diff(before[ends])[at]
        good = at[100 * common >= percent * (len(mine) + ny[at] - common)]
        _, first = np.unique(part[good], return_index=True)
        a += [x["id"][int(k)].as_py()] * len(first)
        b += ids[good[first]].tolist()
    pa.default_memory_pool().release_unused()  # a worker goes on to groups of other sizes
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
