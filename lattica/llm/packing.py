"""Best-fit packing by linear grouping.

Documents become token pieces of at most ``CAPACITY`` tokens; then only the
number of pieces of each length matters, at most ``CAPACITY`` numbers however
many documents there are. On these the plan is made:

* lengths from ``LARGE`` on are rounded up within groups of equal cardinality;
* column generation finds the few configurations of group sizes that together
  hold all groups in the fewest sequences (knapsack pricing, then rounding
  down; what is left is packed by best fit);
* real lengths take the places of the rounded ones, longest first;
* smaller lengths go by best fit, longest first, into what room is left.

All of it works on (pattern, times) runs, so the plan's size depends on the
number of lengths and not on the number of documents. Spark then numbers the
pieces of each length, in parts of bounded size, and each finds its place in
the plan by its number.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_symbols
from .common import small, stored

CAPACITY, LARGE, GROUPS, ROUNDS = 2048, 400, 32, 200
#: Tokens of room with which a sequence counts as full.
SLACK = 2
#: Chunks of text that a worker remembers before it begins anew.
CACHE = 200_000
#: A space beside other white space: then chunks can't be taken one by one.
RUNS = re.compile(r"\s | \s|<\||[\x00\x1c-\x1f\u0250-\U0010ffff]")
#: Fixed value: how byte-level vocabularies of this family cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Token ids of texts, as little-endian 32-bit bytes.

    A byte-level pre-tokenizer never joins across a space that stands alone
    (such a space opens the next piece), so chunks "space and what follows"
    can be encoded once and remembered; the same vocabulary in a faster
    library does that. Texts with runs of white space, with what may be a
    special token, or with characters that the two libraries may class
    differently (from U+0250 on) go to the tokenizers library whole. Both ways
    give the same ids; the tests compare all characters below U+0250.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        value = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(value[c] for c in t): i for t, i in vocab.items()}
        self.chunk = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in got]

    def batch(self, texts: list[str]) -> list[bytes]:
        split, whole = [], []
        for k, t in enumerate(texts):
            if RUNS.search(t):
                whole.append(k)
                split.append(None)
            else:
                split.append(t.replace(" ", "\0 ").split("\0"))
        known, chunk = self.known, self.chunk
        if len(known) > CACHE:
            known.clear()
        for s in split:
            if s:
                for c in s:
                    if c not in known:
                        known[c] = array("I", chunk(c)).tobytes()
        out = [b"".join(map(known.__getitem__, s)) if s else b"" for s in split]
        for k, ids in zip(whole, self.encode([texts[k] for k in whole])):
            out[k] = ids
        return out


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END = b"\0\0\0\0"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (``doc_id``, ``text``): its ids, then id 0, cut if over ``capacity``.

    All pieces of a cut document are full but the first. A null or empty text
    is one piece of one token. Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(tokenizer)
        for b in small(batches):
            rows = []
            for doc, ids in zip(b["doc_id"].to_pylist(), encoder.batch([t or "" for t in b["text"].to_pylist()])):
                ids += END
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                ends = range(first, n + 1, capacity)
                for k, end in enumerate(ends):
                    start = 0 if k == 0 else ends[k - 1]
                    rows.append((doc, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(how many of each size, times) whose sum holds at most ``counts``, near the optimum.

    Column generation on the covering program; its basis is kept as a matrix
    and the best new column comes from an unbounded knapsack. It stops when no
    column improves it, after ``rounds`` columns at the latest; what it leaves
    over is packed by best fit, so nothing is lost by stopping early.
    """
    m = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(counts, dtype=float)
    weight = np.array(sizes)
    use = np.linalg.solve(basis, need)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(m))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(min(sizes), capacity + 1):
            gain = np.where(weight <= c, best[np.maximum(c - weight, 0)] + price, -1)
            k = int(gain.argmax())
            best[c], last[c] = (gain[k], k) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] < 1 + 1e-7:
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        use = np.linalg.solve(basis, need)
    left, found = np.array(counts, dtype=np.int64), []
    for k in np.argsort(-use):
        column = basis[:, k].round().astype(np.int64)
        times = int(use[k] + 1e-7)
        if column.any():
            times = min(times, int((left[column > 0] // column[column > 0]).min()))
        if times > 0 and column.any():
            found.append((tuple(int(x) for x in column), times))
            left -= column * times
    return found


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, times) that together hold ``histogram`` exactly."""
    runs: list[tuple[tuple[int, ...], int]] = []
    left = dict(histogram)
    # Full pieces have no room beside them.
    if left.get(capacity):
        runs.append(((capacity,), left.pop(capacity)))
    big = sorted((n for n in left if n >= large and left[n] > 0), reverse=True)
    total = sum(left[n] for n in big)
    if total:
        by_group: dict[int, list[int]] = defaultdict(list)
        at = 0
        for n in big:
            by_group[at * groups // total].append(n)
            at += left[n]
        members = list(by_group.values())
        sizes = [m[0] for m in members]
        for column, times in configurations(sizes, [sum(left[n] for n in m) for m in members], capacity):
            slots = [g for g, many in enumerate(column) for _ in range(many)]
            while times > 0:
                # The longest real length left in each slot's group, for as
                # many sequences as all of these lengths last.
                taken: dict[int, int] = defaultdict(int)
                chosen = []
                for g in slots:
                    n = next(n for n in members[g] if left[n] > taken.get(n, 0))
                    taken[n] += 1
                    chosen.append(n)
                run = min([times, *(left[n] // many for n, many in taken.items())])
                for n, many in taken.items():
                    left[n] -= many * run
                runs.append((tuple(chosen), run))
                times -= run
    packed = best_fit(runs, left, capacity)
    # Rounding leaves room in some sequences that no small length can use.
    # Those sequences are opened once more and their pieces packed by best fit.
    full = [(p, t) for p, t in packed if capacity - sum(p) <= SLACK]
    opened: dict[int, int] = defaultdict(int)
    for p, t in packed:
        if capacity - sum(p) > SLACK:
            for n in p:
                opened[n] += t
    again = best_fit(full, opened, capacity)
    return min(packed, again, key=lambda runs: sum(t for _, t in runs))


def best_fit(runs, left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Put what is left, longest first, each into the fullest sequence that has room."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for pattern, times in runs:
        open_[capacity - sum(pattern)][pattern] += times
    rooms = sorted(r for r in open_)

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if not open_[room]:
            bisect.insort(rooms, room)
        open_[room][pattern] += times

    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        todo = left[n]
        while todo:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                # New sequences, each as full of this length as it gets.
                each = capacity // n
                if todo >= each:
                    put(capacity - each * n, (n,) * each, todo // each)
                if todo % each:
                    put(capacity - todo % each * n, (n,) * (todo % each), 1)
                break
            room = rooms[k]
            pattern, times = next(iter(open_[room].items()))
            # One more piece each; several at once where many go into few.
            each = max(1, min(room // n, todo // times))
            some = min(times, todo // each)
            open_[room][pattern] -= some
            if not open_[room][pattern]:
                del open_[room][pattern]
            if not open_[room]:
                rooms.pop(k)
            put(room - each * n, pattern + (n,) * each, some)
            todo -= each * some
    return [(p, t) for by in open_.values() for p, t in by.items()]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first number, first sequence and offset of each run of its pieces."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    number: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            found[n].append((number[n], sequence, offset))
            number[n] += times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for n, v in found.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; needs ``length`` from 1 to ``capacity``.

    Any further columns stay. Pieces of equal length are interchangeable and
    are numbered in an arbitrary order, in parts of at most a quarter of an
    even task's rows, so a length that a third of all pieces have is spread
    over many tasks. An empty input gives an empty result.
    """
    cut = cut.drop("sequence_id", "offset")
    spark = cut.sparkSession
    cut = stored(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # At most ``capacity`` rows.
    histogram = {r.length: r.rows for r in cut.groupBy("length").agg(F.count("*").alias("rows")).collect()}
    at = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    rows_per_part = max(1, sum(histogram.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    parts = spark.createDataFrame([(n, max(1, -(-c // rows_per_part))) for n, c in histogram.items()], "length long, _parts long")
    rows = cut.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).drop("_parts")
    part = ["length", "_part"]
    sizes = rows.groupBy(*part).agg(F.count("*").alias("_rows"))
    sizes = sizes.withColumn("_first", F.sum("_rows").over(Window.partitionBy("length").orderBy("_part")) - F.col("_rows")).drop("_rows")
    number = F.row_number().over(Window.partitionBy(*part).orderBy("_row")) - 1
    rows = rows.withColumn("_n", number).join(sizes, part).withColumn("_n", F.col("_first") + F.col("_n"))
    rows = rows.select(*[c for c in cut.columns if c != "_row"], F.col("_n").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, n = b["length"].to_numpy(), b["_n"].to_numpy()
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(length):
                these = np.flatnonzero(length == size)
                first, start, off = at.value[int(size)]
                k = np.searchsorted(first, n[these], side="right") - 1
                sequence[these], offset[these] = start[k] + n[these] - first[k], off[k]
            keep = [c for c in b.schema.names if c != "_n"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_n")
    return rows.mapInArrow(run, f"{fields}, sequence_id long, offset long")
