"""Transcript parsing by a hidden Markov model, and canonical turns.

Each line of a transcript is the first or a later line of a turn of some role;
those six are the states. What is seen of a line is its speaker marker, its
length, whether it asks and whether it is a list item. The model's tables are
counted from labelled lines; the most likely states (Viterbi) give roles and
turn borders, also where markers are missing or misleading.

No conversation and no turn must fit into one task. Lines and turns are numbered
by sums over ranges of rows. Lines are decoded in blocks of ``BLOCK`` lines: a
block's best scores from each state before it to each state at its end form a
matrix; matrices of ``FAN`` neighbours combine into one, level by level, until
each conversation has one; then the best states at the borders go down the
levels, and each block is decoded between its two known states. A turn is
rendered in pieces that end at every ``PIECE``-th line of the conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import earlier, stored

ROLES = ("system", "user", "assistant")
#: States: first line of a role's turn (0 to 2), later line of it (3 to 5); 6 stands before the start.
STATES, START = 6, 6
BLOCK, FAN, PIECE = 256, 64, 1024
#: Names that mark a speaker at the start of a line.
MARKERS = {"system": "System|Instructions", "user": "User|Human|Customer|Q", "assistant": "Assistant|Bot|AI|Agent|A"}
CODES = 5 * 5 * 2 * 2


def any_marker() -> str:
    return r"^\s*[\[(*#]{0,3}(?:" + "|".join(MARKERS.values()) + r")[\])*]{0,3}\s*[:>]\s*"


def code(line: Column) -> Column:
    """What is seen of a line, as one number below ``CODES``."""
    of = lambda names: line.rlike(r"(?i)^\s*[\[(*#]{0,3}(?:" + names + r")[\])*]{0,3}\s*[:>]")
    marker = F.when(of(MARKERS["system"]), 1).when(of(MARKERS["user"]), 2).when(of(MARKERS["assistant"]), 3).when(line.rlike(r"^\S{1,20}:\s"), 4).otherwise(0)
    n = F.length(line)
    size = F.when(n == 0, 0).when(n < 40, 1).when(n < 100, 2).when(n < 200, 3).otherwise(4)
    asks = line.rlike(r"\?\s*$").cast("int")
    item = line.rlike(r"^\s*([-*+]|\d+[.)])\s").cast("int")
    return F.coalesce(((marker * 5 + size) * 2 + asks) * 2 + item, F.lit(0)).cast("int")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, row, line_no, is_first, line): the lines of texts that follow each other by ``part``.

    ``turns`` (row, conv_id, part, text): ``row`` is unique, ``conv_id`` isn't
    null. Null texts are one empty line. Parts with equal numbers follow each
    other by a hash of their text.
    """
    text = F.coalesce("text", F.lit(""))
    counts = turns.select("row", "conv_id", F.coalesce("part", F.lit(-1).cast("long")).alias("part"), F.xxhash64(text).alias("_hash"), F.size(F.split(text, "\n", -1)).alias("_lines"))
    first = earlier(counts, ["conv_id"], ["part", "_hash", "row"], "_lines", "_first").select("row", "_first")
    lines = turns.join(first, "row").select("conv_id", "row", "_first", F.posexplode(F.split(text, "\n", -1)).alias("_k", "line"))
    return lines.select("conv_id", "row", (F.col("_first") + F.col("_k")).cast("long").alias("line_no"), (F.col("_k") == 0).alias("is_first"), "line")


@dataclass
class Hmm:
    step: np.ndarray  # (7, 6): log chance of a state after another, or at the start
    seen: np.ndarray  # (6, CODES): log chance of what is seen in a state


def fit(lines: DataFrame) -> Hmm:
    """Count ``line`` and ``role`` (with ``is_first``) of labelled lines.

    Roles other than the three don't count. Only tables of states and codes
    reach the driver. Without lines all states are alike.
    """
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    rows = lines.withColumn("_s", F.when(F.col("is_first"), role).otherwise(role + 3).cast("int")).where("_s between 0 and 5")
    rows = rows.select("conv_id", "line_no", "_s", code(F.col("line")).alias("_c"), F.floor(F.col("line_no") / BLOCK).alias("_b"))
    before = F.lag("_s").over(Window.partitionBy("conv_id", "_b").orderBy("line_no"))
    before = F.when(F.col("line_no") == 0, F.lit(START)).otherwise(before)
    counts = rows.withColumn("_p", before).groupBy("_p", "_s", "_c").count()
    step, seen = np.full((7, STATES), 0.5), np.zeros((STATES, CODES))
    for r in counts.collect():  # at most 8 x 6 x CODES rows
        seen[r._s, r._c] += r["count"]
        if r._p is not None:
            step[r._p, r._s] += r["count"]
    # Features are independent given the state.
    table = seen.reshape(STATES, 5, 5, 2, 2)
    total = np.zeros(table.shape)
    for axis in range(1, 5):
        others = tuple(a for a in range(1, 5) if a != axis)
        m = table.sum(axis=others, keepdims=True) + 0.5
        total += np.log(m / m.sum(axis=axis, keepdims=True))
    # A later line belongs to the turn of the line before it.
    allowed = np.zeros((7, STATES), dtype=bool)
    allowed[:, :3] = True
    for s in range(3):
        allowed[[s, s + 3], s + 3] = True
    step = np.where(allowed, step, 0)
    with np.errstate(divide="ignore"):
        return Hmm(np.log(step / step.sum(axis=1, keepdims=True)), total.reshape(STATES, CODES))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in which sums are maxima and products sums."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _matrix(codes: list[int], hmm: Hmm) -> np.ndarray:
    """Best scores from each state before the lines to each state at the last."""
    m = hmm.step + hmm.seen[:, codes[0]]
    for c in codes[1:]:
        m = _times(m, hmm.step[:STATES] + hmm.seen[:, c])
    return m


def _decode(codes: list[int], hmm: Hmm, entry: int, last: int) -> list[int]:
    at = hmm.step[entry] + hmm.seen[:, codes[0]]
    back = []
    for c in codes[1:]:
        all_ = at[:, None] + hmm.step[:STATES]
        back.append(all_.argmax(axis=0))
        at = all_.max(axis=0) + hmm.seen[:, c]
    path = [last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _shaped(flat) -> np.ndarray:
    return np.array(flat).reshape(7, STATES)


def _chain(matrices: list[np.ndarray], entry: int, last: int) -> list[tuple[int, int]]:
    """The states at the borders of consecutive parts, between two known ones."""
    at, back = matrices[0][entry], []
    for m in matrices[1:]:
        all_ = at[:, None] + m[:STATES]
        back.append(all_.argmax(axis=0))
        at = all_.max(axis=0)
    ends = [last]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends = ends[::-1]
    return list(zip([entry, *ends[:-1]], ends))


def recover(lines: DataFrame, hmm: Hmm) -> DataFrame:
    """``lines`` (conv_id, line_no from 0, line) with ``role`` and ``turn`` from 0, both as recovered."""
    sent = lines.sparkSession.sparkContext.broadcast(hmm)
    rows = lines.select("conv_id", "line_no", "line", F.floor(F.col("line_no") / BLOCK).cast("long").alias("idx"))
    # At most BLOCK lines in a list.
    blocks = rows.groupBy("conv_id", "idx").agg(F.array_sort(F.collect_list(F.struct("line_no", code(F.col("line")).alias("c")))).alias("of"))
    blocks = blocks.select("conv_id", "idx", F.col("of.line_no").alias("line_nos"), F.col("of.c").alias("codes"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [_matrix(c, sent.value).ravel() for c in b["codes"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m, pa.list_(pa.float64()))], names=[*b.schema.names, "m"])

    fields = blocks.schema.simpleString()[7:-1]
    blocks = stored(blocks.mapInArrow(matrices, f"{fields},m:array<double>"), "blocks")
    levels = [blocks.select("conv_id", "idx", "m")]

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for of in b["of"].to_pylist():
                m = _shaped(of[0]["m"])
                for x in of[1:]:
                    m = _times(m, _shaped(x["m"])[:STATES])
                out.append(m.ravel())
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["up"], pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "idx", "m"])

    groups = []
    kind = blocks.schema["conv_id"].dataType.simpleString()
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        group = levels[-1].groupBy("conv_id", F.floor(F.col("idx") / FAN).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "m"))).alias("of"))
        groups.append(group)
        levels.append(stored(group.mapInArrow(combined, f"conv_id {kind}, idx long, m array<double>"), "level"))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = [int(_shaped(m)[START].argmax()) for m in b["m"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["idx"], pa.array([START] * len(last), pa.int32()), pa.array(last, pa.int32())], names=["conv_id", "idx", "entry", "last"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, of, entry, last in zip(*(b[c].to_pylist() for c in ("conv_id", "of", "entry", "last"))):
                for x, (e, z) in zip(of, _chain([_shaped(x["m"]) for x in of], entry, last)):
                    out.append((conv, x["idx"], e, z))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (b["conv_id"].type, pa.int64(), pa.int32(), pa.int32()))], names=["conv_id", "idx", "entry", "last"])

    borders = levels[-1].mapInArrow(top, f"conv_id {kind}, idx long, entry int, last int")
    for group in reversed(groups):
        borders = group.join(borders.withColumnRenamed("idx", "up"), ["conv_id", "up"]).mapInArrow(down, f"conv_id {kind}, idx long, entry int, last int")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = [_decode(c, sent.value, e, z) for c, e, z in zip(*(b[c].to_pylist() for c in ("codes", "entry", "last")))]
            begun = [list(np.cumsum([s < 3 for s in p])) for p in paths]
            yield pa.RecordBatch.from_arrays(
                [b["conv_id"], b["idx"], b["line_nos"], pa.array(paths, pa.list_(pa.int32())), pa.array(begun, pa.list_(pa.int64()))],
                names=["conv_id", "idx", "line_nos", "states", "begun"],
            )

    paths = blocks.drop("m").join(borders, ["conv_id", "idx"]).mapInArrow(decoded, f"conv_id {kind}, idx long, line_nos array<long>, states array<int>, begun array<long>")
    paths = stored(paths, "paths")
    begun = earlier(paths.select("conv_id", "idx", F.element_at("begun", -1).alias("_n")), ["conv_id"], ["idx"], "_n", "before").drop("_n")
    paths = paths.join(begun, ["conv_id", "idx"])
    found = paths.select("conv_id", "before", F.explode(F.arrays_zip("line_nos", "states", "begun")).alias("x"))
    found = found.select(
        "conv_id", F.col("x.line_nos").alias("line_no"), (F.col("before") + F.col("x.begun") - 1).alias("turn"),
        F.element_at(F.array(*map(F.lit, ROLES)), F.col("x.states") % 3 + 1).alias("role"), (F.col("x.states") < 3).alias("begins"),
    )
    return lines.select("conv_id", "line_no", "line").join(found, ["conv_id", "line_no"])


def render(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, piece, role, n_lines, rendered): canonical turns without their markers.

    The pieces of a turn, from 0, one behind the other are the turn; most turns
    have one. A piece has at most ``PIECE`` lines.
    """
    bare = F.when(F.col("begins"), F.regexp_replace("line", "(?i)" + any_marker(), "")).otherwise(F.col("line"))
    turn = ["conv_id", "turn", "role"]
    lines = lines.withColumn("_piece", F.floor(F.col("line_no") / PIECE).cast("long"))
    span = lines.groupBy(*turn).agg(F.min("_piece").alias("_low"), F.max("_piece").alias("_high"))
    pieces = lines.groupBy(*turn, "_piece").agg(F.array_sort(F.collect_list(F.struct("line_no", bare.alias("t")))).alias("of")).join(span, turn)
    text = F.array_join(F.col("of.t"), "\n")
    begins, ends = F.col("_piece") == F.col("_low"), F.col("_piece") == F.col("_high")
    text = F.when(begins, F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.ltrim(text))).otherwise(text)
    text = F.when(ends, F.concat(F.rtrim(text), F.lit("\n<|end|>"))).otherwise(F.concat(text, F.lit("\n")))
    return pieces.select("conv_id", "turn", (F.col("_piece") - F.col("_low")).alias("piece"), "role", F.size("of").alias("n_lines"), text.alias("rendered"))


def transcribed(turns: DataFrame) -> DataFrame:
    """Conversations as raw transcripts would show them: (row, conv_id, part, role, train, text).

    Speakers are marked by names that differ between conversations, and one
    turn in eight (by hash) has no marker.
    """
    pick = F.pmod(F.xxhash64("conv_id"), F.lit(2)).cast("int")
    name = F.when(F.col("role") == "user", F.element_at(F.array(F.lit("User"), F.lit("Human")), pick + 1))
    name = name.when(F.col("role") == "assistant", F.element_at(F.array(F.lit("Assistant"), F.lit("AI")), pick + 1)).otherwise("System")
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0
    text = F.coalesce("text", F.lit(""))
    return turns.select("row", "conv_id", F.col("turn").alias("part"), "role", "train", F.when(bare, text).otherwise(F.concat(name, F.lit(": "), text)).alias("text"))


def parse(turns: DataFrame, train: Column) -> DataFrame:
    """Parse transcripts of ``turns`` (conv_id, turn, role, text) and render their turns.

    ``train`` chooses the rows whose roles are learned from; roles are no input
    of the parsing itself. Rows that repeat (conv_id, turn) follow each other,
    each with its own role; null turns come first; null texts are empty lines;
    null conv_ids are one conversation of their own; an empty input gives an
    empty result.
    """
    # A key that is never null and keeps null apart from every number.
    name = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none"))
    rows = turns.select(name.alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.coalesce(train, F.lit(False)).alias("train"), F.monotonically_increasing_id().alias("row"))
    raw = stored(transcribed(rows), "turns")
    lines = stored(numbered(raw), "lines")
    hmm = fit(lines.join(raw.where("train").select("row", "role"), "row"))
    out = render(recover(lines, hmm))
    number = F.when(F.col("conv_id") != "none", F.substring("conv_id", 2, 20)).cast("long")
    return out.withColumn("conv_id", number)
