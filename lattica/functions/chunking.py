"""Sections of Markdown and chunks of text, in bytes of UTF-8.

Sections are found with Spark's own functions; the chunk loop depends on its
own last step, so it runs as an Arrow function on one section at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 600, 100
_TRIM = b" \t\n\r"
_SPACE, _WORD = re.compile(rb"[ \t\n\v\f\r]"), re.compile(rb"[^ \t\n\v\f\r]")


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of about ``size`` bytes that end at white space and overlap by whole words."""
    raw, at, out = text.encode(), 0, []
    n = len(raw)

    def after(kind: re.Pattern, start: int, stop: int) -> int:
        found = kind.search(raw, start, stop)
        return found.start() if found else max(start, stop)

    while at < n:
        end = after(_SPACE, min(n, at + size), n)
        piece = raw[at:end].strip(_TRIM)
        if piece:
            out.append(piece.decode())
        if end >= n:
            break
        # Past the word that the overlap begins in, then past the space after it.
        at = after(_WORD, after(_SPACE, max(at + 1, end - overlap), end), end)
    return out


def chunks(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, ordinal, heading, content); numbers go on across the sections of a document.

    ``sections``: (row, doc_id, ordinal, heading, body), ``row`` telling apart
    documents that share an id or have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [cut(t or "", size, overlap) for t in b["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["ordinal"], b["heading"], pa.array(parts, pa.list_(pa.string()))], names=["row", "doc_id", "ordinal", "heading", "parts"])

    s = sections.select("row", F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), "heading", "body").mapInArrow(run, "row long, doc_id long, ordinal int, heading string, parts array<string>")
    before = F.coalesce(F.sum(F.size("parts")).over(Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("first", before)
    return s.select("doc_id", "first", "ordinal", "heading", F.posexplode("parts").alias("k", "content")).select("doc_id", (F.col("first") + F.col("k")).cast("int").alias("chunk_index"), "ordinal", "heading", "content")


def sections(docs: DataFrame) -> DataFrame:
    """(row, doc_id, ordinal, parent, heading, heading_path, depth, body) from ``text`` with ATX headings.

    Text before the first heading is a section of depth 0 if it isn't blank; a
    document without headings is one such section. A section's parent is the
    nearest one before it of lower depth (depth 0 takes first-level headings
    as children). Each row of ``docs`` is a document of its own, whatever its
    doc_id; ``row`` tells them apart within this result. Documents without
    headings need no lines, and so no shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    has_heading = text.rlike("(?dm)^#{1,6} ")
    none, empty = F.lit(None).cast("int"), F.lit("")
    whole = _trimmed(F.regexp_replace(text, r"\r+(?=\n|\z)", ""))
    # The two sides number their rows apart: from -1 down, and from 0 up.
    flat = docs.where(~has_heading).select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", F.lit(0).alias("ordinal"), none.alias("parent"), empty.alias("heading"), empty.alias("heading_path"), F.lit(0).alias("depth"), whole.alias("body"))
    return flat.union(_headed(docs.where(has_heading)))


def _trimmed(body: Column) -> Column:
    """Without empty lines at the start and white space at the end."""
    return F.regexp_replace(F.regexp_replace(body, r"^(\s*\n)+", ""), r"\s+$", "")


def _headed(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # before lines come of them
    lines = docs.select("row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\r+$", ""))
    head = F.regexp_extract("line", "^(#{1,6}) ", 1)
    lines = lines.withColumns({"depth": F.length(head), "is_head": F.length(head) > 0})
    by_line = Window.partitionBy("row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("k", F.sum(F.col("is_head").cast("int")).over(by_line))
    found = lines.groupBy("row", "doc_id", "k").agg(
        F.max(F.when(F.col("is_head"), F.expr("substring(line, depth + 2)"))).alias("heading"), F.max("depth").alias("depth"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head"), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    found = found.withColumn("body", _trimmed(F.col("body")))
    whole = F.max("k").over(Window.partitionBy("row"))
    found = found.withColumn("last", whole).where((F.col("k") > 0) | (F.col("body") != "") | (F.col("last") == 0)).drop("last")
    w = Window.partitionBy("row").orderBy("k")
    found = found.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("heading", F.coalesce("heading", F.lit("")))
    # The last section of each depth so far is all that a stack of headings
    # needs: it is an open one where none of a lower depth came after it.
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.struct("ordinal", "heading")), ignorenulls=True).over(before) for d in range(6)]
    found = found.withColumns({f"last{d}": c for d, c in enumerate(last)})
    at = [F.coalesce(F.col(f"last{d}")["ordinal"], F.lit(-1)) for d in range(6)]
    is_open = [(F.col("depth") > d) & (at[d] >= 0) & (at[d] > (F.greatest(*at[:d], F.lit(-1)) if d else F.lit(-1))) for d in range(6)]
    chain = F.array_compact(F.array(*[F.when(is_open[d], F.col(f"last{d}")["heading"]) for d in range(6)]))
    path = F.array_join(F.filter(F.array_append(chain, F.col("heading")), lambda h: h != ""), " > ")
    parent = F.greatest(*[F.when(F.col("depth") > d, F.col(f"last{d}")["ordinal"]) for d in range(6)])
    return found.select("row", "doc_id", F.col("ordinal").cast("int"), parent.cast("int").alias("parent"), "heading", path.alias("heading_path"), F.col("depth").cast("int"), "body")
