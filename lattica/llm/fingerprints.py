"""Document fingerprints as invertible Bloom lookup tables, in DataFrame functions only.

A document is the set of the digests of its paragraphs. Paragraphs end at line
ends; long ones are cut further where their own content says so (``CUT``:
after sentence ends and words with certain last letters, before certain first
letters), so a change moves no cut but its own. Each digest goes into one cell of each of three
sub-tables; a cell holds a count and two xors. Tables of two versions are
subtracted cell by cell, which leaves the digests in which they differ. A cell
with one digest left is pure; peeling takes its digest out of the other
sub-tables, which makes further cells pure. The sub-tables take turns, so a
digest is pure in one cell at a time. If something is left in the end, the pair
is tried again with tables for all digests, twice as large each time, until
nothing is left.

A fingerprint holds the number of digests, a small table and the ``LOWEST``
least digests, which are a random part of all. So two fingerprints give an
estimate of their likeness (``estimated``; exact where both hold all digests).
That estimate is what the tables are sized by.

The text is shuffled once, by ranges of the order of documents with about
``ROWS`` rows each, which brings each document next to its successor. All cells
of a pair stay in that task: no step after it shuffles. The borders of the
ranges are quantiles of the order itself, so gaps, outliers, repeated and null
ids make no large range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ROWS, TURNS = 1000, 12
#: Ranges at most (their borders, 40 bytes each, go to all tasks; beyond it
#: ranges hold more rows), and rows of the order looked at for each border.
MOST_RANGES, LOOKED_AT = 1 << 16, 8
#: Cells of a sub-table for each differing digest, and at least.
SHARE, LEAST = 0.9, 24
#: Cells of a sub-table of the printed fingerprint, and its least digests.
PRINTED, LOWEST = 4, 16
#: Standard deviations of an estimated likeness that a table bears.
DEVIATIONS = 2
#: Where a paragraph ends, or is cut by its own content.
CUT = r"\n+|(?<=[.!?…。！？]\s)(?=[A-Ma-m0-4])|(?<=[kwxz7]\s)(?=[A-Ma-m0-4])"
CHECK = 77


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, CUT), lambda p: p != ""), lambda p: F.xxhash64(p)))


def lowest(d: Column) -> Column:
    """The least ``LOWEST`` digests, in order: as good as drawn, as digests are hashes."""
    return F.slice(F.array_sort(d), 1, LOWEST)


def _seen(na: Column, a: Column, nb: Column, b: Column) -> tuple[Column, Column, Column]:
    """Of sets of ``na`` and ``nb`` digests with the least ones ``a`` and ``b``: the digests of
    their union that both sides tell about, those in common, and whether that is all of them."""
    whole = (na <= LOWEST) & (nb <= LOWEST)
    union = F.array_sort(F.array_union(a, b))
    union = F.when(whole, union).otherwise(F.slice(union, 1, LOWEST))
    return F.size(union), F.size(F.array_intersect(F.array_intersect(a, b), union)), whole


def differing(na: Column, a: Column, nb: Column, b: Column) -> Column:
    """About how many digests two sets differ in, rather too many than too few."""
    seen, common, whole = _seen(na, a, nb, b)
    m = F.greatest(seen, F.lit(1))
    like = common / m
    like = F.greatest(F.lit(0.0), like - DEVIATIONS * F.sqrt((like * (1 - like) + 1 / m) / m))
    return F.when(whole, seen - common).otherwise(F.ceil((na + nb) * (1 - like) / (1 + like)))


def estimated(one: Column, other: Column) -> Column:
    """The likeness of two printed fingerprints, from nothing but these: exact for up to ``LOWEST`` digests each.

    Null where one of them is null.
    """
    number = lambda c: F.substring_index(c, ":", 1).cast("int")
    least = lambda c: F.transform(F.regexp_extract_all(F.hex(F.unbase64(F.substring_index(c, ":", -1))), F.lit("[0-9A-F]{16}"), F.lit(0)), lambda x: F.conv(x, 16, -10).cast("long"))
    seen, common, _ = _seen(number(one), least(one), number(other), least(other))
    return F.when(seen == 0, 1.0).otherwise(common / seen)


def printed(d: Column, low: Column) -> Column:
    """The number of digests, their table of 3 x ``PRINTED`` cells (count, key and check of each) and the least digests.

    Two printed tables subtract and peel like any others, as long as few
    digests differ; beyond that larger tables of the same digests are needed.
    """

    def cell(at: Column) -> Column:
        t = F.floor(at / PRINTED).cast("int")
        mine = F.filter(d, lambda x: _cell(t, x, F.lit(PRINTED), 0) == at)
        xor = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
        return F.concat_ws(".", F.size(mine).cast("string"), F.hex(xor(mine)), F.hex(xor(F.transform(mine, _check))))

    cells = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3 * PRINTED - 1)), cell), ",")
    least = F.base64(F.unhex(F.array_join(F.transform(low, lambda x: F.lpad(F.hex(x), 16, "0")), "")))
    return F.concat(F.size(d).cast("string"), F.lit(":"), cells, F.lit(":"), F.regexp_replace(least, r"\s", ""))


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key, same, one, two): null texts as empty ones, their place in the order and their hashes.

    ``key`` sorts as the order does: higher doc_ids first, null ones last, rows
    with equal ids by a hash of the text. Equal rows (``same``) get numbers
    behind it, so that even they can lie in several ranges.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(1), "text")})
    flip = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    same = F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), flip(F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long")))), flip(F.col("one")))
    some = F.lpad(F.hex(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 16))), 4, "0")
    return docs.withColumn("same", same).withColumn("key", F.concat("same", some))


def ranges(keys: DataFrame, n: int, rows: int) -> list[str]:
    """Borders of ranges of about ``rows`` of the ``n`` keys; from a sample of bounded size."""
    many = min(MOST_RANGES, -(-n // rows))
    if many < 2:
        return []
    share = min(1.0, LOOKED_AT * many / n)
    found = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else keys
    found = sorted(found.toArrow()["key"].to_pylist())  # about LOOKED_AT x MOST_RANGES at most
    return sorted({found[len(found) * k // many] for k in range(1, many)}) if found else []


def range_of(key: Column, borders: list[str]) -> Column:
    """The number of borders that don't lie above ``key``, by bisection."""
    if not borders:
        return F.lit(0)
    all_ = F.split(F.lit(",".join(borders)), ",")
    steps = [1 << k for k in reversed(range(len(borders).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(borders)) & (F.get(all_, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Adds next_text, next_one, next_two and ``bucket``: each document beside its successor.

    The successor is the next lower doc_id, after the lowest the highest; rows
    with equal doc_ids follow each other by a hash of the text, null doc_ids
    come last. Each range also gets a copy of the row that follows it.
    """
    docs = placed(docs)
    keys = stored(docs.select("key"), "keys")  # 37 characters a row
    n = keys.count()
    borders = ranges(keys, n, rows)
    heads = keys.groupBy(range_of(F.col("key"), borders).alias("bucket")).agg(F.min(F.left("key", F.lit(33))).alias("same"))
    # At most MOST_RANGES rows; a range's first row is copied to the range before it.
    heads = sorted((r.bucket, r.same) for r in heads.collect())
    to = docs.sparkSession.createDataFrame([(same, heads[k - 1][0]) for k, (_, same) in enumerate(heads)], "same string, bucket int")
    first = docs.join(F.broadcast(to.select("same").distinct()), "same", "left_semi").dropDuplicates(["same"])
    columns = ["bucket", "doc_id", "text", "one", "two", "key"]
    own = docs.withColumn("bucket", range_of(F.col("key"), borders)).select(*columns, F.lit(0).alias("copy"))
    copies = first.join(F.broadcast(to), "same").select(*columns, F.lit(1).alias("copy"))
    both = own.unionByName(copies).repartition(max(1, len(heads)), "bucket").withColumn("d", digests(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("copy", "key")
    both = both.select("bucket", "doc_id", "text", "d", "one", "two", "copy", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "d", "one", "two")])
    return both.where("copy = 0").drop("copy")


def edited(rows: DataFrame) -> DataFrame:
    """Adds the edited text: the last half replaced by the beginning of the next one."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return rows.withColumn("n_chars", n.cast("long")).withColumn("edited", text).withColumn("edited_d", digests(F.col("edited")))


def _cell(table: Column, d: Column, size: Column, scale: int) -> Column:
    return (table * size + F.pmod(F.xxhash64(d, table, F.lit(scale)), size)).cast("int")


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit(CHECK))


def difference(rows: DataFrame, group: list[str], pairs: list[tuple[str, str]], info: list[str], scale: int = 1, turns: int = TURNS) -> DataFrame:
    """Peel the difference of pairs of digest arrays.

    ``rows`` is partitioned by a subset of ``group``, which names a row. Tables
    of scale 1 are sized by ``differing`` (each column x has x_low beside it),
    larger ones by all digests of both sides. For pair k of columns: ``diff_k``, the number of digests recovered, and
    ``left_k``, the cells that could not be emptied (0: complete); ``info``
    columns are carried along.
    """
    sides = lambda x, y: F.concat(
        F.transform(x, lambda d: F.struct(d.alias("d"), F.lit(1).alias("sign"))), F.transform(y, lambda d: F.struct(d.alias("d"), F.lit(-1).alias("sign")))
    )
    most = [differing(F.size(x), F.col(f"{x}_low"), F.size(y), F.col(f"{y}_low")) if scale == 1 else F.size(x) + F.size(y) for x, y in pairs]
    sizes = [F.ceil(n * SHARE * scale).cast("int") + LEAST for n in most]
    nothing = F.array(F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).alias("sign")))
    # Kind -1 is a row that only carries the information.
    kinds = [F.struct(F.lit(-1).alias("kind"), F.lit(1).alias("size"), nothing.alias("of"))]
    kinds += [F.struct(F.lit(k).alias("kind"), s.alias("size"), sides(F.col(x), F.col(y)).alias("of")) for k, ((x, y), s) in enumerate(zip(pairs, sizes))]
    cells = rows.select(*dict.fromkeys([*group, *info]), F.explode(F.array(*kinds)).alias("k"))
    carried = F.when(F.col("k.kind") == -1, F.struct(*info)).alias("info")
    cells = cells.select(*group, carried, F.col("k.kind").alias("kind"), F.col("k.size").alias("size"), F.explode("k.of").alias("x"))
    cells = cells.select(*group, "info", "kind", "size", F.col("x.d").alias("d"), F.col("x.sign").alias("sign"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("t")).where("kind >= 0 or t = 0")
    cells = cells.select(*group, "info", "kind", "size", F.when(F.col("kind") < 0, -2).otherwise(_cell(F.col("t"), F.col("d"), F.col("size"), scale)).alias("cell"), F.col("sign").cast("long").alias("count"), F.col("d").alias("key"), F.when(F.col("kind") < 0, F.lit(0).cast("long")).otherwise(_check(F.col("d"))).alias("check"))
    key = [*group, "info", "kind", "size", "cell"]

    def summed(cells: DataFrame) -> DataFrame:
        cells = cells.groupBy(*key).agg(F.sum("count").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
        return cells.where("cell < 0 or count <> 0 or key <> 0 or check <> 0")

    cells = summed(cells)
    for turn in range(turns):
        t = turn % 3
        mine = (F.col("cell") >= 0) & (F.floor(F.col("cell") / F.col("size")) == t)
        pure = mine & (F.abs("count") == 1) & (F.col("check") == _check(F.col("key")))
        row = lambda cell, count, key, chk: F.struct(cell.cast("int").alias("cell"), count.cast("long").alias("count"), key.alias("key"), chk.alias("check"))
        zero = F.lit(0).cast("long")
        # A pure cell's digest is counted (cell -1) and leaves the other tables.
        taken = [row(F.lit(-1), F.lit(1), zero, zero)] + [row(_cell(F.lit(o), F.col("key"), F.col("size"), scale), -F.col("count"), F.col("key"), F.col("check")) for o in range(3) if o != t]
        same = F.array(row(F.col("cell"), F.col("count"), F.col("key"), F.col("check")))
        cells = cells.select(*group, "info", "kind", "size", F.explode(F.when(pure, F.array(*taken)).otherwise(same)).alias("y")).select(*group, "info", "kind", "size", "y.*")
        cells = summed(cells)
    out = [F.max("info").alias("info")]
    for k in range(len(pairs)):
        of = F.col("kind") == k
        out += [F.coalesce(F.sum(F.when(of & (F.col("cell") == -1), F.col("count"))), F.lit(0)).alias(f"diff_{k}"), F.count_if(of & (F.col("cell") >= 0)).alias(f"left_{k}")]
    return cells.groupBy(*group).agg(*out).select("info.*", *[f"{x}_{k}" for k in range(len(pairs)) for x in ("diff", "left")])


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Common digests of all; two empty sets are alike."""
    common = (a + b - diff) / 2
    return F.when(a + b == 0, 1.0).otherwise(common / (a + b - common))


#: A pair of texts by their hashes: 128 bits each.
PAIR = ["one", "two", "next_one", "next_two"]
INFO = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "na", "ne", "nn", *PAIR]
PAIRS = [("d", "edited_d"), ("d", "next_d")]
FOUND = ["diff_0", "diff_1"]


def described(rows: DataFrame) -> DataFrame:
    rows = edited(rows).withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    rows = rows.withColumns({f"{x}_low": lowest(F.col(x)) for x in ("d", "edited_d", "next_d")})
    rows = rows.withColumns({"fingerprint": printed(F.col("d"), F.col("d_low")), "edited_fingerprint": printed(F.col("edited_d"), F.col("edited_d_low"))})
    return rows.withColumns({"na": F.size("d"), "ne": F.size("edited_d"), "nn": F.size("next_d"), "row": F.monotonically_increasing_id()})


def retried(failed: DataFrame, docs: DataFrame, scale: int, turns: int) -> DataFrame:
    """(one, two, next_one, next_two, diff_0, left_0, ...) of each pair of texts in ``failed``, by tables for all digests.

    A pair is known by the hashes of its two texts, which are never null, and
    rows that share both texts share the result. Each text that is named is
    read once more.
    """
    pairs = failed.select(*PAIR).distinct()
    # Written, so that Spark knows how few they are and needn't shuffle all texts.
    named = stored(pairs.select("one", "two").union(pairs.select("next_one", "next_two")).distinct(), "named")
    texts = stored(placed(docs).select("one", "two", "text").join(named, ["one", "two"], "left_semi").dropDuplicates(["one", "two"]), "texts")
    rows = pairs.join(texts, ["one", "two"]).join(texts.toDF("next_one", "next_two", "next_text"), ["next_one", "next_two"])
    rows = edited(rows.withColumn("d", digests(F.col("text"))).withColumn("next_d", digests(F.col("next_text"))))
    return difference(rows.repartition(*PAIR), PAIR, PAIRS, PAIR, scale, turns)


def compare(docs: DataFrame, rows: int = ROWS, turns: int = TURNS) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text) and their likeness to their edited and next texts.

    Null texts count as empty. Repeated rows, also of null doc_ids, each get a
    result; other columns are ignored; an empty input gives an empty result.
    ``docs`` is read several times and must give the same rows each time.
    """
    done = stored(difference(described(with_next(docs, rows)), ["bucket", "row"], PAIRS, INFO, 1, turns), "compared")
    results = done.where("left_0 = 0 and left_1 = 0").select(*INFO, *FOUND)
    failed = done.where("left_0 > 0 or left_1 > 0").select(*INFO)
    left, scale = failed, 1
    solved = None
    # Tables have room for all digests and grow until these lie apart, so this ends.
    while not left.isEmpty():
        scale *= 2
        got = stored(retried(left, docs, scale, turns), "retried")
        good = got.where("left_0 = 0 and left_1 = 0").select(*PAIR, *FOUND)
        solved = good if solved is None else solved.union(good)
        left = got.where("left_0 > 0 or left_1 > 0").select(*PAIR)
    if solved is not None:
        results = results.unionByName(failed.join(solved, PAIR).select(*INFO, *FOUND))
    return results.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("na"), F.col("ne"), F.col("diff_0")).alias("near_edited"), likeness(F.col("na"), F.col("nn"), F.col("diff_1")).alias("near_next"),
    )
