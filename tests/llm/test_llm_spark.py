"""The corpus operators on small tables with nulls, ties, repeats, empty and long texts, and extra columns."""

import hashlib
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from lattica.llm import bpe, chat, fingerprints, language_id, media, near_dup, packing, pii, quality, resharding  # noqa: E402
from lattica.llm import queries as llm_queries  # noqa: E402

import plain  # noqa: E402

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k}" for k in range(30_000))
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one", "en", "s", 3), (3, "one", "en", "s", 3), (5, LONG, "en", "s", 9), (None, "no id here", "en", None, 1), (7, "\n \t\n", "fr", "s", 4), (8, "12 !? 34", "de", "s", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_language(spark, odd, none):
    train = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the house of one", "en"), ("das haus ein", "de")] * 20)], "doc_id long, text string, lang string")
    m = language_id.fit(train)
    got = language_id.predict(odd.withColumn("score", F.lit("clash")), m)
    rows = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in got.collect()}
    assert got.count() == len(ODD) and rows[1, None] == rows[2, ""] == rows[7, "\n \t\n"] == rows[8, "12 !? 34"] == ("und", 0.0) and rows[3, "one"][0] == "en"
    assert all(0 <= s <= 1 for _, s in rows.values())
    assert language_id.predict(none, m).count() == 0
    nothing = language_id.fit(none.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    got = llm_queries.QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_language_equals_plain_backoff(spark):
    """Every document of the smallest table, by counts in dictionaries."""
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang").collect()
    crc = lambda d: zlib.crc32(str(d).encode()) % 4
    model = plain.Language([(x.text, x.lang) for x in rows if crc(x.doc_id) != 2])
    got = {x.doc_id: x for x in llm_queries.QUERIES["op1_language_id"](spark, DIR).collect()}
    assert len(got) == len(rows)
    for x in rows:
        lang, score = model.predict(x.text)
        assert got[x.doc_id].held_out == (crc(x.doc_id) == 2) and got[x.doc_id].lang_pred == lang and got[x.doc_id].score == pytest.approx(score, abs=1e-4)


def test_quality_equals_trees_walked_node_by_node(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)
    trees = quality.fit(quality.labelled(docs, labels.select("doc_id", "quality")))
    got = {x.doc_id: x for x in llm_queries.QUERIES["op7_quality"](spark, DIR).collect()}
    for x in docs.collect():
        want = plain.walk(trees, quality.statistics(x.text))
        assert got[x.doc_id].score == pytest.approx(want, abs=1e-9) and got[x.doc_id].predicted == int(want >= 0.3)


def test_media_rows_equal_plain_ones(spark):
    """Digests, sizes and features of all documents, by the wave module and loops."""
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = llm_queries.QUERIES["op4_media"](spark, DIR).collect()
    assert {x.doc_id for x in rows} == set(texts)
    for x in rows:
        *want, values = plain.media_row(texts[x.doc_id])
        assert [x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.media_bytes, x.media_sha256] == want
        assert [float(v) for v in x.feature.split(",")] == pytest.approx(values, abs=2e-4, rel=2e-5)


def test_private_values_of_a_plain_search_are_gone(spark):
    """Values found by trying plain patterns at each place change within their shape; texts without a count stay."""
    texts = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    n, linked = 0, {}
    for x in llm_queries.QUERIES["op8_pii"](spark, "/root/testdata/sf0.01").collect():
        counts = sum(x[c] for c in x.asDict() if c.startswith("n_") and c != "n_chars")
        assert (x.text != texts[x.doc_id]) == (counts > 0)
        found = plain.private(texts[x.doc_id])
        assert len(x.text) == len(texts[x.doc_id]) or "-" in texts[x.doc_id] or "." in texts[x.doc_id]
        for _, value in found:
            n += 1
            assert value not in x.text
        if len(x.text) == len(texts[x.doc_id]):
            for start, value in found:
                new = x.text[start : start + len(value)]
                if re.fullmatch(r"[\d -]+", value):
                    assert plain.shape(new) == plain.shape(value) and linked.setdefault(value, new) == new
    assert n > 50


def test_quality(spark, odd, none):
    got = quality.score(odd.withColumn("predicted", F.lit("clash")), quality.fit(quality.labelled(odd, spark.createDataFrame([(3, 1), (5, 0), (2, 1), (None, 1), (8, None)], "doc_id long, quality int"))))
    assert got.count() == len(ODD) and got.where("score between 0 and 1 and (predicted = 1) = (score >= 0.3)").count() == len(ODD)
    unlabelled = quality.fit(quality.labelled(none, spark.createDataFrame([], "doc_id long, quality int")))
    assert {r.score for r in quality.score(odd, unlabelled).collect()} == {0.5} and quality.score(none, unlabelled).count() == 0


def test_quality_held_out(spark):
    got = llm_queries.QUERIES["op7_quality"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert got.where("predicted = quality").count() >= 0.9 * got.count() > 0


def test_resharding(spark, odd, none):
    r = random.Random(1)
    rows = [(k, "x" * min(3000, int(r.paretovariate(1) * 40))) for k in range(3000)] + [(-1, "same")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("clash"))
    out = resharding.reshard(df, F.pmod("doc_id", F.lit(7)), F.octet_length("text"), 10, rows_per_block=100).toPandas()
    assert len(out) == len(rows)
    by = out.groupby("shard")
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by) and by["size"].sum().max() - by["size"].sum().min() <= 0.02 * by["size"].sum().mean() + 50
    # The bytes that move are those beyond the new capacities, and little more.
    before, cap = out.groupby("old_shard")["size"].sum(), out["size"].sum() / 10
    least = sum(max(0, before.get(k, 0) - cap) for k in range(7))
    assert out[out["shard"] != out.old_shard]["size"].sum() <= 1.05 * least + 200
    assert least <= out.least_moved[0] <= least + 10 and set(out.least_moved) == {out.least_moved[0]}
    three = resharding.reshard(odd, F.lit(0), F.octet_length("text"), 3).toPandas()
    assert len(three) == len(ODD) and all(sorted(g.slot) == list(range(len(g))) for _, g in three.groupby("shard")) and set(three["shard"]) <= {0, 1, 2}
    assert resharding.reshard(none, F.lit(0), F.lit(1), 3).count() == 0


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    before = spark.createDataFrame([(k, k % 3, k) for k in range(9)], "doc_id long, shard int, slot long")
    path = str(tmp_path / "shards")
    resharding.publish(spark, path, resharding.write(before, path))
    old = resharding.current(spark, path)
    kept = {p.name for p in (tmp_path / "shards" / old[2]).iterdir()}
    after = before.withColumn("shard", F.when(F.col("doc_id") == 0, 1).otherwise(F.col("shard")))
    assert resharding.rewrite_affected(before, after, path) == [0, 1]
    assert sorted((r.doc_id, r.shard) for r in resharding.read(spark, path, before.schema).collect()) == sorted((r.doc_id, r.shard) for r in after.collect())
    new = resharding.current(spark, path)
    assert new[2] == old[2] and new[1] != old[1] and kept == {p.name for p in (tmp_path / "shards" / new[2]).iterdir()} and not (tmp_path / "shards" / old[1]).exists()
    assert resharding.rewrite_affected(after, after, path) == []


def test_a_move_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    before = spark.createDataFrame([(k, k % 3, k) for k in range(9)], "doc_id long, shard int, slot long")
    path = str(tmp_path / "shards")
    resharding.publish(spark, path, resharding.write(before, path))

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(resharding, "publish", broken)
    with pytest.raises(OSError, match="lost"):
        resharding.rewrite_affected(before, before.withColumn("shard", F.lit(0)), path)
    assert sorted(map(tuple, resharding.read(spark, path, before.schema).collect())) == sorted(map(tuple, before.collect()))


def test_rows_without_id_move_too(spark, tmp_path):
    rows = [(None, 0, 0), (None, 1, 0), (3, 1, 1), (3, 1, 2), (4, 2, 0)]
    before = spark.createDataFrame(rows, "doc_id long, shard int, slot long")
    path = str(tmp_path / "shards")
    resharding.publish(spark, path, resharding.write(before, path))
    after = spark.createDataFrame([(None, 3, 0), *rows[1:]], before.schema)
    assert resharding.rewrite_affected(before, after, path) == [0, 3]
    assert sorted(map(str, resharding.read(spark, path, before.schema).collect())) == sorted(map(str, after.collect()))


def test_shards_without_bytes_keep_their_rows(spark):
    df = spark.createDataFrame([(k, k % 4, 10 if k % 4 < 2 else 0) for k in range(40)], "doc_id long, s int, n long")
    got = resharding.reshard(df, F.col("s"), F.col("n"), 3).collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and {r.shard for r in got} <= {0, 1, 2}


def test_texts_move_between_shard_files(spark, odd, none, tmp_path):
    path = str(tmp_path / "shards")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(k, f"text {k}" * (k % 9)) for k in range(500)] + [(None, "x")] * 3, "doc_id long, text string"))
    got = resharding.lay_out_anew(docs, F.pmod("doc_id", F.lit(4)), F.octet_length("text"), 6, path).toPandas()
    files = spark.read.parquet(*[f"{path}/{v}" for v in resharding.current(spark, path).values()])
    key = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    assert key(files) == key(docs) and set(resharding.current(spark, path)) == set(got["shard"])
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert resharding.lay_out_anew(none.select("doc_id", "text"), F.lit(0), F.lit(1), 3, str(tmp_path / "none")).count() == 0


def test_chat(spark, none):
    turns = [(c, t, ("user", "assistant")[t % 2], f"line one of {t}\nmore text" if t % 2 else f"what is {t}?") for c in range(60) for t in range(6)]
    turns += [(99, t, ("user", "assistant")[t % 2], "a fairly long line of talk\n" * 300) for t in range(4)] + [(100, 0, None, None), (None, 0, "user", "hi"), (-1, 0, "user", "ho"), (100, 0, "user", "again")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("line", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("train", F.lit("clash"))
    got = chat.parse(df, F.col("conv_id") < 40)
    pieces = got.collect()
    rows = {(r.conv_id, r.turn): r for r in pieces}
    same = sum(rows.get((c, t)) is not None and rows[c, t].role == role for c, t, role, _ in turns[:360])
    assert same >= 0.9 * 360
    assert sum(r.n_lines for r in pieces if r.conv_id == 99) == 4 * 301
    assert sum("hi" in r.rendered for (c, _), r in rows.items() if c is None) == 1 == sum("ho" in r.rendered for (c, _), r in rows.items() if c == -1)
    whole = [r for r in rows.values() if r.piece == 0 and r.n_lines < 900]
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>") for r in whole)
    assert chat.parse(df.limit(0), F.lit(True)).count() == 0


def test_a_turn_of_any_length_comes_in_pieces(spark):
    lines = [f"line {k} of talk" for k in range(2500)]
    df = spark.createDataFrame([(7, k, "assistant" if k % 2 else "user", "\n".join(lines) if k == 3 else "short?") for k in range(8)] + [(1, 0, "user", "hello")], "conv_id long, turn long, role string, text string")
    rows = chat.parse(df, F.lit(True)).where("conv_id = 7").orderBy("turn", "piece").collect()
    assert max(r.n_lines for r in rows) <= chat.PIECE and max(r.piece for r in rows) >= 2
    texts = {}
    for r in rows:
        texts[r.turn] = texts.get(r.turn, "") + r.rendered
    assert any(t == "<|assistant|>\n" + "\n".join(lines) + "\n<|end|>" for t in texts.values()) and all(t.startswith("<|") and t.endswith("\n<|end|>") for t in texts.values())


def test_lines_are_numbered_across_ranges(spark):
    """One conversation with most rows, repeated and null parts: as a loop numbers them."""
    r = random.Random(3)
    rows = [(k, "c1" if k % 4 else f"c{k}", None if k % 11 == 0 else r.randrange(30), "\n".join("ab"[: r.randrange(3)] for _ in range(r.randrange(1, 4))) if k % 7 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "row long, conv_id string, part long, text string").repartition(5)
    hashes = {x.row: x.h for x in df.select("row", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    at, want = {}, []
    for row, conv, part, text in sorted(rows, key=lambda x: (x[1], -1 if x[2] is None else x[2], hashes[x[0]], x[0])):
        for line in (text or "").split("\n"):
            want.append((conv, at.setdefault(conv, 0), row, line))
            at[conv] += 1
    assert sorted((x.conv_id, x.line_no, x.row, x.line) for x in chat.numbered(df).collect()) == sorted(want)


def test_blocks_decode_like_one_pass(spark):
    """A conversation over many blocks and levels gets a path as good as one Viterbi pass finds."""
    r = np.random.default_rng(1)
    hmm = chat.Hmm(np.where(r.random((7, 6)) < 0.15, -np.inf, np.log(r.random((7, 6)))), np.log(r.random((6, chat.CODES))))
    texts = ["User: a", "b?", "- c", "Assistant: d " + "x" * 60, "", "System: e"]
    lines = [texts[int(k)] for k in r.integers(0, 6, 2000)]
    old = chat.BLOCK, chat.FAN
    chat.BLOCK, chat.FAN = 16, 8
    try:
        df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "conv_id long, line_no long, line string")
        got = [(x.role, x.begins) for x in chat.recover(df, hmm).orderBy("line_no").collect()]
        codes = [x.c for x in df.orderBy("line_no").select(chat.code(F.col("line")).alias("c")).collect()]
    finally:
        chat.BLOCK, chat.FAN = old
    path = [chat.ROLES.index(role) + (0 if begins else 3) for role, begins in got]
    score, at = hmm.step[6, path[0]] + hmm.seen[path[0], codes[0]], hmm.step[6] + hmm.seen[:, codes[0]]
    for p, q, c in zip(path, path[1:], codes[1:]):
        score += hmm.step[p, q] + hmm.seen[q, c]
        at = (at[:, None] + hmm.step[:6]).max(axis=0) + hmm.seen[:, c]
    # Equally good paths may differ.
    assert len(path) == 2000 and score == pytest.approx(at.max(), abs=1e-6)


def test_media(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}/archives"
    got = media.round_trip(odd, path).collect()
    want = sorted((d, len((t or "").encode()), hashlib.sha256(media.payload_of((t or "").encode())).hexdigest()) for d, t, *_ in ODD if d is not None)
    assert sorted((r.doc_id, r.n_bytes, r.payload_sha256) for r in got if r.doc_id is not None) == want and len(got) == len(ODD)
    # Small ranges give more partitions and the same members.
    small = media.load(spark, path, rangeBytes="200")
    assert small.rdd.getNumPartitions() > 1 and small.count() == len(ODD) and small.where("attempts > 1").count() == 0
    assert media.round_trip(none, f"file://{tmp_path}/none").count() == 0


def test_a_broken_member_is_tried_alone(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    media.store(spark.createDataFrame([(k, 192, bytearray(random.Random(k).randbytes(192))) for k in range(5)], "doc_id long, n_bytes long, payload binary").coalesce(1), path)
    archive = next(p for p in (tmp_path / "a").iterdir() if p.suffix == ".zip")
    at = sorted(zipfile.ZipFile(archive).infolist(), key=lambda i: i.header_offset)[2]
    raw = bytearray(archive.read_bytes())
    raw[at.header_offset + 80] ^= 255
    archive.write_bytes(raw)
    rows = media.load(spark, path, keepErrors="true").collect()
    assert sorted(r.attempts for r in rows) == [1, 1, 1, 1, 3] and sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception, match="wav at"):
        media.load(spark, path).count()


def python_compare(rows):
    """op5's result by plain sets, as a sorted list; rows with equal ids may follow each other in any order."""
    pieces = lambda t: {p for line in t.split("\n") for p in re.split(r"(?<=[.!?…。！？]\s)(?=[A-Ma-m0-4])|(?<=[kwxz7]\s)(?=[A-Ma-m0-4])", line) if p}
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for k, (d, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), round(alike(pieces(t), pieces(e)), 9), round(alike(pieces(t), pieces(n)), 9)))
    return sorted(out)


def compared(out):
    return sorted((str(x.doc_id), x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in out.collect())


def in_order(spark, rows):
    """As the operator orders them: by id downwards, nulls last, then by the hash of the text."""
    df = spark.createDataFrame([(d, t or "") for d, t in rows], "doc_id long, text string")
    return [(r.doc_id, r.text) for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]


@pytest.mark.parametrize("turns", [12, 2])
def test_fingerprints(spark, turns):
    """Two turns empty few tables, so most pairs go through the retries."""
    r = random.Random(8)
    line = lambda: "".join(r.choices("abcdéß日😀. k", k=r.randint(0, 250)))
    rows = [(k * r.choice([1, 3, 1000]) + 5000 * k, "\n".join(line() for _ in range(r.randint(0, 12)))) for k in range(80)] + [(2**62, "far away"), (-7, None), (-8, ""), (-9, "x" * 30_000), (-10, rows_text := "same\nlines"), (-11, rows_text)]
    rows += [(None, "\n".join(line() for _ in range(9))) for _ in range(20)] + [(-12, "\n".join(line() for _ in range(9))) for _ in range(20)] + [(-13, "equal. rows. " * 5)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("d", F.lit("clash"))
    want = python_compare(in_order(spark, rows))
    out = fingerprints.compare(df, rows=10, turns=turns).cache()
    assert compared(out) == want
    got = {x.doc_id: x for x in out.collect()}
    assert got[-10].fingerprint == got[-11].fingerprint and got[-10].near_next == 1.0


def test_fingerprints_of_null_and_repeated_ids(spark, none):
    r = random.Random(4)
    text = lambda: "\n".join(f"{r.random()}" for _ in range(6))
    rows = [(1, text()), (2, text()), (3, same := text()), (3, same), (3, text()), (None, text())]
    assert compared(fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string"), turns=1)) == python_compare(in_order(spark, rows))
    assert fingerprints.compare(none, turns=1).count() == 0
    one = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert [(x.n_chars, x.near_next) for x in fingerprints.compare(one, turns=1).collect()] == [(1, 1.0)]


def test_likeness_from_printed_fingerprints(spark):
    """Exact up to 16 digests a side, near the truth beyond; tables sized by it hold all differing digests."""
    r = random.Random(3)
    sets = []
    for n in [0, 1, 2, 5, 16, 17, 60, 400, 3000]:
        for shared in (0, n // 4, n // 2, n - n // 20, n):
            a = {r.getrandbits(64) - 2**63 for _ in range(n)}
            sets.append((sorted(a), sorted([*r.sample(sorted(a), shared), *{r.getrandbits(64) - 2**63 for _ in range(n - shared)}])))
    df = spark.createDataFrame(sets, "a array<long>, b array<long>").withColumns({f"{x}_low": fingerprints.lowest(F.col(x)) for x in "ab"})
    df = df.withColumns({x.upper() + "p": fingerprints.printed(F.col(x), F.col(f"{x}_low")) for x in "ab"})
    df = df.select("a", "b", fingerprints.estimated(F.col("Ap"), F.col("Bp")).alias("near"), fingerprints.estimated(F.col("Bp"), F.col("Ap")).alias("back"), fingerprints.differing(F.size("a"), F.col("a_low"), F.size("b"), F.col("b_low")).alias("most"))
    short = 0
    for x in df.collect():
        a, b = set(x.a), set(x.b)
        want = len(a & b) / len(a | b) if a | b else 1.0
        assert x.near == x.back and (x.near == want if len(a) <= 16 else abs(x.near - want) < 0.4)
        assert x.most == len(a ^ b) if len(a) <= 16 else x.most <= len(a) + len(b)
        short += x.most < len(a ^ b)
    assert short <= 2
    assert spark.range(1).select(fingerprints.estimated(F.lit(None).cast("string"), F.lit("0::")).alias("x")).first().x is None


def test_ranges_of_the_order_are_even(spark):
    """Outliers, nulls and one id in a third of the rows make no large range."""
    rows = [(k, f"t{k}") for k in range(3000)] + [(7, f"u{k}") for k in range(2000)] + [(8, "equal")] * 2000 + [(None, f"n{k}") for k in range(1000)] + [(2**60, "far")]
    keys = fingerprints.placed(spark.createDataFrame(rows, "doc_id long, text string")).select("key")
    borders = fingerprints.ranges(keys, len(rows), 100)
    sizes = sorted(r["count"] for r in keys.groupBy(fingerprints.range_of(F.col("key"), borders).alias("b")).count().collect())
    assert len(sizes) > 60 and sizes[-1] < 5 * 100
    assert fingerprints.ranges(keys, 50, 100) == []


def test_an_inserted_character_moves_no_other_cut(spark):
    r = random.Random(5)
    words = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5)) for _ in range(2000))
    rows = [(2, words), (1, words[:5000] + "#" + words[5000:])]
    assert fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").first().near_next > 0.95


def test_packing(spark, odd, none):
    path = public.path("byte_bpe_50k.json")
    got = packing.pack(packing.pieces(odd, path).withColumn("offset", F.lit("clash"))).toPandas()
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    for d, t in {(d, t) for d, t, *_ in ODD if d is not None}:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == d].drop_duplicates(["piece"]).sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[1:] == 2048).all()
        for x in mine.itertuples():
            assert zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    seq = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (seq.length.sum() <= 2048).all() and all((g.length.cumsum() - g.length).tolist() == g.offset.tolist() for _, g in seq)
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_pseudonyms(spark, odd, none):
    df = spark.createDataFrame([(1, "card 4111111111111111"), (2, "4111111111111111 again"), (3, "clean 4111111111111112"), (4, None), (5, "")], "doc_id long, text string").withColumn("n_card", F.lit("clash"))
    got = {r.doc_id: r for r in pii.pseudonymise(df, b"key").collect()}
    assert got[1].text.split()[1] == got[2].text.split()[0] != "4111111111111111" and got[1].n_card == 1
    assert got[3].text == "clean 4111111111111112" and got[4].text is None and got[5].text == ""
    assert sorted(map(str, pii.pseudonymise(odd, b"k", with_counts=False).collect())) == sorted(map(str, odd.collect())) and pii.pseudonymise(none, b"k").count() == 0


def test_bpe(spark, odd, none):
    path = public.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    rows = bpe.encode(odd.withColumn("n_tokens", F.lit("clash")), path, with_ids=True).collect()
    texts = {d: t or "" for d, t, *_ in ODD}
    assert len(rows) == len(ODD)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == lib.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode(none, path).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    r = random.Random(words)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, d = [], 0
    for _ in range(40):
        base = r.choices(vocabulary, k=r.choice([1, 3, 8, 30, 120]))
        for _ in range(r.choice([1, 1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(t) // 12])):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((d, " ".join(t).replace("w1 ", "W1\t")))
            d += 3
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "solo"), (-5, "SOLO"), (-6, LONG), (-7, LONG + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.link(df, words, 80).collect()}
    assert got == plain.components(rows, words, 80)


@pytest.mark.parametrize("sent", [0, near_dup.SENT])
def test_near_copies_far_from_their_hub(spark, monkeypatch, sent):
    """A chain of copies that drift: strays find the group through other members, in small blocks."""
    monkeypatch.setattr(near_dup, "SENT", sent)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    r = random.Random(6)
    rows, t = [], [f"v{k}" for k in range(60)]
    for k in range(150):
        if r.random() < 0.7:
            t = list(t)
            t[r.randrange(60)] = f"n{k}"
        u = list(t)
        for _ in range(r.choice([0, 1, 4])):
            u[r.randrange(60)] = f"m{r.random()}"
        rows.append((k, " ".join(u)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dup.link(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == plain.components(rows, 2, 80)


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = near_dup.link(odd, 2, 80).collect()
    assert len(rows) == len(ODD) and {(x.component_id, x.kept) for x in rows if x.doc_id == 3} == {(3, True)}
    assert near_dup.link(none, 2, 80).count() == 0


@pytest.mark.parametrize("sent", [0, near_dup.SENT])
def test_components(spark, monkeypatch, sent):
    """By merging of salted copies, and by facts that are sent to all tasks."""
    monkeypatch.setattr(near_dup, "SENT", sent)
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1064)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {x.id: x.component for x in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def kept_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect())


def test_near_copies_go_row_by_row(spark):
    """Rows that share a doc_id: a copy goes alone, equal rows become one, rows without id or words stay."""
    r = random.Random(2)
    a, b = (" ".join(r.choices([f"w{k}" for k in range(90)], k=60)) for _ in range(2))
    row = lambda d, t: (d, t, "en", "s", 1)
    rows = [row(1, a), row(5, a), row(5, b), row(7, b), row(7, b), row(8, "x y z u v w"), row(8, "x y z u v w"), row(None, a), row(None, a), row(9, ""), row(9, ""), row(9, None)]
    assert kept_rows(spark, rows) == sorted([("1", a), ("5", b), ("8", "x y z u v w"), ("None", a), ("None", a), ("9", ""), ("9", ""), ("9", "None")])


def test_texts_in_no_known_language_go(spark):
    """A fifth script and letter noise go, texts in the learned languages stay."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    r = random.Random(9)
    noise = " ".join("".join(r.choices("qxzjkvwyþð", k=9)) for _ in range(80))
    more = spark.createDataFrame([(-1, noise, None, "s", 1), (-2, "Привет мир это просто текст на другом языке " * 4, None, "s", 1), (-3, "12 34", None, "s", 1)], docs.schema)
    out = {x.doc_id for x in corpus_pipeline.identify_language(spark, docs.union(more), DIR).collect()}
    clean = {x.doc_id for x in spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").collect()}
    assert clean <= out and not out & {-1, -2, -3}


def test_pipeline(spark):
    """Each stage's rows by a plain version, on what the stage before kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    own = pii.Pseudonyms(llm_queries.pii_key())
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {x.doc_id: x for x in docs.collect()}
        out = stage(spark, docs, DIR).cache()
        after = {x.doc_id: x for x in out.collect()}
        assert out.columns == docs.columns and 0 < len(after) <= len(before)
        if name == "language ID":
            model = plain.Language([(x.text, x.lang) for x in before.values()])
            assert all(model.predict(before[d].text)[0] != "und" for d in after)
            assert all(model.predict(before[d].text)[1] < 0.35 or not plain.WORDS.search(before[d].text or "") for d in before.keys() - after.keys())
        elif name == "quality classifier":
            trees = quality.fit(quality.labelled(docs, spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", "quality")))
            assert after.keys() == {d for d, x in before.items() if plain.walk(trees, quality.statistics(x.text)) >= 0.3}
        elif name == "MinHash near-dedup":
            assert after.keys() == {d for d, (_, c) in plain.components([(d, x.text) for d, x in before.items()], 5, 80).items() if d == c}
        else:
            assert {d: (x.text, x.n_chars) for d, x in after.items()} == {d: (t := own.replace(x.text)[0], len(t)) for d, x in before.items()}
        assert all(x == before[d] for d, x in after.items() if name != "PII")
        docs = out
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[4][1](spark, docs, DIR).toPandas()
    want = {d: len(lib.encode(x.text, add_special_tokens=False).ids) + 1 for d, x in after.items()}
    assert packed.groupby("doc_id").length.sum().to_dict() == want
    for _, g in packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length).tolist() == g.offset.tolist()
    assert corpus_pipeline.run(spark, DIR).count() == len(packed)


@pytest.mark.parametrize("ids", ["null", "half", "same", "own"])
def test_samples_are_bounded_and_not_empty(spark, ids):
    """Whatever the ids are: neither all rows nor none."""
    of = {"null": F.lit(None).cast("long"), "half": F.when(F.col("id") % 2 == 0, F.col("id")), "same": F.lit(7).cast("long"), "own": F.col("id")}[ids]
    rows = spark.range(20_000).select(of.alias("doc_id"), F.when(F.col("id") % 2 == 0, "das haus ein").otherwise("the house of one").alias("text"), F.when(F.col("id") % 2 == 0, "de").otherwise("en").alias("lang"))
    n = language_id.sampled(rows, 1000).count()
    assert 800 <= n <= 1200
    model = language_id.fit(rows, most=1000)
    assert model.languages == ["de", "en"]
    got = {r.text: r.lang_pred for r in language_id.predict(rows.limit(20), model).collect()}
    assert got == {"das haus ein": "de", "the house of one": "en"}


def test_quality_learns_with_repeated_and_null_ids(spark):
    good, bad = "A clean sentence about houses and rivers. " * 5, "!!! $$$ ### 000 " * 20
    docs = spark.createDataFrame([(k % 5 if k % 3 else None, good if k % 2 else bad) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 5 if k % 4 else None, k % 2) for k in range(30)], "doc_id long, quality int")
    joined = quality.labelled(docs, labels, most=10)
    assert joined.where("doc_id is null").count() == 0
    assert 0 <= quality.score(docs, quality.fit(joined, most=10)).agg(F.min("score")).first()[0] <= 1


@pytest.mark.parametrize("number", ["+33 6 12 34 56 78", "+1 555 123 4567", "+49 (30) 1234567", "+44 20 7946 0958", "+4915112345678"])
def test_numbers_of_all_groupings(number):
    own = pii.Pseudonyms(b"k" * 64)
    text, counts = own.replace(f"tel {number}, or so")
    new = text[4 : 4 + len(number)]
    assert counts["phone"] == 1 and new != number and text == f"tel {new}, or so"
    assert [c for c in new if not c.isdigit()] == [c for c in number if not c.isdigit()]
