"""Histories in parts, forests in order, partitions, indexes, intents and measures, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph, hierarchy, retrieve, temporal, vectors


@pytest.mark.parametrize("seed", range(3))
def test_any_split_of_a_feed_gives_its_history(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), k, rng.randrange(20), rng.choice(["update", "update", "delete"]), rng.random()) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, seq long, at long, op string, x double").withColumn("ts", F.timestamp_seconds(F.col("at") * 3600)).drop("at")
    key = lambda d: sorted(map(tuple, d.select("id", "seq", "op", "x", "valid_from", "valid_to").collect()), key=str)
    h = temporal.History(spark, str(tmp_path / "h"), ["id"])
    parts = [rng.randrange(3) for _ in range(60)]
    for p in range(3):
        h.append(df.where(F.col("seq").isin([k for k in range(60) if parts[k] == p])))
    assert key(h.rows()) == key(temporal.history(df, ["id"]))


def test_parts_in_order_reopen_nothing(spark, tmp_path):
    df = spark.range(30).select((F.col("id") % 4).alias("id"), F.col("id").alias("seq"), F.lit("update").alias("op"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    h = temporal.History(spark, str(tmp_path / "h"), ["id"])
    for p in range(3):
        h.append(df.where(f"seq div 10 = {p}"))
    assert h.open.count() == 4 and sum(c.count() for c in h.closed) == 26 and len(h.closed) == 3


def test_forests_in_order(spark):
    rng = random.Random(4)
    units = [(1, 0, None, "root")] + [(1, k, rng.randrange(k), rng.choice(["a", "b", "B", "é"])) for k in range(1, 40)] + [(2, 100, None, "other")]
    seen = [(1, u, k) for u in range(6) for k in range(40) if rng.random() < 0.6] + [(2, 9, 100), (1, 0, 5), (1, 0, 5)]
    df = spark.createDataFrame(units, "company_id long, unit_id long, parent_id long, name string")
    got = hierarchy.charts(df, spark.createDataFrame(seen, "company_id long, user_id long, unit_id long"))
    of = {k: (p, n) for _, k, p, n in units}
    want = []
    for user in {u for _, u, _ in seen}:
        mine = {k for _, u, k in seen if u == user}
        company = 2 if user == 9 else 1
        order = []

        def walk(at, depth):
            for k in sorted(at, key=lambda k: (of[k][1].encode(), k)):
                order.append((k, depth))
                walk([x for x in mine if of[x][0] == k], depth + 1)

        walk([k for k in mine if of[k][0] not in mine], 0)
        want += [(company, user, pos, k, depth, None) for pos, (k, depth) in enumerate(order)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_forests_have_bounds(spark, monkeypatch):
    chain = spark.range(70).select(F.lit(1).cast("long").alias("company_id"), F.col("id").alias("unit_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("n").alias("name"))
    seen = chain.select("company_id", F.explode(F.expr("array(1L, 2L)")).alias("user_id"), "unit_id").where("user_id = 1 or unit_id <= 64")
    rows = hierarchy.charts(chain, seen).collect()
    assert [(r.user_id, r.error) for r in rows if r.error] == [(1, "too deep")]
    assert sorted(r.depth for r in rows if r.user_id == 2) == list(range(65))
    monkeypatch.setattr(hierarchy, "MOST_UNITS", 69)
    assert sorted((r.user_id, r.error, r.unit_id) for r in hierarchy.charts(chain, seen).collect()) == [(1, "too large", None), (2, "too large", None)]


def test_partitions_are_swept(spark):
    make = lambda rows: spark.createDataFrame(rows, "kind string, starts int, ends int")
    expected = make([("m", k, k + 1) for k in range(8)])
    # A long one that overlaps all up to 5, a gap before 7, one that ends late, one twice.
    actual = make([("m", 0, 5), ("m", 1, 2), ("m", 3, 4), ("m", 4, 6), ("m", 7, 9), ("m", 7, 8), ("m", 6, 6), ("q", 0, 9)])
    got = sorted(map(tuple, temporal.partition_problems(actual, expected).collect()))
    assert got == sorted([
        ("m", 0, "wrong bounds"), ("m", 2, "missing"), ("m", 4, "wrong bounds"), ("m", 5, "missing"), ("m", 6, "wrong bounds"), ("m", 7, "wrong bounds"),
        ("m", 1, "overlap"), ("m", 3, "overlap"), ("m", 4, "overlap"), ("m", 7, "gap before"), ("m", 7, "overlap"), ("m", 6, "empty"),
    ])


def test_index_by_units(spark):
    p = spark.createDataFrame([(1, 1, 10, "active", "public", [5, 6, 6]), (1, 2, 20, "draft", "public", [5]), (1, 3, 30, "active", "restricted", [5]), (2, 4, 40, "active", "public", [5]), (1, 5, 50, "active", "public", []), (1, 6, 60, "active", "public", None)],
                              "company_id long, doc_id long, chunk_id long, lifecycle string, sensitivity string, scope_ids array<long>")
    scope = spark.createDataFrame([(1, 7, 5), (1, 7, 6), (1, 8, 9)], "company_id long, user_id long, unit_id long")
    assert [tuple(r) for r in vectors.prefilter(vectors.postings(p), scope, ["public"]).collect()] == [(1, 7, 1, 10)]
    assert vectors.prefilter(vectors.postings(p), scope, []).count() == 0


def test_intents(spark):
    asked = [(1, "fact", False, []), (2, "bridge", False, ["a"]), (3, "bridge", True, []), (4, "automatic", False, []), (5, "automatic", True, None), (6, "bridge", True, ["a"]), (7, "automatic", True, ["a", "b"]), (8, None, True, ["a"]), (9, "other", None, ["a"])]
    requests = spark.createDataFrame(asked, "query_id long, intent string, has_edges boolean, states array<string>")
    chunks = spark.createDataFrame([(q, k, 100 + k) for q in range(1, 10) for k in range(3)], "query_id long, rank int, id long")
    edges = spark.createDataFrame([(q, k, 200 + k, "ab"[k % 2]) for q in range(1, 10) for k in range(3)], "query_id long, rank int, id long, review_state string")
    outcomes, evidence = retrieve.by_intent(requests, chunks, edges, 5)
    assert {r.query_id: r.outcome for r in outcomes.collect()} == {1: "ok", 2: "unavailable", 3: "invalid_input", 4: "ok", 5: "invalid_input", 6: "ok", 7: "ok", 8: "invalid_input", 9: "invalid_input"}
    found = {}
    for r in sorted(evidence.collect(), key=lambda r: (r.query_id, r.pos)):
        found.setdefault(r.query_id, []).append(r.id)
    assert found == {1: [100, 101, 102], 4: [100, 101, 102], 6: [200, 202], 7: [100, 200, 101, 201, 102]}
    with pytest.raises(ValueError):
        retrieve.by_intent(requests, chunks, edges, 0)


def test_measures_see_what_is_wrong(spark):
    evidence = spark.createDataFrame([(1, 7, "a", 10), (1, 7, "b", 10), (1, 7, "b", 11), (2, 8, "c", 10)], "query_id long, user_id long, key string, doc_id long")
    visible = spark.createDataFrame([(7, 10), (8, 11)], "user_id long, doc_id long")
    assert {r.query_id: (r.n, r.precision) for r in graph.authorised(evidence, visible).collect()} == {1: (2, 0.5), 2: (1, 0.0)}
    found = spark.createDataFrame([(1, 1, 5), (1, 11, 6), (2, 3, 5)], "query_id long, rank int, id long")
    wanted = spark.createDataFrame([(1, 6), (2, 5), (2, 9), (3, 5)], "query_id long, id long")
    assert {r.query_id: r.found for r in graph.bridges(found, wanted, 10).collect()} == {1: False, 2: True, 3: False}
