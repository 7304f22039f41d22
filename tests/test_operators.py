import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import access, checks, graph, outbox, retrieve, temporal, vectors
from lattica.sources import logs

T = "2024-01-15 00:00:00"


def value(spark, c):
    return spark.range(1).select(c).first()[0]


def test_authority_shares(spark):
    for (a, b), want in {(0, 0): 0.5, (0, 100): 10 / 110, (100, 0): 100 / 110, (90, 50): 9 / 14, (-50, 50): 10 / 60, (150, 50): 100 / 150}.items():
        assert value(spark, vectors.share(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_edge_vector(spark):
    rows = [(1, 50, 50, [2.0, 0.0, 0.0, 0.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 4.0, 0.0]), (2, 50, 50, [1.0], [-1.0], [0.0]), (3, 1, 1, None, [1.0], [1.0]), (4, 1, 1, [1.0], [1.0, 2.0], [1.0]), (5, 1, 1, [1.0], [1.0], None)]
    df = spark.createDataFrame(rows, "edge_id long, auth_s int, auth_t int, v_s array<float>, v_t array<float>, v_type array<float>")
    got = {r.edge_id: r for r in vectors.edge_vectors(df).collect()}
    n = math.sqrt(2 * 0.65**2 + 1.4**2)
    assert got[1].vector == pytest.approx([0.65 / n, 0.65 / n, 1.4 / n, 0], abs=1e-5)
    assert [got[k].outcome for k in range(1, 6)] == ["completed", "zero vector", "missing endpoint vector", "dimensions differ", "missing type vector"]


def test_interleaving_equals_the_loop(spark):
    r = random.Random(1)
    a, b, want = [], [], []
    for q in range(200):
        n, m, limit = r.randint(0, 6), r.randint(0, 6), 7
        a += [(q, k, 100 + k) for k in range(n)]
        b += [(q, k, 200 + k) for k in range(m)]
        x, y, out = [100 + k for k in range(n)], [200 + k for k in range(m)], []
        while x or y:
            out += [x.pop(0)] if x else []
            out += [y.pop(0)] if y else []
        want += [(q, k + 1, i) for k, i in enumerate(out[:limit])]
    schema = "query_id long, rank long, id long"
    got = retrieve.interleave(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 7)
    assert sorted((r.query_id, r.pos, r.id) for r in got.collect()) == want


def test_packing_skips_what_does_not_fit(spark):
    chunk = lambda i, t: {"id": i, "text": t}
    rows = [(1, 1, "chunk", 1, [chunk(1, "a" * 50)]), (1, 2, "chunk", 2, [chunk(2, "b" * 500)]), (1, 3, "relationship", 9, [chunk(1, "a" * 50), chunk(3, "c")]), (1, 4, "chunk", 1, [chunk(1, "a" * 50)]), (1, 5, "chunk", 4, [chunk(4, "d")])]
    df = spark.createDataFrame(rows, "query_id long, pos int, kind string, key long, chunks array<struct<id:long,text:string>>")
    r = retrieve.pack(df, 200, 20).first()
    assert r.included == ["chunk:1", "relationship:9", "chunk:4"] and r.sources == [1, 3, 4] and '<relation of="1" to="2"/>' in r.prompt
    assert retrieve.pack(df, 200, 1).first().included == ["chunk:1"]
    assert value(spark, retrieve.escaped(F.lit('<a&"b">'))) == "&lt;a&amp;&quot;b&quot;&gt;"
    with pytest.raises(ValueError):
        retrieve.checked_limit(0)
    with pytest.raises(ValueError):
        retrieve.page(df, [F.col("pos")], 201)


def test_points(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, v string, w string")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(vectors.upsert(p, spark.createDataFrame([(2, "c", "y"), (3, "d", "z")], p.schema), ["id"])) == [(1, "a", "x"), (2, "c", "y"), (3, "d", "z")]
    assert key(vectors.patch(p, spark.createDataFrame([(2, "n")], "id long, w string"), ["id"])) == [(1, "a", "x"), (2, "b", "n")]
    ids = spark.createDataFrame([(2,), (9,)], "id long")
    assert key(vectors.fetch(p, ids, ["id"])) == [(2, "b", None)] and key(vectors.remove(p, ids, ["id"])) == [(1, "a", "x")]
    assert [vectors.over_fetch(n) for n in (10, 5000)] == [40, 10_000] and vectors.over_fetch(3, 0) == 3


def test_scope_cache_holds_only_with_both_epochs(spark):
    entry = spark.createDataFrame([(1, u, a, s, ms) for u, a, s, ms in ((1, 1, 1, 1705276800001), (2, 0, 1, 1705276800001), (3, 1, 1, 1705276800000), (4, 1, 0, 1705276800001))], "company_id long, user_id long, acl_epoch long, scope_epoch long, cache_until_ms long")
    live = spark.createDataFrame([(1, u, 1, 1) for u in range(1, 5)], "company_id long, user_id long, acl_epoch long, scope_epoch long")
    assert [r.user_id for r in access.cached(entry, live, T).collect()] == [1]


def test_history_and_as_of(spark):
    feed = spark.createDataFrame([(1, 1, "2024-01-01", "insert", "a"), (1, 2, "2024-01-03", "update", "b"), (1, 3, "2024-01-05", "delete", "b")], "id long, seq long, ts string, op string, v string").withColumn("ts", F.col("ts").cast("timestamp"))
    h = temporal.history(feed, ["id"])
    at = lambda t: [r.v for r in temporal.as_of(h, t).collect()]
    assert [at(t) for t in ("2023-12-31", "2024-01-01", "2024-01-03", "2024-01-05")] == [[], ["a"], ["b"], []]
    assert h.where("valid_from = valid_to").count() == 1


def test_promotion(spark):
    v = spark.createDataFrame([(1, 1, "active", "2024-01-01", None), (1, 2, "draft", None, None), (2, 1, "archived", None, None)], "doc_id long, version int, lifecycle string, activated_at string, superseded_at string")
    v = v.withColumns({c: F.col(c).cast("timestamp") for c in ("activated_at", "superseded_at")})
    want = spark.createDataFrame([(1, 2)], "doc_id long, version int")
    once = temporal.promote(v, want, T)
    assert sorted((r.version, r.lifecycle, r.superseded_at is None) for r in once.where("doc_id = 1").collect()) == [(1, "deprecated", False), (2, "active", True)]
    assert sorted(map(tuple, temporal.promote(once, want, "2024-02-01").collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    with pytest.raises(temporal.PromotionError):
        temporal.promote(v, spark.createDataFrame([(2, 1)], "doc_id long, version int"), T)


def test_sign_in_brings_users_back(spark):
    users = spark.createDataFrame([("i", "a", "old", T, None), ("i", "b", "b", T, None)], "issuer string, subject string, email string, deactivated_at string, last_seen string").withColumns({c: F.col(c).cast("timestamp") for c in ("deactivated_at", "last_seen")})
    seen = spark.createDataFrame([("i", "a", "new"), ("i", "c", "c")], "issuer string, subject string, email string")
    assert sorted((r.subject, r.email, r.deactivated_at is None) for r in temporal.sign_in(users, seen, T).collect()) == [("a", "new", True), ("b", "b", False), ("c", "c", True)]


def test_backoff_and_sweeps(spark):
    assert [value(spark, outbox.backoff(F.lit(n))) for n in (0, 1, 3, 8, 9, 40)] == [1, 2, 8, 256, 300, 300]
    points = spark.createDataFrame([(1,), (2,)], "id long")
    assert outbox.orphans(points, points.where("id = 1"), ["id"]).collect()[0].id == 2


def test_violations_are_found(spark):
    units = spark.createDataFrame([(1, 1, None, "r"), (1, 2, None, "s"), (1, 3, 1, "x"), (1, 4, 1, "x"), (1, 5, 99, "y")], "company_id long, unit_id long, parent_id long, name string")
    members = spark.createDataFrame([(1, 7, 77)], "company_id long, user_id long, unit_id long")
    grants = spark.createDataFrame([(1, "document", 5, access.SUB, 11), (1, "document", 6, access.SELF, 12), (1, "org_unit", 3, access.SUB, 13), (1, "org_unit", 88, access.SELF, 14)], "company_id long, resource_type string, resource_id long, resource_applies_to string, grant_id long")
    docs = spark.createDataFrame([(1, 5)], "company_id long, doc_id long")
    versions = spark.createDataFrame([(5, "active", T, None), (5, "active", None, None), (6, "deprecated", T, "2024-01-01 00:00:00")], "doc_id long, lifecycle string, activated_at string, superseded_at string")
    edges = spark.createDataFrame([(1, 5, 5, 0.5), (2, 5, 9, 1.5)], "edge_id long, source_doc long, target_doc long, confidence double")
    got = {(r.rule, r.key) for r in checks.violations(units, members, grants, docs, versions, edges).collect()}
    assert got == {("one root", "1"), ("sibling names differ", "1:1:x"), ("parent exists", "5"), ("membership unit exists", "7"), ("only unit grants reach down", "11"), ("granted document exists", "12"), ("granted unit exists", "14"),
                   ("one active version", "5"), ("active is activated and not superseded", "5"), ("superseded after activated", "6"), ("endpoints differ", "1"), ("confidence from 0 to 1", "2"), ("endpoint exists", "2")}
    was = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    assert sorted(r.key for r in checks.changed(was, was.where("id < 3").withColumn("t", F.when(F.col("id") == 2, "z").otherwise(F.col("t"))), ["id"], ["t"], "frozen").collect()) == ["2", "3"]


def test_paths_and_their_vector(spark):
    e = spark.createDataFrame([(1, 1, 2, 0.5), (2, 2, 3, 0.5), (3, 3, 1, 0.0), (4, 3, 4, 1.0)], "edge_id long, source long, target long, confidence double")
    got = {tuple(r.nodes): round(r.score, 6) for r in graph.paths(e, spark.createDataFrame([(1,)], "start long"), spark.createDataFrame([(k, 1.0) for k in range(1, 9)], "node long, factor double"), 3, policy=True).collect()}
    assert got == {(1, 2): 0.5, (1, 2, 3): 0.4, (1, 2, 3, 4): round(0.25 ** (1 / 3) * 0.64, 6)}
    v = spark.createDataFrame([([[3.0, 0.0], [0.0, 5.0]], [1.0, 1.0])], "v array<array<double>>, c array<double>")
    assert v.select(graph.path_vector(F.col("v"), F.col("c"), 2)).first()[0] == pytest.approx([3 / 5, 4 / 5])


def test_logs_only_grow(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-05-05")], "company_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    logs.append(rows, str(tmp_path / "log"))
    logs.append(rows, str(tmp_path / "log"))
    assert logs.tenant(spark, str(tmp_path / "log"), 1).count() == 2 and (tmp_path / "log/year=2024/month=5").exists()
    with pytest.raises(logs.AppendOnly):
        logs.append(rows, str(tmp_path / "log"), mode="overwrite")
    (tmp_path / "m.json").write_text('[{"url": "b", "file_type": "pdf", "company_tag": "x", "license": "l"}, {"url": "a", "file_type": "pdf", "company_tag": "x", "license": "l"}]')
    assert [r.url for r in logs.manifest(spark, str(tmp_path / "m.json"), file_type="pdf", limit=1).collect()] == ["a"]
