"""Work that grows with users, groups and documents by themselves, not with their products."""

import random

from lattica.operators import access, checks, graph, vectors

T = "2024-01-15 00:00:00"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cohorts_equal_their_member_rows(spark):
    r = random.Random(3)
    groups = spark.createDataFrame([(1, g, g % 3) for g in range(9)], "company_id long, group_id long, cohort long")
    users = spark.createDataFrame([(1, u, u % 4) for u in range(20)], "company_id long, user_id long, cohort long")
    cohorts = access.Cohorts(groups, users)
    members = groups.join(users, ["company_id", "cohort"]).select("company_id", "group_id", "user_id")
    of = spark.createDataFrame([(1, g, r.randrange(3), "self_only", "viewer") for g in range(9)], "company_id long, group_id long, unit_id long, applies_to string, role string").withColumn("expires_at", access.F.lit(None).cast("timestamp"))
    direct = users.limit(0).selectExpr("company_id", "user_id", "1L unit_id", "'self_only' applies_to", "'viewer' role", "cast(null as timestamp) expires_at")
    got = rows(access.all_memberships(direct, of, cohorts, T))
    assert got and got == rows(access.all_memberships(direct, of, members, T))
    units = groups.select("company_id")
    one = members.selectExpr("company_id", "user_id old_user", "user_id + 1 new_user")
    many = cohorts.counts().selectExpr("company_id", "user_id old_user", "user_id + 1 new_user", "n")
    assert many.count() == 15 and one.count() == 45
    assert rows(access.epoch_bumps(units, many)[1]) == rows(access.epoch_bumps(units, one)[1])


def test_one_user_stands_for_all_of_a_scope(spark):
    scope = spark.createDataFrame([(1, u, k) for u in range(30) for k in range(1 + u % 3)] + [(2, 99, 0)], "company_id long, user_id long, unit_id long")
    everyone = spark.createDataFrame([(1, u) for u in range(32)] + [(2, 99)], "company_id long, user_id long")
    assert {r.user_id: r.like for r in access.alike(scope).collect()} == {**{u: u % 3 for u in range(30)}, 99: 99}
    assert {r.user_id: r.like for r in access.alike(scope, everyone).where("user_id in (30, 31)").collect()} == {30: 30, 31: 30}
    like = access.alike(scope)
    assert {r.user_id for r in access.only(scope, like).collect()} == {0, 1, 2, 99}
    seen = spark.createDataFrame([(1, 1, 7)], "company_id long, user_id long, doc_id long")
    assert sorted(r.user_id for r in access.shared(seen, like).collect()) == list(range(1, 30, 3))


def test_snapshots_take_the_votes_of_a_board(spark):
    sessions = spark.createDataFrame([(1, "active", 5), (2, 'a"b', 5), (3, None, 6)], "session_id long, state string, board long")
    scopes = spark.createDataFrame([(1, 9), (1, 3)], "session_id long, unit_id long")
    votes = spark.createDataFrame([(5, 8, "reject"), (5, 2, "approve")], "board long, approver long, decision string")
    both = '"approvals":[{"approver":2,"decision":"approve"},{"approver":8,"decision":"reject"}]}'
    got = {r.session_id: r.snapshot for r in checks.snapshots(sessions, scopes, votes).collect()}
    assert got == {1: '{"session_id":1,"state":"active","scopes":[3,9],' + both, 2: '{"session_id":2,"state":"a\\"b","scopes":[],' + both, 3: '{"session_id":3,"scopes":[],"approvals":[]}'}


def test_searches_by_tiles_equal_all_pairs(spark, monkeypatch):
    """Ties beyond k, near ties, nulls, other lengths and not a number, in small tiles: the same rows as pair by pair."""
    for name, n in (("BLOCK", 7), ("STRIPE", 5), ("ROWS", 4), ("HELD", 16)):
        monkeypatch.setattr(vectors, name, n)
    r = random.Random(5)
    make = lambda: r.choice([None, [1.0, None, 0.0], [2.0], [], [float("nan"), 1.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0000004, 0.0, 0.0], *[[r.gauss(0, 1) for _ in range(3)] for _ in range(9)]])
    points = spark.createDataFrame([(k, make()) for k in range(90)], "chunk_id long, v array<double>")
    queries = spark.createDataFrame([(k, make()) for k in range(20)], "query_id long, q array<double>")
    pairs = vectors.meet(points, queries).select("query_id", "chunk_id", vectors.F.round(vectors.dot("v", "q"), 6).alias("score")).cache()
    text = lambda df: list(map(str, rows(df)))  # noqa: E731  not a number equals itself
    for k in (3, 40, 100):
        assert text(vectors.search(points, queries, k)) == text(vectors.best(pairs, k))
    each = vectors.products(points, queries, ["chunk_id"])
    assert text(each.select("query_id", "chunk_id", vectors.F.round("score", 6).alias("score"))) == text(pairs)
    assert vectors.search(points.limit(0), queries, 3).count() == 0 and vectors.search(points, queries.limit(0), 3).count() == 0


def test_pages_are_reached_by_the_slugs_they_name(spark):
    """Many pages of one slug, a cycle, a link to oneself and one to nobody: as with every pair of pages."""
    r = random.Random(7)
    pages = spark.createDataFrame([(p, f"s{p % 12}") for p in range(60)], "page_id long, slug string")
    links = spark.createDataFrame([(p, f"s{r.randrange(13)}") for p in range(60) if r.random() < 0.7] + [(3, "s3")], "page_id long, slug string")
    first = spark.createDataFrame([(3,), (40,)], "page long")
    pairs = links.join(pages.withColumnRenamed("page_id", "target"), "slug").selectExpr("page_id source", "target")
    got = rows(graph.reached_by_name(pages, links, first))
    assert len({h for _, h in got}) > 2 and got == rows(graph.reached(pairs, first))
