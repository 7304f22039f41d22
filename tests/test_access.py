"""Random trees and grants: both ways of deciding visibility against plain Python."""

import random

import pytest

from lattica.operators import access, gates, hierarchy

T, LATE, EARLY = "2024-01-15 00:00:00", "2024-02-01 00:00:00", "2024-01-01 00:00:00"


def trial(seed):
    """One tenant: units, memberships, documents, grants."""
    r = random.Random(seed)
    units = [(seed, 1, None)]
    for k in range(2, r.randint(8, 15)):
        units.append((seed, k, r.choice(units)[1]))
    ids = [u[1] for u in units]
    applies = lambda: r.choice([access.SUB, access.SELF])
    expiry = lambda: r.choice([None, None, EARLY, LATE])
    members = [(seed, u, r.choice(ids), applies(), r.choice(list(access.ROLES)), expiry()) for u in range(r.randint(3, 5)) for _ in range(r.randint(1, 2))]
    groups = [(seed, g, r.choice(ids), applies(), "viewer", expiry()) for g in range(2)]
    in_group = [(seed, r.randint(0, 1), u) for u in range(5) if r.random() < 0.5]
    docs = [(seed, seed * 100 + d, r.choice(ids)) for d in range(r.randint(3, 6))]
    grants = []
    for g in range(r.randint(4, 8)):
        on_doc = r.random() < 0.5
        grants.append((seed, "document" if on_doc else "org_unit", r.choice(docs)[1] if on_doc else r.choice(ids), r.choice(ids), access.SELF if on_doc else applies(), applies(), r.choice(["read", "write", "admin", "none"]), expiry(), g))
    return units, members, groups, in_group, docs, grants


def expected(units, members, groups, in_group, docs, grants):
    parent = {u: p for _, u, p in units}

    def above(u):
        out = []
        while u is not None:
            out.append(u)
            u = parent[u]
        return out

    alive = lambda e: e is None or e > T
    reach = lambda unit, applies: {u for u in parent if (unit in above(u) if applies == access.SUB else u == unit)}
    scope = {}
    for _, u, unit, applies, _, e in members + [(c, u, unit, a, role, e) for c, g, unit, a, role, e in groups for _, g2, u in in_group if g2 == g]:
        if alive(e):
            scope.setdefault(u, set()).update(reach(unit, applies))
    seen = set()
    for _, d, owner in docs:
        readers = {owner}
        for _, kind, res, principal, res_applies, applies, permission, e, _ in grants:
            if alive(e) and permission in access.READING and (res == d if kind == "document" else owner in reach(res, res_applies)):
                readers |= reach(principal, applies)
        seen |= {(u, d) for u, s in scope.items() if s & readers}
    return seen


def frames(spark, trials):
    parts = [[row for t in trials for row in t[k]] for k in range(6)]
    units = spark.createDataFrame(parts[0], "company_id long, unit_id long, parent_id long")
    when = "expires_at string"
    members = spark.createDataFrame(parts[1], f"company_id long, user_id long, unit_id long, applies_to string, role string, {when}").withColumn("expires_at", access.F.col("expires_at").cast("timestamp"))
    groups = spark.createDataFrame(parts[2], f"company_id long, group_id long, unit_id long, applies_to string, role string, {when}").withColumn("expires_at", access.F.col("expires_at").cast("timestamp"))
    in_group = spark.createDataFrame(parts[3], "company_id long, group_id long, user_id long")
    docs = spark.createDataFrame(parts[4], "company_id long, doc_id long, owner_unit_id long")
    grants = spark.createDataFrame(parts[5], f"company_id long, resource_type string, resource_id long, principal_id long, resource_applies_to string, principal_applies_to string, permission string, {when}, grant_id long").withColumn("expires_at", access.F.col("expires_at").cast("timestamp"))
    return units, members, groups, in_group, docs, grants


def test_visibility_of_random_tenants(spark):
    """Forty tenants at once: neither a document too many nor one too few."""
    trials = [trial(seed) for seed in range(1, 41)]
    units, members, groups, in_group, docs, grants = frames(spark, trials)
    tree = hierarchy.closure(units).cache()
    scope = access.reader_scope(access.all_memberships(members, groups, in_group, T), tree).cache()
    got = {tuple(r) for r in access.visible_docs(scope, docs, grants, tree, T).collect()}
    meet = {tuple(r) for r in scope.join(access.resource_scope(docs, grants, tree, T), ["company_id", "unit_id"]).select("company_id", "user_id", "doc_id").distinct().collect()}
    want = {(seed, u, d) for seed, t in enumerate(trials, 1) for u, d in expected(*t)}
    assert want and got - want == set() and want - got == set()
    assert meet == want


def test_move_keeps_closure_equal(spark):
    units = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 9, None)], "company_id long, unit_id long, parent_id long")
    moved = hierarchy.closure(hierarchy.move_unit(units, 1, 2, 4))
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, hierarchy.relink(hierarchy.closure(units), 1, 2, 4).collect()))
    for node, parent in ((2, 3), (1, 4), (2, 9)):
        try:
            hierarchy.move_unit(units, 1, node, parent)
        except hierarchy.MoveError:
            continue
        raise AssertionError((node, parent))


def test_clearance_stops_at_confidential():
    assert all(access.clearance(p) == ["public", "internal", "confidential"] for p in ("member", "admin", "service"))


def readers(spark, scope, documents, grants=(), tree=()):
    """``documents``: (company_id, doc_id, owner_unit_id, deleted)."""
    return access.Readers(
        spark.createDataFrame(scope, "company_id long, user_id long, unit_id long"), spark.createDataFrame(documents, "company_id long, doc_id long, owner_unit_id long, deleted boolean"),
        spark.createDataFrame(grants, "company_id long, resource_type string, resource_id long, principal_id long, resource_applies_to string, principal_applies_to string, permission string, expires_at timestamp, grant_id long"),
        spark.createDataFrame(tree, "company_id long, ancestor long, descendant long, depth int"), "2024-01-15 00:00:00",
    )


def test_gates_are_closed_without_labels_or_candidates(spark):
    c = spark.createDataFrame([(1, 1, 1, 1, 7)], "query_id long, user_id long, company_id long, rank long, chunk_id long")
    chunks = spark.createDataFrame([(1, 7, 5, 70, "x")], "company_id long, chunk_id long, doc_id long, section_id long, content string")
    versions = spark.createDataFrame([(1, 5, 1, "active", "public")], "company_id long, doc_id long, version int, lifecycle string, sensitivity string")
    docs = [(1, 5, 3, False)]
    seen, blind = readers(spark, [(1, 1, 3)], docs), readers(spark, [], docs)
    rows = lambda *a, **k: gates.gate_chunks(*a, **k).rows.collect()
    ok = lambda *a, **k: len(rows(*a, **k))
    assert ok(c, seen, versions, chunks, ["public"]) == 1
    assert ok(c.union(c), seen, versions, chunks, ["public"]) == 1
    assert ok(c, seen, versions, chunks, []) == 0 and ok(c, seen, versions, chunks, ["public"], lifecycle=[]) == 0
    assert ok(c.limit(0), seen, versions, chunks, ["public"]) == 0 and ok(c, blind, versions, chunks, ["public"]) == 0
    assert ok(c, seen, versions, chunks, ["public"], tombstones=seen.documents.select("company_id", "doc_id")) == 0
    # The section's heading, or none.
    titled = spark.createDataFrame([(1, 70, "Part")], "company_id long, section_id long, heading string")
    assert [r.heading for r in rows(c, seen, versions, chunks, ["public"], sections=titled)] == ["Part"]
    assert [r.heading for r in rows(c, seen, versions, chunks, ["public"], sections=titled.where("section_id < 0"))] == [None]


def test_pairs_are_decided_like_whole_sets(spark):
    """Random trees, grants and pairs: what meets as sets is what the pairs' way lets through."""
    for seed in range(6):
        r = random.Random(seed)
        units = [(1, 1, None), *((1, k, r.randrange(1, k)) for k in range(2, 12))]
        tree = hierarchy.closure(spark.createDataFrame(units, "company_id long, unit_id long, parent_id long"))
        docs = [(1, d, r.randrange(1, 12), False) for d in range(8)]
        axis = lambda: r.choice([access.SUB, access.SELF])
        grants = [(1, "document", r.randrange(8), r.randrange(1, 12), access.SELF, axis(), r.choice(["read", "none"]), None, k) for k in range(5)] + [(1, "org_unit", r.randrange(1, 12), r.randrange(1, 12), axis(), axis(), "read", None, k) for k in range(5, 8)]
        members = spark.createDataFrame([(1, u, r.randrange(1, 12), axis()) for u in range(6)], "company_id long, user_id long, unit_id long, applies_to string")
        q = readers(spark, access.reader_scope(members, tree).collect(), docs, grants, tree.collect())
        meet = q.scope.join(access.resource_scope(q.documents, q.grants, q.tree, q.t), ["company_id", "unit_id"]).select("company_id", "user_id", "doc_id").distinct()
        pairs = spark.createDataFrame([(r.choice([1, 1, 1, 2]), r.randrange(7), r.randrange(9)) for _ in range(40)], "company_id long, user_id long, doc_id long")
        key = lambda df: sorted(map(tuple, df.collect()))
        assert key(q.among(pairs)) == key(pairs.distinct().join(meet, ["company_id", "user_id", "doc_id"], "left_semi"))
        assert key(access.visible_docs(q.scope, q.documents, q.grants, q.tree, q.t)) == key(meet)


def test_deep_trees(spark):
    """Far deeper than a recursive query's bound, with a fork, an orphan and a cycle."""
    chain = [(1, 1, None), *((1, k, k - 1) for k in range(2, 151)), (1, 900, 75), (2, 5, None)]
    df = spark.createDataFrame(chain, "company_id long, unit_id long, parent_id long")
    got = sorted(map(tuple, hierarchy.closure(df).collect()))
    want = [(1, a, d, d - a) for d in range(1, 151) for a in range(1, d + 1)] + [(1, 900, 900, 0), *((1, a, 900, 76 - a) for a in range(1, 76)), (2, 5, 5, 0)]
    assert got == sorted(want)
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(spark.createDataFrame([(1, 1, 2), (1, 2, 1)], df.schema)).count()
    assert hierarchy.closure(df.limit(0)).count() == 0
    turns = spark.createDataFrame([*chain, (1, 700, 701), (3, 1, 2), (3, 2, 1)], "conv_id long, turn long, parent_turn long")
    rows = {(r.conv_id, r.turn): (r.depth, r.path) for r in hierarchy.reply_paths(turns).collect()}
    assert len(rows) == 152 and rows[1, 150] == (149, "/".join(map(str, range(1, 151)))) and rows[1, 900] == (75, "/".join(map(str, [*range(1, 76), 900]))) and rows[2, 5] == (0, "5")
