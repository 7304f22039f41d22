"""Users of one scope as lists that meet documents in tiles: whatever their sizes, the rows are the same, list by list."""

import pytest

from lattica.operators import access
from lattica.plans.model import AS_OF, Model
from lattica.plans.queries import QUERIES, scope

DIR = "/root/testdata/sf0.001"


def small(monkeypatch, size: int) -> None:
    for name, n in (("LIST", size), ("LISTS", 2), ("ROWS", 9), ("LEAST", 4), ("TILES", 1)):
        monkeypatch.setattr(access, name, n, raising=False)


@pytest.fixture(scope="module")
def m(spark):
    return Model(spark, DIR)


def test_lists_hold_each_user_once(spark, monkeypatch):
    small(monkeypatch, 8)
    like = spark.createDataFrame([(u % 2, u, u % 6 if u < 400 else 1000 + u) for u in range(450)], "company_id long, user_id long, like long")
    crowd = access.in_lists(like, ["user_id"])
    lists = crowd.lists.collect()
    assert sorted((r.company_id, u, r.like) for r in lists for u in r.user_id) == sorted(map(tuple, like.collect()))
    assert max(len(r.user_id) for r in lists) == 8 and sum(len(r.user_id) < 8 for r in lists) <= 6 + 50 and 1 < len({r.block for r in lists}) <= crowd.blocks and crowd.companies == 2
    assert access.in_lists(like.limit(0)).lists.count() == 0


@pytest.mark.parametrize("size", [2, 504])
def test_all_sizes_give_the_same_documents(m, monkeypatch, size):
    small(monkeypatch, size)
    s = scope(m)
    got = sorted(map(tuple, access.visible_docs(s, m.documents, m.grants, m.closure, AS_OF).collect()))
    assert got == sorted(map(tuple, access.visible_to(s, m.documents, m.grants, m.closure, AS_OF).collect()))


def test_rows_come_list_by_list(m, spark):
    """Document by document, other users come with each: a result that nothing makes smaller on disk."""
    users = spark.createDataFrame([(1, u, 30 * (u // 30)) for u in range(300)], "company_id long, user_id long, like long")
    own = spark.createDataFrame([(1, u, 101) for u in range(300)], "company_id long, user_id long, unit_id long")
    docs = spark.range(400).selectExpr("1L company_id", "id doc_id", "101L owner_unit_id")
    tree = spark.createDataFrame([(1, 101, 101, 0)], "company_id long, ancestor long, descendant long, depth int")
    rows = access.visible_docs(own, docs, m.grants, tree, AS_OF, users)
    turns = rows.rdd.mapPartitions(lambda it: [(lambda x: (len(x), 1 + sum(a // 30 != b // 30 for a, b in zip(x, x[1:]))))([r.user_id for r in it])]).collect()
    assert sum(n for n, _ in turns) == 300 * 400 and all(changes <= 10 * 2 for n, changes in turns if n)


def test_gates_of_all_decide_no_pairs(spark, monkeypatch):
    """Pairs of scopes and documents grow with their product, so none are stored or sent: documents and edges are decided."""
    def refuse(self, pairs):
        raise AssertionError("pairs are decided")

    small(monkeypatch, 4)
    monkeypatch.setattr(access.Readers, "among", refuse)
    assert [QUERIES[q](spark, DIR).count() for q in ("g07_chunk_gate_all", "g08_relationship_gate_all", "x07_refusals_all")] == [202, 8, 6000]
