"""Paths, links and what they touch, against loops over small random graphs."""

import math
import random

import pytest

from lattica.operators import graph


def network(seed, n=14, m=40):
    """Edges with a hub, two edges between the same nodes, a loop, weak and useless edges, and a node of no authority."""
    rng = random.Random(seed)
    edges = [(k, rng.randrange(n), rng.randrange(n) if k % 3 else 0, round(rng.random() ** 2, 3)) for k in range(m)]
    edges += [(m, 1, 2, 1.0), (m + 1, 1, 2, 0.5), (m + 2, 3, 3, 0.9), (m + 3, 4, 5, 0.0), (m + 4, 5, 6, 1e-9)]
    return edges, {x: rng.choice([0.1, 0.5, 0.9, 1.0]) for x in range(1, n)} | {0: 1.0, 2: 0.0}


def by_loop(edges, factor, starts, hops):
    both = [(i, a, b, c) for i, a, b, c in edges if c > 0] + [(i, b, a, c) for i, a, b, c in edges if c > 0]
    found, at = [], [([s], [], 0.0) for s in starts]
    for h in range(1, hops + 1):
        at = [(nodes + [b], ids + [i], logs + math.log(c)) for nodes, ids, logs in at for i, a, b, c in both if a == nodes[-1] and b not in nodes and i not in ids]
        found += [(nodes[0], h, tuple(nodes), tuple(ids), math.exp(logs / h) * graph.HOP ** (h - 1) * min(factor.get(x, 0.0) for x in nodes)) for nodes, ids, logs in at]
    return found


def frames(spark, edges, factor, starts):
    return spark.createDataFrame(edges, "edge_id long, source long, target long, confidence double"), spark.createDataFrame([(s,) for s in starts], "start long"), spark.createDataFrame(list(factor.items()), "node long, factor double")


def same(got, want):
    got, want = sorted((r.start, r.hops, tuple(r.nodes), tuple(r.edge_ids), r.score) for r in got.collect()), sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_all_paths(spark, seed):
    edges, factor = network(seed)
    starts = [0, 1, 7, 99]
    same(graph.paths(*frames(spark, edges, factor, starts), 3, policy=True), by_loop(edges, factor, starts, 3))


@pytest.mark.parametrize("seed", range(3))
def test_bounds_lose_no_path(spark, seed):
    edges, factor = network(seed)
    starts = list(range(14))
    every = by_loop(edges, factor, starts, 3)
    same(graph.paths(*frames(spark, edges, factor, starts), 3, policy=True, least=0.2), [p for p in every if p[4] >= 0.2])
    best = [p for s in starts for p in sorted((p for p in every if p[0] == s), key=lambda p: (-round(p[4], 12), p[1:4]))[:4]]
    got = graph.paths(*frames(spark, edges, factor, starts), 3, policy=True, best=4)
    scores = lambda rows: sorted((r[0], round(r[-1], 9)) for r in rows)  # noqa: E731  equal scores may differ in the last bit
    assert scores((r.start, r.score) for r in got.collect()) == scores(best)


def test_three_hops_need_a_policy(spark):
    edges, factor = network(0)
    with pytest.raises(ValueError):
        graph.paths(*frames(spark, edges, factor, [1]), 3)


def test_reach_and_its_end(spark):
    rng = random.Random(5)
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)] + [(1, 1), (2, 3), (2, 3)]
    first, hops = {3, 4}, {}
    at, n = set(first), 0
    while at:
        hops |= {p: n for p in at}
        at, n = {a for a, b in links if b in at and a not in hops}, n + 1
    df = spark.createDataFrame(links, "source long, target long")
    start = spark.createDataFrame([(x,) for x in (3, 4, 4)], "page long")
    assert {r.page: r.hops for r in graph.reached(df, start).collect()} == hops
    assert graph.reached(df.limit(0), start).count() == 2
    chain = spark.createDataFrame([(k + 1, k) for k in range(6)], "source long, target long")
    with pytest.raises(ValueError):
        graph.reached(chain, spark.createDataFrame([(0,)], "page long"), most=3)


def test_citations(spark):
    cited = spark.createDataFrame([(1, 1, 10, "a"), (1, 1, None, "b"), (1, 2, 10, "c"), (2, 1, 11, "d"), (None, 1, 10, "e")], "doc_id long, version int, chunk_id long, page string")
    versions = spark.createDataFrame([(1, 1, "active"), (2, 1, "archived")], "doc_id long, version int, lifecycle string")
    got = graph.citations(cited, versions, spark.createDataFrame([(1, 10)], "doc_id long, chunk_id long"))
    assert {r.page: r.state for r in got.collect()} == {"a": "active", "b": "active", "c": "no such version", "d": "no such chunk", "e": "no such version"}


def test_weak_edges_of_a_hub_are_not_met(spark):
    """A hub's weak edges are not joined once better paths are known."""
    edges = [(k, 0, k, 0.001) for k in range(10, 400)] + [(1, 1, 0, 1.0), (2, 0, 2, 1.0), (3, 1, 3, 1.0), (4, 1, 4, 1.0)]
    e, starts, factor = frames(spark, edges, {k: 1.0 for k in range(400)}, [1])
    met = []
    kept = graph.stored
    graph.stored = lambda df, name: (out := kept(df, name), met.append((name, out.count())))[0]
    try:
        got = graph.paths(e, starts, factor, 2, best=3).select("score").collect()
    finally:
        graph.stored = kept
    assert [round(r.score, 6) for r in got] == [1.0, 1.0, 1.0]
    assert all(n <= 10 for name, n in met if name in ("paths", "best-paths"))
