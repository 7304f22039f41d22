"""Nearest neighbours and hard negatives against loops over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import blocks, negatives, neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, key string, own boolean, score double"


def vectors(seed, n, dim=8, spread=0.3):
    """Clusters, copies, ties, other lengths, and rows that take no part."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    rows = []
    for k in range(n):
        v = [c + rng.gauss(0, spread) for c in centres[k % 4]]
        if k % 9 == 0:
            v = [round(x) * 0.5 for x in v]
        if k % 11 == 0 and rows:
            v = rng.choice(rows)[1]
        rows.append((k, v, k % 5))
    rows += [rows[0], rows[0], (rows[20][0], rows[21][1], 3), (20, [1.0, 2.0], 1), (40, [2.0, 1.0], 1), (41, [2.0, 3.0], 2), (60, [1.0], None)]
    rows += [(None, rows[3][1], 1), (100_020, None, 1), (100_040, [], 1), (100_060, [0.0] * dim, 0), (100_080, [math.nan] + [1.0] * (dim - 1), 1), (100_100, [math.inf] * dim, 1), (100_120, [None] + [1.0] * (dim - 1), 1)]
    return [(i, v, label, "k", True, -1.0) for i, v, label in rows]


def whole(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def nearest_by_loop(rows, step, k):
    good = [(i, v) for i, v, *_ in rows if i is not None and whole(v) and any(v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % step == 0:
            scores = []
            for b, (j, w) in enumerate(good):
                if a != b and len(v) == len(w):
                    s = 0.0
                    for x, y in zip(v, w):
                        s += x * y
                    scores.append((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block,stripe", [(4096, 2048), (7, 16)])
def test_nearest(spark, monkeypatch, seed, block, stripe):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "STRIPE", stripe)
    rows = vectors(seed, 150, dim=5 + seed)
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, k=6)
    assert sorted(map(tuple, got.collect())) == nearest_by_loop(rows, 20, 6)


def test_nearest_with_few_or_no_rows(spark):
    df = spark.createDataFrame(vectors(0, 30)[:4], SCHEMA)
    assert [(r.rank, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") == 0, k=20).collect()] == [(r[1], r[2]) for r in nearest_by_loop(vectors(0, 30)[:4], 100, 20)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df.limit(1), F.col("vec_id") == 0).count() == 0


def test_all_rows_alike(spark):
    df = spark.createDataFrame([(k, [0.1, 0.7, -0.3], 1) for k in range(500)], "vec_id long, embedding array<float>, label int")
    got = neighbours.nearest(df, F.col("vec_id") == 7, k=10)
    assert [r.vec_id for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]


@pytest.mark.parametrize("dim,size", [(3, 1.0), (64, 1e-320), (64, 1e150), (1500, 3.0)])
def test_bounds_hold_for_every_pair(dim, size):
    rng = np.random.default_rng(dim)
    a, b = neighbours.Coded(rng.normal(size=(40, dim)) * size), neighbours.Coded(np.round(rng.normal(size=(60, dim)) * size, 1))
    low, high = neighbours.between(a, b)
    true = a.x @ b.x.T
    assert (low <= true).all() and (true <= high).all()
    assert (neighbours.products(a.codes, b.codes) == a.codes.astype(np.int64) @ b.codes.astype(np.int64).T).all()


def mined_by_loop(rows, step, n_positives=5, n_negatives=3):
    good = [(i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label, *_ in rows if i is not None and label is not None and whole(v)]
    out = []
    for a, (i, v, label) in enumerate(good):
        if i % step:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for b, (j, w, other) in enumerate(good) if a != b and len(v) == len(w)]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:n_positives]:
            hard = sorted((s, n) for s, n, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p)[:n_negatives]
            out += [(i, j, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(hard)]
    return sorted(out)


def labelled(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).where(blocks.usable("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return df.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x)).alias("v"), F.lit(1).alias("key"), F.lit(2).alias("low"))


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("block,stripe,leaf", [(4096, 2048, 64), (7, 30, 4)])
def test_hard_negatives(spark, monkeypatch, seed, block, stripe, leaf):
    for name, value in (("BLOCK", block), ("STRIPE", stripe), ("TREE", 2 * stripe), ("LEAF", leaf)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(seed, 200, dim=4 + seed)
    got = negatives.mine(labelled(spark, rows).repartition(3), F.col("id") % 10 == 0)
    want = mined_by_loop(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_hard_negatives_of_large_numbers_and_of_nothing(spark):
    big = [(k, [1000.0 * k + 0.5, 1e6 - k, 3e6], k % 3, "k", True, 0.0) for k in range(40)]
    got = negatives.mine(labelled(spark, big), F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined_by_loop(big, 10)
    assert negatives.mine(labelled(spark, big).limit(0), F.col("id") % 10 == 0).count() == 0


def test_nodes_bound_all_their_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, size=(500, 6))
    tree = negatives.BallTree(x, np.arange(500), rng.integers(0, 4, 500))
    assert sorted(tree.ids) == list(range(500))
    q = rng.normal(size=6)
    for a, b, centre, radius, low, high in tree.nodes:
        scores = tree.points[a:b] @ q
        reach = np.linalg.norm(q) * radius + 1e-6
        assert (scores <= q @ centre + reach).all() and (scores >= q @ centre - reach).all()
        assert low == tree.labels[a:b].min() and high == tree.labels[a:b].max()


def test_far_nodes_are_pruned(monkeypatch):
    """In separate clusters most leaves are never met."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, size=(256, 16)) + 1000 * rng.normal(size=16).astype(int) for _ in range(16)])
    tree = negatives.BallTree(x, np.arange(len(x)), np.zeros(len(x), int))
    met = []
    s = negatives.Search(x[:1], np.array([0]), np.array([0]), 6, True)
    monkeypatch.setattr(s, "meet", lambda active, t, rows, f=s.meet: (met.append(rows), f(active, t, rows)))
    tree.search(s)
    assert len(met) <= 12  # of 64 leaves or more
