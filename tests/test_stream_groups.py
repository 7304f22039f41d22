"""Keys that share state by groups, whose calls to the state store don't grow with their number."""

import pytest
from test_streams import DAY, SCHEMA, events, plain_lives, streamed

from lattica.plans import streams
from lattica.streaming import state


@pytest.mark.parametrize("groups,bucket_s", [(2, 400_000), (3, 20_000)])
def test_groups_give_the_same_lives(spark, tmp_path, groups, bucket_s):
    """Many keys, one of them null; lives end in, at and beyond the bucket of their last beat."""
    rows = [(None if k % 9 == 8 else k % 9, *r[1:]) for k, r in enumerate(events(300, 5))]
    got = streamed(spark, tmp_path, rows, 5, lambda e: state.lifetimes(e.withColumnRenamed("tenant", "worker"), 900, "10 days", bucket_s, groups), "lives")
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert got.dtypes[0] == ("worker", "bigint")
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for t in {r[0] for r in rows} for r in plain_lives([r for r in rows if r[0] == t], 900_000_000)), key=key)


def test_buckets_follow_the_busiest_group(spark, monkeypatch):
    """Users with few events wait in one bucket of a shared group, a key with many in short ones."""
    monkeypatch.setattr(streams, "HELD", 50)
    monkeypatch.setattr(streams, "GROUPS", 2)
    few = spark.createDataFrame([(k, k, k * 1000, 1.0, 1.0, 0) for k in range(400)], SCHEMA)
    one = spark.createDataFrame([(1, k, k * 1000, 1.0, 1.0, 0) for k in range(4000)], SCHEMA)
    bucket, groups = streams.dealt(few, "tenant", 30 * DAY // 1_000_000)
    assert groups == 8 and bucket > 10 * 86_400
    assert streams.dealt(one, "tenant", 86_400) == (2160, 80)
    assert streams.dealt(few.limit(0), "tenant", 1) == (1, 2)
