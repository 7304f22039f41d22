"""Streams give the same rows however events are dealt to files and batches."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import ingest
from lattica.sources.pointset import PointSet
from lattica.streaming import state

SCHEMA = "tenant long, event_id long, us long, cost double, hold_s double, version long"
DAY = 86_400_000_000


def events(n=400, seed=1):
    """Four days, with gaps, equal times, and two tenants."""
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 2]), k, rng.randrange(4) * DAY + rng.randrange(0, 3_000) * 10_000_000, 1.0, rng.choice([600.0, 5000.0, 0.0]), rng.randrange(50)) for k in range(n)]


def streamed(spark, tmp_path, rows, n_files, transform, name, per_trigger=3):
    """The rows in ``n_files`` shuffled files; then one row that is late enough to end the wait."""
    source = tmp_path / f"{name}-in"
    rows = list(rows)
    random.Random(n_files).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(n_files).write.parquet(str(source))
    go = lambda: state.run_to_end(transform(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(str(source))), str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-log"))
    go()
    spark.createDataFrame([(None, None, 1000 * DAY, None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    go()  # another run: state is taken up from the checkpoint
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def in_turn(rows):
    of = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        of.setdefault(r[0], []).append(r)
    return of


def plain_bucket(rows):
    out = []
    for tenant, mine in in_turn(rows).items():
        tokens, last = 3.0, None
        for _, k, us, cost, *_ in mine:
            tokens, ok = state.take(tokens, last, us / 1e6, cost, 1 / 3000, 3.0)
            last = us / 1e6
            out.append((tenant, k, ok, round(tokens, 6)))
    return sorted(out)


def plain_leases(rows):
    out = []
    for tenant, mine in in_turn(rows).items():
        ends = []
        for _, k, us, _, hold, _ in mine:
            ends = [e for e in ends if e > us]
            ok = len(ends) < 3 and hold > 0
            ends += [us + round((hold + 15) * 1e6)] * ok
            out.append((tenant, k, ok, len(ends)))
    return sorted(out)


def plain_lives(rows, ttl):
    out = []
    for tenant, mine in in_turn(rows).items():
        since, last, n = mine[0][2], mine[0][2], 0
        for _, _, us, *_ in mine:
            if us - last >= ttl:
                out.append((tenant, since, last + ttl, n))
                since, n = us, 0
            last, n = us, n + 1
        out.append((tenant, since, last + ttl, n))
    return sorted(out)


@pytest.mark.parametrize("n_files,per_trigger,bucket_s", [(1, 1, 86_400), (12, 3, 20_000)])
def test_any_split_gives_the_same(spark, tmp_path, n_files, per_trigger, bucket_s):
    rows = events()
    d = "10 days"
    go = lambda transform, name: sorted(map(tuple, streamed(spark, tmp_path, rows, n_files, transform, name, per_trigger).collect()))
    assert go(lambda e: state.token_bucket(e, 1 / 3000, 3.0, d, bucket_s), "bucket") == plain_bucket(rows)
    assert go(lambda e: state.leases(e, 3, delay=d, bucket_s=bucket_s), "leases") == plain_leases(rows)
    assert go(lambda e: state.lifetimes(e.withColumnRenamed("tenant", "worker"), 900, d, bucket_s), "lives") == plain_lives(rows, 900_000_000)


def test_what_is_later_than_the_delay_is_left_out(spark, tmp_path):
    """An event that comes after the watermark has passed it doesn't disturb the order."""
    source, out = tmp_path / "in", tmp_path / "out"
    for k, us in ((1, 2 * DAY), (2, 10 * DAY), (3, 1 * DAY), (4, 11 * DAY), (5, 1000 * DAY)):
        spark.createDataFrame([(1, k, us, 1.0, 1.0, k)], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        state.run_to_end(state.fresh(spark.readStream.schema(SCHEMA).parquet(str(source)).withColumnRenamed("tenant", "key"), "1 day"), str(out), str(tmp_path / "log"))
    assert sorted(r.event_id for r in spark.read.parquet(str(out)).collect()) == [1, 2, 4]


def test_keys_come_once_over_a_restart(spark, tmp_path):
    schema = "tenant long, job_type string, key long, ts timestamp"
    rows = spark.range(60).select((F.col("id") % 2).alias("tenant"), F.lit("j").alias("job_type"), (F.col("id") % 7).alias("key"), F.timestamp_seconds(F.col("id") * 100).alias("ts"))
    there = spark.createDataFrame([(0, "j", 3), (0, "j", 3), (1, "x", 4)], "tenant long, job_type string, key long")
    for part in range(3):
        rows.where(f"key % 3 = {part} or key = 5").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        new = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        state.run_to_end(state.enqueue(new, there, "10 days"), str(tmp_path / "out"), str(tmp_path / "log"))
    got = sorted((r.tenant, r.key) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((t, k) for t in range(2) for k in range(7) if (t, k) != (0, 3))


def test_point_set(spark, tmp_path):
    schema = "doc_id long, acl_version long, label string, gone boolean"
    rows = [(k % 9, 1, "old", False) for k in range(20)] + [(None, 1, "no id", False)]
    kept = PointSet(spark, str(tmp_path / "set"), "doc_id", 4)
    kept.create(spark.createDataFrame(rows, schema))
    change = lambda *of: spark.createDataFrame(list(of), "doc_id long, acl_version long, gone boolean, label string")
    one, two = change((1, 5, False, "a"), (2, 3, True, "b"), (2, 2, False, "late")), change((1, 4, True, "older"), (2, 2, False, "older"), (3, 9, False, "c"))
    apply = lambda n, c: kept.apply(n, c.select("doc_id"), lambda p: ingest.newest(p, c))
    assert apply(0, one) and apply(1, two) and not apply(1, one) and not apply(0, two)
    state_ = lambda: {(r.doc_id, r.acl_version, r.label, r.gone) for r in kept.read().collect()}
    want = {(k, 1, "old", False) for k in (0, 4, 5, 6, 7, 8)} | {(1, 5, "a", False), (2, 3, "b", True), (3, 9, "c", False), (None, 1, "no id", False)}
    assert state_() == want and kept.read().count() == 21
    # What was there before is there still, and a write without its manifest counts for nothing.
    assert kept.read(0).where("acl_version > 1").count() == 0
    kept._write(spark.createDataFrame([(1, 99, "half", False)], schema))
    assert state_() == want
    touched = kept.manifest()[2]
    assert len(set(touched.values())) > 1  # buckets that no change touched are where they were


def test_replayed_and_reordered_batches(spark, tmp_path):
    rng = random.Random(3)
    points = [(k, 1, "old", False) for k in range(30)]
    changes = [(rng.randrange(40), v, rng.random() < 0.3, f"v{v}") for v in range(2, 120)]
    want = {k: (1, "old", False) for k, *_ in points}
    for k, v, gone, label in changes:
        if k in want:
            want[k] = (v, label, gone)
    schema = "doc_id long, acl_version long, gone boolean, label string"
    for n, order in enumerate((changes, changes[::-1])):
        kept = PointSet(spark, str(tmp_path / f"set{n}"), "doc_id", 8)
        kept.create(spark.createDataFrame(points, "doc_id long, acl_version long, label string, gone boolean"))
        for part in range(4):
            spark.createDataFrame(order[part::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"in{n}"))
        ingest.follow(stream(), kept, str(tmp_path / f"log{n}"))
        before = kept.versions()[-1]
        ingest.follow(stream(), kept, str(tmp_path / f"again{n}"))  # a lost checkpoint: all batches come again
        assert {r.doc_id: (r.acl_version, r.label, r.gone) for r in kept.read().collect()} == want
        assert kept.versions()[-1] == before
