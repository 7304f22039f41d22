"""Registered queries over streams, run to their end over the events table; with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import ingest
from lattica.sources.pointset import PointSet
from lattica.streaming import state
from lattica.tables import shared_dir

from .model import Model, long, sql
from .queries import query

#: Bytes of new files that a micro-batch takes, one file at least; results don't depend on it.
BATCH_BYTES = 128 << 20
#: Events of a group of keys, about; fewest groups; the longest bucket in seconds. Results don't depend on these either.
HELD, GROUPS, LONGEST = 10_000, 64, 365 * 86_400


def source(m: Model) -> DataFrame:
    """The events table as a stream of files."""
    return m.spark.readStream.schema(m.table("events").schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", BATCH_BYTES).parquet(m.dir)


def timed(e: DataFrame) -> DataFrame:
    return e.select(long("user_id").alias("user_id"), (F.col("user_id") % 5).cast("long").alias("tenant"), long("event_id").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")


def dealt(events: DataFrame, key: str, span_s: int) -> tuple[int, int]:
    """(seconds of a bucket, groups of keys): calls to the state store come by group and bucket, so each should hold many events, but not all of a busy key."""
    groups = max(GROUPS, -(-events.count() // HELD))
    most = events.groupBy(state.group_of(key, groups)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # one number
    return max(1, min(span_s, LONGEST, span_s * 2 * HELD // most)), groups


def run(m: Model, key: str, shape: Callable[[DataFrame], DataFrame], transform: Callable[[DataFrame, str, int, int], DataFrame]) -> DataFrame:
    """What ``transform`` makes of the events in the ``shape`` that it needs, with ``key`` and ``us``, the delay, the length of buckets and the groups of keys.

    The table's files come in no order of time, so the delay is all the time
    that they span. A second source stands for the time that passes after the
    last event: once the events are in, it brings one row without a key that is
    late enough for the watermark to pass them all.
    """
    first, last = m.table("events").agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    span = ((last or 0) - (first or 0)) // 1_000_000 + 1
    root = f"{shared_dir(m.spark)}/stream-{uuid.uuid4().hex}"
    events = shape(timed(source(m)))
    bucket, groups = dealt(shape(timed(m.table("events"))), key, span)
    clock = m.spark.createDataFrame([], events.schema)
    clock.coalesce(1).write.parquet(f"{root}/clock")

    def go() -> DataFrame:
        both = shape(timed(source(m))).unionByName(m.spark.readStream.schema(events.schema).parquet(f"{root}/clock"))
        out = transform(both, f"{span} seconds", bucket, groups)
        state.run_to_end(out, f"{root}/out", f"{root}/log")
        return out

    go()
    late = (last or 0) + (span + 1000 * 86_400) * 1_000_000
    tick = m.spark.range(1).select(*[F.lit(late if f.name == "us" else None).cast(f.dataType).alias(f.name) for f in events.schema.fields])
    tick.write.mode("append").parquet(f"{root}/clock")
    return m.spark.read.schema(go().schema).parquet(f"{root}/out")


@query()
def s16_leases(m: Model) -> DataFrame:
    """Ten leases of 20 minutes a tenant (see the tests)."""
    return run(m, "tenant", lambda e: e.select("tenant", "event_id", "us", F.lit(1200.0).alias("hold_s")), lambda e, *how: state.leases(e, 10, 15.0, 86_400.0, *how))


@query()
def s17_token_bucket(m: Model) -> DataFrame:
    """A token every ten minutes a tenant, five at most (see the tests)."""
    return run(m, "tenant", lambda e: e.select("tenant", "event_id", "us", F.lit(1.0).alias("cost")), lambda e, *how: state.token_bucket(e, 1 / 600, 5.0, *how))


@query("SELECT key, event_id, version FROM (SELECT user_id::BIGINT AS key, event_id::BIGINT event_id, (event_id % 7)::BIGINT AS version, max(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) high FROM events) WHERE version >= high")
def s07_stream_fresh(m: Model) -> DataFrame:
    """Events whose version isn't below the highest of their user so far."""
    return run(m, "key", lambda e: e.select(F.col("user_id").alias("key"), "event_id", "us", (F.col("event_id") % 7).alias("version")), state.fresh)


@query(sql("""SELECT worker, min(us)::BIGINT since_us, (max(us) + 900000000)::BIGINT expired_us, count(*)::BIGINT beats FROM (
  SELECT *, sum(CASE WHEN us - before < 900000000 THEN 0 ELSE 1 END) OVER (PARTITION BY worker ORDER BY us, event_id) life FROM (
    SELECT user_id worker, event_id, epoch_us(ts) us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) before FROM ev)) GROUP BY worker, life"""))
def s15_lifetimes(m: Model) -> DataFrame:
    """Each user as a worker, each event as a beat; a life ends 15 minutes after its last beat."""
    return run(m, "worker", lambda e: e.select(F.col("user_id").alias("worker"), "event_id", "us"), lambda e, *how: state.lifetimes(e, 900, *how))


@query(sql("SELECT DISTINCT tenant, event_type job_type, k AS key FROM ev WHERE k NOT IN (SELECT k FROM ev WHERE event_id < 20)"))
def s01_stream_enqueue(m: Model) -> DataFrame:
    """Events keyed by k, each key once for a tenant and type; what the first twenty named is there already.

    Equal to what ``s01_enqueue`` takes from the table as a whole.
    """
    key = F.get_json_object("props", "$.k").cast("long").alias("key")
    e = source(m).select((F.col("user_id") % 5).cast("long").alias("tenant"), F.col("event_type").alias("job_type"), key, F.col("ts").cast("timestamp").alias("ts"))
    seen = m.events.where("event_id < 20").select(F.col("k").alias("key")).distinct()
    there = m.events.select("tenant", F.col("event_type").alias("job_type"), F.col("k").alias("key")).join(seen, "key", "left_semi")
    root = f"{shared_dir(m.spark)}/stream-{uuid.uuid4().hex}"
    out = state.enqueue(e, there, "3650 days")
    state.run_to_end(out, f"{root}/out", f"{root}/log")
    return m.spark.read.schema(out.schema).parquet(f"{root}/out")


def points(m: Model) -> DataFrame:
    """A point for each vector, with the ACL version that it was made for."""
    return m.vectors.select("chunk_id", "doc_id", F.lit(1).cast("long").alias("acl_version"), F.lit("old").alias("label"))


def changes(e: DataFrame) -> DataFrame:
    """An event of user u changes document u: it goes if the event is an error, else its points get the event's label; versions are the events' ids."""
    return e.select(long("user_id").alias("doc_id"), (F.col("event_id") + 2).cast("long").alias("acl_version"), (F.col("event_type") == "error").alias("gone"), F.concat(F.lit("e"), "event_id").alias("label"))


@query(sql(f"""SELECT x.doc_id, x.chunk_id, coalesce(c.v, 1)::BIGINT acl_version, coalesce(c.label, 'old') label FROM vectors x LEFT JOIN (SELECT user_id doc_id, max(event_id) + 2 v, arg_max('e' || event_id, event_id) label, arg_max(event_type, event_id) kind FROM ev GROUP BY 1) c USING (doc_id)
WHERE c.kind IS NULL OR c.kind <> 'error'"""))
def s09_stream_points(m: Model) -> DataFrame:
    """Points that follow a stream of deletions and changed access; each document's newest event decides, whatever batch it comes in."""
    root = f"{shared_dir(m.spark)}/points-{uuid.uuid4().hex}"
    kept = PointSet(m.spark, f"{root}/set", "doc_id")
    kept.create(points(m).withColumn("gone", F.lit(False)))
    ingest.follow(changes(source(m)), kept, f"{root}/log")
    return kept.read().where("not gone").select("doc_id", "chunk_id", "acl_version", "label")
