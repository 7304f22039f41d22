"""The outbox as pure steps from one state of its table to the next.

Events: event_id, tenant, job_type, key, payload, attempts, claimed_by,
claimed_at, completed_at, next_attempt_at, created_at, last_error. One writer
applies the steps (``foreachBatch``, say), which is what locks are for elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import at

MOST_ATTEMPTS, BATCH, LONGEST_ERROR = 5, 16, 4096


def backoff(attempts: Column) -> Column:
    """Seconds until the next attempt."""
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), attempts)).cast("int")


def enqueue(events: DataFrame, new: DataFrame) -> DataFrame:
    """New events whose (tenant, job_type, key) isn't there yet; the first of equal ones counts."""
    key = ["tenant", "job_type", "key"]
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("event_id"))).where("_n = 1").drop("_n")
    return first.join(events, key, "left_anti")


def due(t: str) -> Column:
    return F.col("completed_at").isNull() & F.col("claimed_by").isNull() & (F.col("attempts") < MOST_ATTEMPTS) & (F.coalesce("next_attempt_at", "created_at") <= at(t))


def claim(events: DataFrame, worker: str, job_types: list[str], t: str, batch: int = BATCH) -> DataFrame:
    """The events that a worker takes now, oldest first, with the claim in them."""
    found = events.where(due(t) & F.col("job_type").isin(job_types)).orderBy(F.coalesce("next_attempt_at", "created_at"), "event_id").limit(batch)
    return found.withColumns({"claimed_by": F.lit(worker), "claimed_at": at(t), "attempts": F.col("attempts") + 1})


def reap(events: DataFrame, t: str, minutes: int = 10) -> DataFrame:
    """Give back claims that are too old; the lost attempt doesn't count."""
    old = F.col("completed_at").isNull() & F.col("claimed_by").isNotNull() & (F.col("claimed_at") < at(t) - F.expr(f"interval {minutes} minutes"))
    return _released(events, old, "reaped")


def release(events: DataFrame, worker: str) -> DataFrame:
    return _released(events, F.col("completed_at").isNull() & (F.col("claimed_by") == worker), "released")


def _released(events: DataFrame, these: Column, why: str) -> DataFrame:
    these = F.coalesce(these, F.lit(False))
    return events.withColumns({
        "attempts": F.when(these, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts")),
        "last_error": F.when(these, F.left(F.concat(F.coalesce("last_error", F.lit("")), F.lit(why)), F.lit(LONGEST_ERROR))).otherwise(F.col("last_error")),
        "claimed_at": F.when(these, None).otherwise(F.col("claimed_at")),
        "claimed_by": F.when(these, None).otherwise(F.col("claimed_by")),
    })


def finish(events: DataFrame, results: DataFrame, t: str) -> DataFrame:
    """Apply (event_id, ok, error): complete, or wait longer after each failure.

    An event with all its attempts used stays where it is.
    """
    e = events.join(results.select("event_id", F.col("ok").alias("_ok"), F.col("error").alias("_error")), "event_id", "left")
    failed = F.coalesce(~F.col("_ok"), F.lit(False))
    done = F.coalesce("_ok", F.lit(False))
    return e.withColumns({
        "completed_at": F.when(done, at(t)).otherwise(F.col("completed_at")),
        "next_attempt_at": F.when(failed, F.timestamp_seconds(F.unix_timestamp(at(t)) + backoff(F.col("attempts")))).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(failed, F.left("_error", F.lit(LONGEST_ERROR))).otherwise(F.col("last_error")),
        "claimed_at": F.when(failed, None).otherwise(F.col("claimed_at")),
        "claimed_by": F.when(failed, None).otherwise(F.col("claimed_by")),
    }).select(*events.columns)


def current(events: DataFrame, versions: DataFrame, key: list[str]) -> DataFrame:
    """Events (…, event_version) that aren't older than their subject's ``version``."""
    return events.join(versions, key).where("event_version >= version").drop("version")


def sweep(jobs: DataFrame, t: str, minutes: int = 15, most: int = 3) -> DataFrame:
    """Stuck jobs (state, updated_at, has_payload, retries): queued again, or failed for good."""
    stuck = F.col("state").isin("pending", "processing") & (F.col("updated_at") < at(t) - F.expr(f"interval {minutes} minutes"))
    again = F.col("has_payload") & (F.col("retries") < most)
    return jobs.where(stuck).withColumn("action", F.when(again, "requeue").otherwise("error"))


def round_robin(jobs: DataFrame) -> DataFrame:
    """Adds ``turn`` from 0: one job of each tenant in turn, tenants in order."""
    mine = F.row_number().over(Window.partitionBy("tenant").orderBy("ts", "event_id"))
    return jobs.withColumn("turn", mine - 1)


def orphans(points: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """Points whose chunk is no more."""
    return points.join(chunks, key, "left_anti")


def claim_ingest(versions: DataFrame, requests: DataFrame, t: str) -> DataFrame:
    """Versions after ingest claims (doc_id, version, token): a pending one goes to the least token.

    ``outcome`` tells each request: processing, or duplicate.
    """
    winner = requests.groupBy("doc_id", "version").agg(F.min("token").alias("winner"))
    r = requests.join(versions.select("doc_id", "version", "state"), ["doc_id", "version"]).join(winner, ["doc_id", "version"])
    return r.withColumn("outcome", F.when((F.col("state") == "pending") & (F.col("token") == F.col("winner")), "processing").otherwise("duplicate")).drop("state", "winner")
