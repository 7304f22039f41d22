"""Changes to relationships, and rows that belong to someone: edges, identities, workers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .access import at, not_expired

#: Fixed values.
DIRECTIONS, STATES, ORIGINS = ("forward", "both"), ("pending", "approved", "rejected", "auto"), ("manual", "imported", "rule", "model")


def create(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with the valid new ones at version 1, (edge_id, problem) of the others).

    An id that exists, or did, can't come again: keep deleted ids in ``edges``
    with ``deleted``.
    """
    taken = new.join(edges.select("edge_id", F.lit(True).alias("_there")), "edge_id", "left")
    problem = (
        F.when(F.col("_there"), "id is taken").when(F.col("source_doc") == F.col("target_doc"), "endpoints are the same")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence").when(~F.col("origin").isin(*ORIGINS), "origin").when(~F.col("review_state").isin(*STATES), "review state")
    )
    judged = taken.withColumn("problem", problem).drop("_there")
    good = judged.where("problem is null").drop("problem").withColumns({"version": F.lit(1), "deleted": F.lit(False)})
    return edges.unionByName(good, allowMissingColumns=True), judged.where("problem is not null").select("edge_id", "problem")


def update(edges: DataFrame, changes: DataFrame, t: str) -> DataFrame:
    """Apply (edge_id, confidence, review_state, supersede); nulls change nothing.

    A row that really changes gets a new version; the stamps ``reviewed_at``
    and ``superseded_at``, once set, stay.
    """
    c = changes.select("edge_id", F.col("confidence").alias("_c"), F.col("review_state").alias("_r"), F.col("supersede").alias("_s"))
    e = edges.join(c, "edge_id", "left")
    review = F.col("_r").isNotNull() & ~F.col("_r").eqNullSafe(F.col("review_state"))
    supersede = F.coalesce("_s", F.lit(False)) & F.col("superseded_at").isNull()
    changed = review | supersede | (F.col("_c").isNotNull() & ~F.col("_c").eqNullSafe(F.col("confidence")))
    changed = F.coalesce(changed, F.lit(False)) & ~F.col("deleted")
    return e.withColumns({
        "version": F.col("version") + changed.cast("int"),
        "reviewed_at": F.coalesce("reviewed_at", F.when(changed & review, at(t))),
        "superseded_at": F.coalesce("superseded_at", F.when(changed & supersede, at(t))),
        "confidence": F.when(changed, F.coalesce("_c", "confidence")).otherwise(F.col("confidence")),
        "review_state": F.when(changed, F.coalesce("_r", "review_state")).otherwise(F.col("review_state")),
    }).select(*edges.columns)


def delete(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with those marked deleted, (edge_id) whose points must go)."""
    gone = edges.where("not deleted").join(ids, "edge_id", "left_semi").select("edge_id")
    marked = edges.join(gone.withColumn("_gone", F.lit(True)), "edge_id", "left")
    return marked.withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).select(*edges.columns), gone


def contradictions(edges: DataFrame, visible_edges: DataFrame, kinds: list[int]) -> DataFrame:
    """Visible edges of contradicting kinds."""
    return edges.where(F.col("edge_type").isin(kinds)).join(visible_edges, "edge_id", "left_semi")


def valid_keys(keys: DataFrame, users: DataFrame, presented: DataFrame, t: str) -> DataFrame:
    """(request_id, company_id, user_id) of presented secrets (request_id, secret) whose key holds.

    Keys are kept as SHA-256; revoked and expired ones and those of deactivated
    users don't hold.
    """
    asked = presented.select("request_id", F.sha2("secret", 256).alias("key_hash"))
    live = keys.where(F.col("revoked_at").isNull() & not_expired(t)).join(users.where(F.col("deactivated_at").isNull()).select("company_id", "user_id"), ["company_id", "user_id"], "left_semi")
    return asked.join(live, "key_hash").select("request_id", "company_id", "user_id")


def identities(users: DataFrame, subjects: DataFrame) -> DataFrame:
    """(issuer, subject, user_id) for subjects that name exactly one active user."""
    found = users.where(F.col("deactivated_at").isNull()).join(subjects, ["issuer", "subject"])
    return found.groupBy("issuer", "subject").agg(F.count("*").alias("n"), F.min("user_id").alias("user_id")).where("n = 1").drop("n")


def stranded(jobs: DataFrame, heartbeats: DataFrame, t: str, seconds: int = 900) -> DataFrame:
    """Jobs (worker, ...) of workers without a heartbeat (worker, beat_at) in time; they go back to the queue."""
    alive = heartbeats.where(F.col("beat_at") > at(t) - F.expr(f"interval {seconds} seconds")).select("worker")
    return jobs.join(alive, "worker", "left_anti")


def listed(edges: DataFrame, endpoints: DataFrame, company: int | None = None, edge_type: int | None = None, states: list[str] | None = None, doc: int | None = None) -> DataFrame:
    """A tenant's edges, or all tenants'; a filter that isn't given filters nothing, ``doc`` asks for an end there."""
    rows = edges if company is None else edges.where(F.col("company_id") == company)
    if edge_type is not None:
        rows = rows.where(F.col("edge_type") == edge_type)
    if states:
        rows = rows.where(F.col("review_state").isin(states))
    return rows if doc is None else rows.join(endpoints.where(F.col("doc_id") == doc), "edge_id", "left_semi")
