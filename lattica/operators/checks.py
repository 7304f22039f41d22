"""Integrity rules as queries: (rule, key) of every row that breaks one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .access import SUB


def broken(rows: DataFrame, rule: str, holds: Column, key: Column) -> DataFrame:
    """Rows for which ``holds`` is false; a null holds, as constraints have it."""
    return rows.where(~F.coalesce(holds, F.lit(True))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def repeated(rows: DataFrame, rule: str, by: list[str], most: int = 1) -> DataFrame:
    return rows.groupBy(*by).count().where(F.col("count") > most).select(F.lit(rule).alias("rule"), F.concat_ws(":", *by).alias("key"))


def unmatched(rows: DataFrame, rule: str, others: DataFrame, on: list[str], key: str) -> DataFrame:
    return rows.join(others, on, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def violations(units: DataFrame, memberships: DataFrame, grants: DataFrame, documents: DataFrame, versions: DataFrame, edges: DataFrame) -> DataFrame:
    roots = units.where(F.col("parent_id").isNull())
    docs = documents.select("company_id", F.col("doc_id").alias("resource_id"))
    of_units = units.select("company_id", F.col("unit_id").alias("resource_id"))
    active = F.col("lifecycle") == "active"
    found = [
        repeated(roots, "one root", ["company_id"]),
        repeated(units.where("parent_id is not null"), "sibling names differ", ["company_id", "parent_id", "name"]),
        unmatched(units.where("parent_id is not null"), "parent exists", units.select("company_id", F.col("unit_id").alias("parent_id")), ["company_id", "parent_id"], "unit_id"),
        unmatched(memberships, "membership unit exists", units, ["company_id", "unit_id"], "user_id"),
        broken(grants, "only unit grants reach down", (F.col("resource_applies_to") != SUB) | (F.col("resource_type") == "org_unit"), F.col("grant_id")),
        unmatched(grants.where("resource_type = 'document'"), "granted document exists", docs, ["company_id", "resource_id"], "grant_id"),
        unmatched(grants.where("resource_type = 'org_unit'"), "granted unit exists", of_units, ["company_id", "resource_id"], "grant_id"),
        repeated(versions.where(active), "one active version", ["doc_id"]),
        broken(versions, "active is activated and not superseded", ~active | (F.col("activated_at").isNotNull() & F.col("superseded_at").isNull()), F.col("doc_id")),
        broken(versions, "superseded after activated", F.col("superseded_at") > F.col("activated_at"), F.col("doc_id")),
        broken(edges, "endpoints differ", F.col("source_doc") != F.col("target_doc"), F.col("edge_id")),
        broken(edges, "confidence from 0 to 1", F.col("confidence").between(0, 1), F.col("edge_id")),
        unmatched(edges, "endpoint exists", documents.select(F.col("doc_id").alias("target_doc")), ["target_doc"], "edge_id"),
    ]
    return reduce(DataFrame.union, found)


def changed(before: DataFrame, after: DataFrame, key: list[str], frozen: list[str], rule: str) -> DataFrame:
    """Keys whose frozen columns changed or that are gone."""
    b, a = before.select(*key, F.struct(*frozen).alias("was")), after.select(*key, F.struct(*frozen).alias("is"))
    both = b.join(a, key, "left").where(~F.col("was").eqNullSafe(F.col("is")))
    return both.select(F.lit(rule).alias("rule"), F.concat_ws(":", *key).alias("key"))


def foreign_actors(rows: DataFrame, users: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(rule, key) of rows whose acting user, if any, isn't of the row's tenant."""
    found = [unmatched(rows.where(F.col(c).isNotNull()), f"{c} is of the tenant", users.select("company_id", F.col("user_id").alias(c)), ["company_id", c], key) for c in columns]
    return reduce(DataFrame.union, found)


def several_defaults(providers: DataFrame) -> DataFrame:
    """(rule, key) of scopes (a tenant, or all tenants if null) with more than one enabled default."""
    live = providers.where("is_default and enabled").withColumn("scope", F.coalesce(F.col("company_id").cast("string"), F.lit("system")))
    return repeated(live, "one default provider", ["scope"])


def late_changes(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(rule, key) of changes (request_id, ts) made after the first decision (request_id, ts) on the request."""
    first = decisions.groupBy("request_id").agg(F.min("ts").alias("_first"))
    return changes.join(first, "request_id").where("ts > _first").select(F.lit("decided requests are frozen").alias("rule"), F.col("request_id").cast("string").alias("key")).distinct()


def roots(companies: DataFrame, units: DataFrame) -> DataFrame:
    """Units after each company (company_id, root_id, name) has a root that bears its name; new ones get one."""
    new = companies.join(units.where("parent_id is null").select("company_id"), "company_id", "left_anti")
    named = units.join(companies.select("company_id", F.col("name").alias("_name")), "company_id", "left")
    named = named.withColumn("name", F.when(F.col("parent_id").isNull(), F.coalesce("_name", "name")).otherwise(F.col("name"))).select(*units.columns)
    return named.unionByName(new.select("company_id", F.col("root_id").alias("unit_id"), F.lit(None).cast("long").alias("parent_id"), "name"))


def feed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key..., op, old, new): what turns one state of a table into the next, as inserts, updates and deletes."""
    values = [c for c in before.columns if c not in key]
    b, a = before.select(*key, F.struct(*values).alias("old")), after.select(*key, F.struct(*values).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return b.join(a, key, "full").withColumn("op", op).where("op is not null").select(*key, "op", "old", "new")


def snapshots(sessions: DataFrame, scopes: DataFrame, approvals: DataFrame) -> DataFrame:
    """(session_id, snapshot): each session with its scopes and approvals in order, as JSON.

    ``sessions`` (session_id, state, board), ``scopes`` (session_id, unit_id),
    a few rows of a session, and ``approvals`` (board, approver, decision) of
    all sessions with that board: they become text once and join as such.
    """
    units = scopes.groupBy("session_id").agg(F.array_sort(F.collect_list("unit_id")).alias("scopes"))
    votes = approvals.groupBy("board").agg(F.to_json(F.array_sort(F.collect_list(F.struct("approver", "decision")))).alias("approvals"))
    s = sessions.join(units, "session_id", "left").join(votes, "board", "left")
    head = F.to_json(F.struct("session_id", "state", F.coalesce("scopes", F.array().cast("array<bigint>")).alias("scopes")))
    body = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"approvals":'), F.coalesce("approvals", F.lit("[]")), F.lit("}"))
    return s.withColumn("head", head).select("session_id", body.alias("snapshot"))


def small_tenants(users: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """(user_id, root_id, n_units, outcome): active users with their tenant's root; trees of over ``most`` units are refused."""
    roots_ = units.groupBy("company_id").agg(F.count("*").alias("n_units"), F.min(F.when(F.col("parent_id").isNull(), F.col("unit_id"))).alias("root_id"))
    return users.where("deactivated_at is null").join(roots_, "company_id").select("user_id", "root_id", "n_units", F.when(F.col("n_units") > most, "too large").otherwise("ok").alias("outcome"))
