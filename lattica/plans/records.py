"""Registered queries over rules, ingests, files and feeds; with their SQL."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text
from lattica.operators import access, checks, edges, ingest, temporal, vectors
from lattica.operators.access import SUB
from lattica.sources import files, logs
from lattica.tables import shared_dir

from .model import AS_OF, PER_DOC, Model, sql
from .queries import endpoints, joined, memberships, merged, pack_prompt, query, scope

T = f"TIMESTAMP '{AS_OF[:10]}'"


def when(condition: Column | str, value: Column, other: Column) -> Column:
    return F.when(F.expr(condition) if isinstance(condition, str) else condition, value).otherwise(other)


# Rules. The derived tables keep all of them, so some rows are broken here first.


BROKEN = """bad_units AS (SELECT company_id, unit_id, parent_id, CASE WHEN unit_id IN (1003, 1004) THEN 'twin' ELSE name END AS name FROM units
  UNION ALL SELECT 2, 9001, NULL, 'second root' UNION ALL SELECT 3, 9002, 9999, 'lost'),
bad_members AS (SELECT company_id, user_id, CASE WHEN user_id % 97 = 0 THEN 9999 ELSE unit_id END unit_id FROM memberships),
bad_grants AS (SELECT company_id, resource_type, CASE WHEN grant_id % 60 = 2 THEN 10000000 + resource_id WHEN grant_id % 240 = 121 THEN 9999 ELSE resource_id END resource_id, CASE WHEN grant_id % 50 = 0 THEN 'self_and_descendants' ELSE resource_applies_to END resource_applies_to, grant_id FROM grants),
bad_versions AS (SELECT doc_id, version, CASE WHEN doc_id % 57 = 3 THEN 'active' ELSE lifecycle END lifecycle, CASE WHEN doc_id % 41 = 5 THEN NULL ELSE activated_at END activated_at, CASE WHEN doc_id % 33 = 6 THEN TIMESTAMP '2023-01-01' ELSE superseded_at END superseded_at FROM versions),
bad_edges AS (SELECT edge_id, source_doc, CASE WHEN edge_id % 17 = 3 THEN source_doc WHEN edge_id % 23 = 4 THEN 10000000 + target_doc ELSE target_doc END target_doc, CASE WHEN edge_id % 19 = 5 THEN confidence + 1 ELSE confidence END confidence FROM edges)"""


@query(sql("""SELECT 'one root' AS rule, company_id::VARCHAR AS key FROM bad_units WHERE parent_id IS NULL GROUP BY company_id HAVING count(*) > 1
UNION ALL SELECT 'sibling names differ', company_id || ':' || parent_id || ':' || name FROM bad_units WHERE parent_id IS NOT NULL GROUP BY company_id, parent_id, name HAVING count(*) > 1
UNION ALL SELECT 'parent exists', unit_id::VARCHAR FROM bad_units u WHERE parent_id IS NOT NULL AND (company_id, parent_id) NOT IN (SELECT company_id, unit_id FROM bad_units)
UNION ALL SELECT 'membership unit exists', user_id::VARCHAR FROM bad_members WHERE (company_id, unit_id) NOT IN (SELECT company_id, unit_id FROM bad_units)
UNION ALL SELECT 'only unit grants reach down', grant_id::VARCHAR FROM bad_grants WHERE resource_applies_to = 'self_and_descendants' AND resource_type <> 'org_unit'
UNION ALL SELECT 'granted document exists', grant_id::VARCHAR FROM bad_grants WHERE resource_type = 'document' AND (company_id, resource_id) NOT IN (SELECT company_id, doc_id FROM docs)
UNION ALL SELECT 'granted unit exists', grant_id::VARCHAR FROM bad_grants WHERE resource_type = 'org_unit' AND (company_id, resource_id) NOT IN (SELECT company_id, unit_id FROM bad_units)
UNION ALL SELECT 'one active version', doc_id::VARCHAR FROM bad_versions WHERE lifecycle = 'active' GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'active is activated and not superseded', doc_id::VARCHAR FROM bad_versions WHERE lifecycle = 'active' AND (activated_at IS NULL OR superseded_at IS NOT NULL)
UNION ALL SELECT 'superseded after activated', doc_id::VARCHAR FROM bad_versions WHERE superseded_at <= activated_at
UNION ALL SELECT 'endpoints differ', edge_id::VARCHAR FROM bad_edges WHERE source_doc = target_doc UNION ALL SELECT 'confidence from 0 to 1', edge_id::VARCHAR FROM bad_edges WHERE confidence NOT BETWEEN 0 AND 1
UNION ALL SELECT 'endpoint exists', edge_id::VARCHAR FROM bad_edges WHERE target_doc NOT IN (SELECT doc_id FROM docs)""", BROKEN))
def c01_violations(m: Model) -> DataFrame:
    """Every rule is broken by some rows, and exactly those are named."""
    more = m.spark.createDataFrame([(2, 9001, None, "second root"), (3, 9002, 9999, "lost")], "company_id long, unit_id long, parent_id long, name string")
    units = m.units.withColumn("name", when("unit_id in (1003, 1004)", F.lit("twin"), F.col("name"))).unionByName(more)
    members = m.memberships.withColumn("unit_id", when("user_id % 97 = 0", F.lit(9999), F.col("unit_id")))
    strange = F.when(F.expr("grant_id % 60 = 2"), F.col("resource_id") + 10_000_000).when(F.expr("grant_id % 240 = 121"), F.lit(9999)).otherwise(F.col("resource_id"))
    grants = m.grants.withColumns({"resource_id": strange, "resource_applies_to": when("grant_id % 50 = 0", F.lit(SUB), F.col("resource_applies_to"))})
    versions = m.versions.withColumns({
        "lifecycle": when("doc_id % 57 = 3", F.lit("active"), F.col("lifecycle")), "activated_at": when("doc_id % 41 <> 5", F.col("activated_at"), F.lit(None)),
        "superseded_at": when("doc_id % 33 = 6", F.lit("2023-01-01").cast("timestamp"), F.col("superseded_at")),
    })
    target = F.when(F.expr("edge_id % 17 = 3"), F.col("source_doc")).when(F.expr("edge_id % 23 = 4"), F.col("target_doc") + 10_000_000).otherwise(F.col("target_doc"))
    bad = m.edges.withColumns({"target_doc": target, "confidence": when("edge_id % 19 = 5", F.col("confidence") + 1, F.col("confidence"))})
    return checks.violations(units, members, grants, m.documents, versions, bad)


@query(sql("""SELECT 'granted_by is of the tenant' AS rule, grant_id::VARCHAR AS key FROM (SELECT *, CASE WHEN grant_id % 5 <> 0 THEN grant_id % n END granted_by FROM grants, (SELECT count(*) n FROM users)) g
WHERE granted_by IS NOT NULL AND (company_id, granted_by) NOT IN (SELECT company_id, user_id FROM users)"""))
def r02_foreign_actors(m: Model) -> DataFrame:
    """Who gave a grant is of its tenant, or isn't known."""
    n = m.users.count()
    return checks.foreign_actors(m.grants.withColumn("granted_by", F.when(F.expr("grant_id % 5 <> 0"), F.col("grant_id") % n)), m.users, ["granted_by"], "grant_id")


@query(sql("SELECT 'one default provider' AS rule, scope AS key FROM (SELECT CASE WHEN group_id % 4 = 0 THEN 'system' ELSE company_id::VARCHAR END scope FROM groups_ WHERE group_id % 3 = 0 AND group_id % 5 <> 0) GROUP BY scope HAVING count(*) > 1"))
def r18_default_providers(m: Model) -> DataFrame:
    """Suppliers as providers: every fourth for all tenants, every third a default, every fifth off."""
    p = m.groups.select(F.when(F.expr("group_id % 4 <> 0"), F.col("company_id")).alias("company_id"), F.expr("group_id % 3 = 0").alias("is_default"), F.expr("group_id % 5 <> 0").alias("enabled"))
    return checks.several_defaults(p)


@query(sql("""SELECT DISTINCT 'decided requests are frozen' AS rule, c.user_id::VARCHAR AS key FROM (SELECT user_id, ts FROM ev WHERE event_type = 'view') c
JOIN (SELECT user_id, min(ts) t FROM ev WHERE event_type = 'purchase' AND k < 10 GROUP BY 1) d USING (user_id) WHERE c.ts > d.t"""))
def r04_late_changes(m: Model) -> DataFrame:
    """Views change a user's request, purchases of less than ten decide on it."""
    of = lambda e: e.select(F.col("user_id").alias("request_id"), "ts")
    return checks.late_changes(of(m.events.where("event_type = 'view'")), of(m.events.where("event_type = 'purchase' and k < 10")))


@query(sql("""SELECT company_id, unit_id, parent_id, CASE WHEN parent_id IS NULL THEN 'Company ' || company_id ELSE name END AS name FROM units WHERE company_id <> 4 OR parent_id IS NOT NULL
UNION ALL SELECT company_id, company_id + 1, NULL, 'Company ' || company_id FROM companies WHERE company_id = 4"""))
def r01_roots(m: Model) -> DataFrame:
    """Company 4 lacks its root and all companies have a new name."""
    companies = m.companies.select("company_id", (F.col("company_id") + 1).alias("root_id"), F.concat(F.lit("Company "), "company_id").alias("name"))
    return checks.roots(companies, m.units.where("company_id <> 4 or parent_id is not null"))


CHANGED = """was AS (SELECT user_id, unit_id, role FROM memberships WHERE user_id % 7 <> 0),
now_ AS (SELECT user_id, unit_id, CASE WHEN user_id % 11 = 0 THEN 'auditor' ELSE role END AS role FROM memberships WHERE user_id % 6 <> 0)"""


@query(sql("""SELECT user_id, unit_id, CASE WHEN a.role IS NULL THEN 'insert' WHEN b.role IS NULL THEN 'delete' ELSE 'update' END op, a.role old_role, b.role new_role FROM was a FULL JOIN now_ b USING (user_id, unit_id) WHERE a.role IS DISTINCT FROM b.role""", CHANGED))
def r14_membership_feed(m: Model) -> DataFrame:
    """Every seventh user is new, every sixth leaves, every eleventh changes the role."""
    all_ = m.memberships.select("user_id", "unit_id", "role")
    after = all_.where("user_id % 6 <> 0").withColumn("role", when("user_id % 11 = 0", F.lit("auditor"), F.col("role")))
    return checks.feed(all_.where("user_id % 7 <> 0"), after, ["user_id", "unit_id"]).select("user_id", "unit_id", "op", F.col("old.role").alias("old_role"), F.col("new.role").alias("new_role"))


@query(sql("""SELECT user_id AS session_id, '{"session_id":' || user_id || ',"state":"' || CASE user_id % 3 WHEN 0 THEN 'requested' WHEN 1 THEN 'approved' ELSE 'active' END || '","scopes":[' || coalesce(s.units, '') || '],"approvals":[' || coalesce(v.votes, '') || ']}' AS snapshot FROM users u
LEFT JOIN (SELECT user_id, string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) units FROM scope GROUP BY 1) s USING (user_id)
LEFT JOIN (SELECT user_id, string_agg('{"approver":' || group_id || ',"decision":"' || CASE WHEN group_id % 2 = 0 THEN 'approve' ELSE 'reject' END || '"}', ',' ORDER BY group_id) votes FROM group_members GROUP BY 1) v USING (user_id)"""))
def a10_snapshots(m: Model) -> DataFrame:
    """A session for each user, with the user's scope, and the user's groups as approvers."""
    state = F.element_at(F.array(*map(F.lit, ("requested", "approved", "active"))), (F.col("user_id") % 3 + 1).cast("int"))
    s = m.cohorts.users.select(F.col("user_id").alias("session_id"), state.alias("state"), F.col("cohort").alias("board"))
    votes = m.cohorts.groups.select(F.col("cohort").alias("board"), F.col("group_id").alias("approver"), when("group_id % 2 = 0", F.lit("approve"), F.lit("reject")).alias("decision"))
    return checks.snapshots(s, scope(m).select(F.col("user_id").alias("session_id"), "unit_id"), votes)


@query(sql("""SELECT u.user_id, r.unit_id root_id, n.n::BIGINT n_units, CASE WHEN n.n > 30 THEN 'too large' ELSE 'ok' END outcome FROM users u JOIN bigger r ON r.company_id = u.company_id AND r.parent_id IS NULL
JOIN (SELECT company_id, count(*) n FROM bigger GROUP BY 1) n ON n.company_id = u.company_id WHERE u.user_id % 9 <> 0""", "bigger AS (SELECT * FROM units WHERE company_id % 2 = 0 OR unit_id % 2 = 0 OR parent_id IS NULL)"))
def j16_tree_access(m: Model) -> DataFrame:
    """Trees of at most thirty units may be read; every ninth user is deactivated."""
    users = m.users.withColumn("deactivated_at", F.when(F.expr("user_id % 9 = 0"), F.lit(AS_OF).cast("timestamp")))
    return checks.small_tenants(users, m.units.where("company_id % 2 = 0 or unit_id % 2 = 0 or parent_id is null"), 30)


# Ingest.


LAYOUTS = """old_rows AS (SELECT company_id, doc_id, version, o.i ordinal, 'old' body, TIMESTAMP '2024-01-01' created_at FROM versions, range(0, 6) o(i) WHERE o.i < doc_id % 5 + 2),
new_rows AS (SELECT company_id, doc_id, version, o.i ordinal, 'new' body, TIMESTAMP '2024-01-15' created_at FROM versions, range(0, 4) o(i) WHERE doc_id % 3 = 0 AND o.i < doc_id % 4)"""


def layout(m: Model, n: Column, body: str, t: str) -> DataFrame:
    rows = m.versions.select("company_id", "doc_id", "version", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("ordinal")).where(F.col("ordinal") < n)
    return rows.withColumns({"ordinal": F.col("ordinal").cast("long"), "body": F.lit(body), "created_at": F.lit(t).cast("timestamp")})


def reingested(m: Model) -> tuple[DataFrame, DataFrame]:
    """Every third document comes again, with none to three sections for the two to six that it had."""
    again = m.versions.where("doc_id % 3 = 0")
    new = layout(m, F.col("doc_id") % 4, "new", AS_OF).where("doc_id % 3 = 0")
    return ingest.replace(layout(m, F.col("doc_id") % 5 + 2, "old", "2024-01-01"), new, again, "ordinal")


@query(sql("""SELECT doc_id, version, ordinal, body, created_at FROM old_rows WHERE doc_id % 3 <> 0
UNION ALL SELECT n.doc_id, n.version, n.ordinal, n.body, coalesce(o.created_at, n.created_at) FROM new_rows n LEFT JOIN old_rows o USING (doc_id, version, ordinal)""", LAYOUTS))
def d03_reingest(m: Model) -> DataFrame:
    return reingested(m)[0].select("doc_id", "version", "ordinal", "body", "created_at")


@query(sql("SELECT doc_id, version, ordinal FROM old_rows WHERE doc_id % 3 = 0 AND ordinal >= doc_id % 4", LAYOUTS))
def d03_orphans(m: Model) -> DataFrame:
    return reingested(m)[1].select("doc_id", "version", "ordinal")


@query(sql("SELECT doc_id, version, ordinal chunk, CASE WHEN doc_id % 3 <> 0 OR ordinal // 2 < doc_id % 4 THEN ordinal // 2 END section FROM old_rows", LAYOUTS))
def d03_chunk_sections(m: Model) -> DataFrame:
    """Two chunks a section; those of sections that went have none."""
    chunks = layout(m, F.col("doc_id") % 5 + 2, "old", "2024-01-01").select("company_id", "doc_id", "version", F.col("ordinal").alias("chunk"), F.expr("ordinal div 2").alias("section"))
    return ingest.without_lost_sections(chunks, reingested(m)[1]).select("doc_id", "version", "chunk", "section")


SYNC = """sync_events AS (SELECT doc_id AS event_id, company_id, doc_id, 1 + doc_id % 3 acl_version FROM docs UNION ALL SELECT doc_id + 5000000, company_id, doc_id + 5000000, 2 FROM docs WHERE doc_id % 10 = 0),
outcomes AS (SELECT e.event_id, e.company_id, e.doc_id, CASE WHEN d.doc_id IS NULL OR e.acl_version < 2 THEN 'superseded' WHEN e.doc_id % 7 = 0 AND v.doc_id IS NOT NULL AND x.doc_id IS NOT NULL THEN 'failed' ELSE 'completed' END outcome FROM sync_events e
  LEFT JOIN docs d ON d.doc_id = e.doc_id LEFT JOIN versions v ON v.doc_id = e.doc_id AND v.lifecycle = 'active' LEFT JOIN vectors x ON x.doc_id = e.doc_id)"""


def resynced(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One event a document, of ACL version 1 to 3 where 2 holds now, and some for documents that are gone; each seventh's points lie in a collection of their own."""
    docs = m.documents.select("company_id", "doc_id", "owner_unit_id", F.lit(2).alias("acl_version"), F.lit(0).alias("synced_version"))
    e = docs.select(F.col("doc_id").alias("event_id"), "company_id", "doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("acl_version"))
    gone = e.where("doc_id % 10 = 0").select((F.col("doc_id") + 5_000_000).alias("event_id"), "company_id", (F.col("doc_id") + 5_000_000).alias("doc_id"), F.lit(2).alias("acl_version"))
    points = m.vectors.select("doc_id").join(docs.select("company_id", "doc_id"), "doc_id").select(
        "company_id", "doc_id", F.lit(2).alias("version"), when("doc_id % 7 = 0", F.lit("other"), F.lit("main")).alias("collection"), F.array().cast("array<bigint>").alias("scope_ids"),
        F.lit("old").alias("sensitivity"), F.lit(None).cast("long").alias("owner_unit_id"), F.lit(1).alias("acl_version"),
    )
    return ingest.resync(e.union(gone), docs, access.resource_scope(m.documents, m.grants, m.closure, AS_OF), m.versions, points, ["main"])


@query(sql("SELECT event_id, outcome FROM outcomes", SYNC))
def s06_resync(m: Model) -> DataFrame:
    return resynced(m)[0].select("event_id", "outcome")


@query(sql("SELECT d.doc_id, CASE WHEN o.doc_id IS NULL THEN 0 ELSE 2 END synced_version FROM docs d LEFT JOIN (SELECT DISTINCT doc_id FROM outcomes WHERE outcome = 'completed') o USING (doc_id)", SYNC))
def s06_synced(m: Model) -> DataFrame:
    return resynced(m)[1].select("doc_id", "synced_version")


@query(sql("""SELECT x.doc_id, CASE WHEN o.doc_id IS NULL THEN '' ELSE s.units END scope_ids, CASE WHEN o.doc_id IS NULL THEN 'old' ELSE v.sensitivity END sensitivity, CASE WHEN o.doc_id IS NOT NULL THEN d.owner_unit_id END owner_unit_id, CASE WHEN o.doc_id IS NULL THEN 1 ELSE 2 END acl_version
FROM vectors x JOIN docs d USING (doc_id) JOIN versions v ON v.doc_id = x.doc_id AND v.version = 2 LEFT JOIN (SELECT DISTINCT doc_id FROM outcomes WHERE outcome = 'completed') o ON o.doc_id = x.doc_id AND v.lifecycle = 'active'
LEFT JOIN (SELECT doc_id, string_agg(unit_id::VARCHAR, ',' ORDER BY unit_id) units FROM resource_scope GROUP BY 1) s ON s.doc_id = x.doc_id""", SYNC))
def s06_points(m: Model) -> DataFrame:
    return resynced(m)[2].select("doc_id", F.array_join(F.transform("scope_ids", lambda u: u.cast("string")), ",").alias("scope_ids"), "sensitivity", "owner_unit_id", "acl_version")


@query(sql("SELECT edge_id FROM edges WHERE edge_id % 5 <> 0"))
def s09_edge_cleanup(m: Model) -> DataFrame:
    """Every fifth edge is deleted, and its event names the points that it had, once in each of two models."""
    rows = m.edges.select("edge_id").withColumn("deleted", F.lit(False))
    gone = edges.delete(rows, rows.where("edge_id % 5 = 0").select("edge_id"))[1]
    events = gone.select(F.array(F.col("edge_id"), F.col("edge_id") + 1_000_000).alias("point_ids"))
    return ingest.drop_points(rows.select(F.col("edge_id").alias("point_id")), events).select(F.col("point_id").alias("edge_id"))


@query(sql("SELECT doc_id, version, ordinal FROM old_rows WHERE doc_id % 2 = 0", LAYOUTS))
def s19_committed(m: Model) -> DataFrame:
    """Two ingests; the one of odd documents broke off before its marker."""
    rows = layout(m, F.col("doc_id") % 5 + 2, "old", "2024-01-01")
    path = f"{shared_dir(m.spark)}/ingest-{uuid.uuid4().hex}"
    ingest.commit({"sections": rows.where("doc_id % 2 = 0"), "audit": rows.where("doc_id % 2 = 0").select("doc_id").distinct()}, path)
    rows.where("doc_id % 2 = 1").write.parquet(f"{path}/sections/run=broken")
    return ingest.committed(m.spark, path, "sections", rows.schema).select("doc_id", "version", "ordinal")


# Points, prompts and caches.


@query(sql("SELECT chunk_id, label FROM vectors WHERE chunk_id IN (SELECT event_id * 100000 FROM ev WHERE event_type = 'view')"))
def io09_fetch(m: Model) -> DataFrame:
    """The points of the chunks that view events name; most ids are of no point."""
    ids = m.events.where("event_type = 'view'").select((F.col("event_id") * PER_DOC).alias("chunk_id"))
    return vectors.fetch(m.vectors, ids, ["chunk_id"]).select("chunk_id", F.col("label").cast("long").alias("label"))


@query(sql("SELECT chunk_id, 'm' || label % 3 model_id FROM vectors WHERE label % 3 = 1"))
def io05_one_model(m: Model) -> DataFrame:
    """Points of three models in one collection, read back for one."""
    path = f"{shared_dir(m.spark)}/points-{uuid.uuid4().hex}"
    vectors.write_collection(m.vectors.select("chunk_id", "v", F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model_id")), path)
    return m.spark.read.parquet(path).where("model_id = 'm1'").select("chunk_id", "model_id")


@query(sql("SELECT event_id, event_type FROM ev WHERE tenant = 3"))
def io01_tenant_log(m: Model) -> DataFrame:
    """All events appended to a log in two turns, and one tenant's rows of it."""
    path = f"{shared_dir(m.spark)}/log-{uuid.uuid4().hex}"
    e = m.events.withColumnRenamed("tenant", "company_id")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        logs.append(part, path)
    return logs.tenant(m.spark, path, 3).select("event_id", "event_type")


@query(r"""SELECT url, CASE WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'html' END file_type, 'tag' || page_id % 4 company_tag FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 = 1 AND page_id % 5 <> 0""")
def io14_manifest(m: Model) -> DataFrame:
    """Pages as a manifest, an entry a line, filtered by all three."""
    p = m.table("pages").select("url", when("page_id % 3 = 0", F.lit("pdf"), F.lit("html")).alias("file_type"), F.concat(F.lit("tag"), (F.col("page_id") % 4).cast("string")).alias("company_tag"), when("page_id % 5 = 0", F.lit("closed"), F.lit("open")).alias("license"))
    path = f"{shared_dir(m.spark)}/manifest-{uuid.uuid4().hex}"
    p.write.json(path)
    return logs.manifest(m.spark, path, "html", "tag1", "open", lines=True).select("url", "file_type", "company_tag")


@query(sql(f"""SELECT user_id FROM users u JOIN (SELECT company_id, count(*) n FROM units GROUP BY 1) e USING (company_id) LEFT JOIN (SELECT company_id, user_id, min(expires_at) e FROM all_memberships GROUP BY ALL) x USING (company_id, user_id)
WHERE epoch_ms({T} + INTERVAL 4 MINUTE) < least(epoch_ms({T}) + 300000, coalesce(epoch_ms(x.e), 9e15::BIGINT)) AND user_id % 6 <> 0 AND company_id <> 2"""))
def g03_cached(m: Model) -> DataFrame:
    """Entries made at noon hold four minutes later unless an epoch has moved: company 2's, and every sixth user's."""
    acl, users = access.epoch_bumps(m.units, joined(m, 0))
    made = access.resolve(m.users, memberships(m), m.closure, acl, users, AS_OF)
    live = made.select("company_id", "user_id", (F.col("acl_epoch") + F.expr("int(company_id = 2)")).alias("acl_epoch"), (F.col("scope_epoch") + F.expr("int(user_id % 6 = 0)")).alias("scope_epoch"))
    return access.cached(made, live, "2024-01-15 00:04:00").select("user_id")


@query(sql("SELECT edge_id, CASE WHEN edge_id % 5 IN (1, 3) THEN target_doc ELSE source_doc END left_doc, CASE WHEN edge_id % 5 IN (1, 3) THEN source_doc ELSE target_doc END right_doc FROM edges"))
def v12_orientation(m: Model) -> DataFrame:
    """Roles of the two ends by number: source/target, target/source, both sources, object/subject, none."""
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("edge_id") % 5 + 1).cast("int"))
    left = ingest.oriented(pick("source", "target", "source", "object", None), pick("target", "source", "subject", "subject", None))
    return m.edges.select("edge_id", when(left == 1, F.col("target_doc"), F.col("source_doc")).alias("left_doc"), when(left == 1, F.col("source_doc"), F.col("target_doc")).alias("right_doc"))


@query()
def v11_prompt_tokens(m: Model) -> DataFrame:
    """As v11_prompt, within the usual budget of tokens; sequential by nature, see the tests."""
    return pack_prompt(m, merged(m, 30), budget_tokens=8192 - 2048)


@query(sql("SELECT edge_id, review_state FROM edges WHERE company_id = 1 AND review_state IN ('approved', 'pending') AND (source_doc = 1 * 25 + 1 OR target_doc = 1 * 25 + 1)"))
def p10_listed_edges(m: Model) -> DataFrame:
    """One tenant's edges at one document, in one of two states, of any type."""
    return edges.listed(m.edges, endpoints(m), 1, None, ["approved", "pending"], 26).select("edge_id", "review_state")


@query(sql("SELECT e.company_id, e.edge_type, count(*)::BIGINT n FROM edges e GROUP BY ALL"))
def p10_all_edges(m: Model) -> DataFrame:
    """Without filters all edges are listed, for each tenant."""
    return edges.listed(m.edges, endpoints(m)).groupBy("company_id", "edge_type").agg(F.count("*").alias("n"))


@query(sql("SELECT page_id, version, CASE WHEN version = 1 + page_id % 3 THEN 'active' WHEN version = 1 THEN 'deprecated' ELSE 'draft' END lifecycle FROM (SELECT page_id, v.i AS version FROM pages, range(1, 4) v(i))"))
def h05_promote_pages(m: Model) -> DataFrame:
    """Three versions of every page, the first active; version 1, 2 or 3 is promoted."""
    none = F.lit(None).cast("timestamp")
    v = m.table("pages").select(F.col("page_id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("version"))
    v = v.withColumns({"lifecycle": when("version = 1", F.lit("active"), F.lit("draft")), "activated_at": when("version = 1", F.lit("2023-06-01").cast("timestamp"), none), "superseded_at": none})
    want = v.select("doc_id", (1 + F.col("doc_id") % 3).alias("version")).distinct()
    return temporal.promote(v, want, AS_OF).select(F.col("doc_id").alias("page_id"), "version", "lifecycle")


@query(sql("""SELECT edge_id, seq, op, doc_0, doc_1, ts valid_from, CASE WHEN op = 'delete' THEN ts ELSE lead(ts) OVER (PARTITION BY edge_id ORDER BY ts, seq) END valid_to
FROM (SELECT e.edge_id, v.event_id seq, v.ts, CASE WHEN v.event_type = 'error' THEN 'delete' ELSE 'update' END op, e.source_doc doc_0, e.target_doc doc_1 FROM ev v JOIN edges e ON e.edge_id = v.user_id)"""))
def h07_edge_history(m: Model) -> DataFrame:
    """Events as changes to the edge of their user's number, with the edge's ends."""
    ends = m.edges.select("edge_id", F.col("source_doc").alias("doc_0"), F.col("target_doc").alias("doc_1"))
    e = m.events.select(F.col("user_id").alias("edge_id"), F.col("event_id").alias("seq"), "ts", when("event_type = 'error'", F.lit("delete"), F.lit("update")).alias("op")).join(ends, "edge_id")
    return temporal.history(e, ["edge_id"]).select("edge_id", "seq", "op", "doc_0", "doc_1", "valid_from", "valid_to")


# Bytes and files.


#: Byte sequences that aren't UTF-8: an overlong form, a surrogate, a value beyond the last one, a lone byte, a cut sequence.
BAD_BYTES = ("C080", "EDA080", "F4908080", "FF", "E282")


@query("SELECT doc_id, doc_id % 7 >= 5 AS valid FROM documents")
def f10_utf8(m: Model) -> DataFrame:
    """Whole texts; five of seven get bytes at their end that aren't UTF-8."""
    bad = F.element_at(F.array(*[F.unhex(F.lit(b)) for b in BAD_BYTES], F.unhex(F.lit("")), F.unhex(F.lit(""))), (F.col("doc_id") % 7 + 1).cast("int"))
    return m.table("documents").select("doc_id", text.valid_utf8(F.concat(F.encode("text", "UTF-8"), bad)).alias("valid"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id > 16384 OR event_id < 1 THEN 0 ELSE event_id END::INT AS col FROM events""")
def f24_sheet_columns(m: Model) -> DataFrame:
    """The event's number as a column's letters; every ninth reference is malformed."""
    n = F.col("event_id").cast("long")
    steps = F.aggregate(F.array(*map(F.lit, range(5))), F.struct(n.alias("n"), F.lit("").alias("s")), lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(((s["n"] - 1) % 26 + 65).cast("int")), s["s"]).alias("s"))).otherwise(s), lambda s: s["s"])
    ref = F.concat(steps, when("event_id % 9 = 0", F.lit("-7"), F.lit("7")))
    return m.table("events").select("event_id", text.sheet_column(ref).alias("col"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 3 OR page_id % 11 IN (0, 10) THEN 0 ELSE page_id % 11 END::INT AS level FROM pages")
def f25_heading_levels(m: Model) -> DataFrame:
    """Styles in four spellings, one of which is no heading's; levels 0 and 10 are none."""
    p = m.table("pages")
    name = F.element_at(F.array(*map(F.lit, ("Heading ", "heading", "HEADING ", "Subheading "))), (F.col("page_id") % 4 + 1).cast("int"))
    return p.select("page_id", text.heading_level(F.concat(name, (F.col("page_id") % 11).cast("string"))).alias("level"))


def office(kind: str, page: int) -> bytes:
    """A small file of one of the office formats: three headed parts whose texts hold the page's number; every fifth is broken."""
    parts = [(f"Part {k} of {page}", [f"line {k}.{i} of {page}" for i in range(page % 3 + 1)]) for k in range(3)]
    w = 'xmlns:w="urn:w" xmlns:a="urn:a" xmlns:p="urn:p" xmlns:text="urn:t" xmlns:table="urn:tb" xmlns:office="urn:o"'
    entries = {}
    if kind == "docx":
        p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
        body = "".join(p(h, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + "".join(map(p, lines)) for h, lines in parts)
        entries["word/document.xml"] = f"<w:document {w}><w:body>{body}</w:body></w:document>"
    elif kind == "pptx":
        shape = lambda t, ph="": f"<p:sp>{ph}<p:txBody>" + "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in t) + "</p:txBody></p:sp>"
        for k, (h, lines) in enumerate(parts, 1):
            entries[f"ppt/slides/slide{k}.xml"] = f"<p:sld {w}>{shape([h], '<p:nvPr><p:ph type=\"title\"/></p:nvPr>')}{shape(lines)}</p:sld>"
    elif kind == "xlsx":
        sheets = "".join(f'<sheet name="{h}"/>' for h, _ in parts)
        entries["xl/workbook.xml"] = f"<workbook><sheets>{sheets}</sheets></workbook>"
        for k, (_, lines) in enumerate(parts, 1):
            rows = "".join(f'<row><c r="A{i}" t="inlineStr"><is><t>{t}</t></is></c></row>' for i, t in enumerate(lines, 1))
            entries[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
    else:
        body = "".join(f'<text:h text:outline-level="1">{h}</text:h>' + "".join(f"<text:p>{t}</text:p>" for t in lines) for h, lines in parts)
        entries["content.xml"] = f"<office:document-content {w}><office:body>{body}</office:body></office:document-content>"
    if page % 5 == 0:
        entries = {k: v[:-5] for k, v in entries.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in entries.items():
            z.writestr(name, xml)
    return out.getvalue()


def office_files(m: Model, kind: str) -> DataFrame:
    """(path, length, content) of one file for each page."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [office(kind, p) for p in b["page_id"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"path": [f"{p}.{kind}" for p in b["page_id"].to_pylist()], "length": pa.array(map(len, made), pa.int64()), "content": pa.array(made, pa.binary())})

    return m.table("pages").select(F.col("page_id").cast("long").alias("page_id")).mapInArrow(make, "path string, length long, content binary")


OFFICE = """SELECT page_id || '.{kind}' AS path, CASE WHEN page_id % 5 = 0 THEN 'malformed_xml' END error, k.i::INT ordinal, CASE WHEN page_id % 5 <> 0 THEN 'Part ' || k.i || ' of ' || page_id END heading,
CASE WHEN page_id % 5 <> 0 THEN (SELECT string_agg('line ' || k.i || '.' || l.i || ' of ' || page_id, chr(10) ORDER BY l.i) FROM range(0, 3) l(i) WHERE l.i <= page_id % 3) END body FROM pages, range(0, 3) k(i) WHERE page_id % 5 <> 0 OR k.i = 0"""


def office_query(kind: str, name: str) -> None:
    def run(m: Model) -> DataFrame:
        found = files.parse(office_files(m, kind)).select("path", "error", F.posexplode_outer("sections").alias("n", "s"))
        return found.select("path", "error", F.coalesce("n", F.lit(0)).alias("ordinal"), "s.heading", "s.body")

    run.__name__, run.__doc__ = name, f"A {kind} file for each page, parsed into sections; every fifth holds broken XML."
    query(OFFICE.format(kind=kind))(run)


for _kind, _name in (("docx", "d06_docx"), ("pptx", "d07_pptx"), ("xlsx", "d08_xlsx"), ("odt", "d09_odt")):
    office_query(_kind, _name)
