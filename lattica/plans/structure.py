"""Registered queries over trees, histories, partitions, indexes and evaluations; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import chunking
from lattica.operators import access, checks, graph, hierarchy, retrieve, temporal, vectors
from lattica.tables import shared_dir, stored

from .model import AS_OF, Model, sql
from .queries import ASK, CLEARED, DOT, EDGE_CANDIDATES, EDGE_GATE, FEED, FOUND, HITS, INTERVALS, OK, POINTS, SHARES, TURNS, edge_candidates, edge_gate, feed, merged, query, retrieved, scope

# Trees.


@query(sql("""SELECT company_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY path)::INT - 1 pos, unit_id, (len(path) - 1)::INT AS depth, NULL::VARCHAR error FROM chart""", """mine AS MATERIALIZED (SELECT s.company_id, s.user_id, u.unit_id, u.parent_id, u.name FROM scope s JOIN units u USING (company_id, unit_id) WHERE s.user_id % 50 = 0),
chart AS (SELECT m.company_id, m.user_id, m.unit_id, [{'name': m.name, 'unit_id': m.unit_id}] path FROM mine m WHERE NOT EXISTS (FROM mine p WHERE p.user_id = m.user_id AND p.unit_id = m.parent_id)
  UNION ALL SELECT m.company_id, m.user_id, m.unit_id, list_append(c.path, {'name': m.name, 'unit_id': m.unit_id}) FROM chart c JOIN mine m ON m.user_id = c.user_id AND m.parent_id = c.unit_id)"""))
def v15_org_charts(m: Model) -> DataFrame:
    """The forests of all users with user_id % 50 = 0, from the roots down and by name."""
    return hierarchy.charts(m.units, scope(m).where("user_id % 50 = 0"))


TREE = """heads AS MATERIALIZED (SELECT d, doc_id, k, line, CASE WHEN k % 3 = 0 THEN 1 + (k * 7 + doc_id) % 6 END::INT AS depth FROM (
  SELECT row_number() OVER () d, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 k FROM documents)),
tree AS MATERIALIZED (SELECT d, doc_id, (row_number() OVER (PARTITION BY d ORDER BY k) - 1)::INT ordinal, regexp_replace(line, '\\r+$', '') heading, depth FROM heads WHERE depth IS NOT NULL),
above AS MATERIALIZED (SELECT t.d, t.ordinal, max(p.ordinal) parent FROM tree t LEFT JOIN tree p ON p.d = t.d AND p.ordinal < t.ordinal AND p.depth < t.depth GROUP BY ALL),
paths AS (SELECT t.d, t.ordinal, a.parent, CASE WHEN heading = '' THEN [] ELSE [heading] END path, 0 n FROM tree t JOIN above a USING (d, ordinal)
  UNION ALL SELECT p.d, p.ordinal, a.parent, CASE WHEN t.heading = '' THEN p.path ELSE list_prepend(t.heading, p.path) END, p.n + 1 FROM paths p JOIN tree t ON t.d = p.d AND t.ordinal = p.parent JOIN above a ON a.d = t.d AND a.ordinal = t.ordinal)"""


@query("WITH RECURSIVE " + TREE + """ SELECT t.doc_id, t.ordinal, a.parent::INT parent, t.heading, t.depth, array_to_string(p.path, ' > ') heading_path FROM tree t JOIN above a USING (d, ordinal) JOIN paths p ON p.d = t.d AND p.ordinal = t.ordinal AND p.parent IS NULL""")
def d02_heading_tree(m: Model) -> DataFrame:
    """Every third line of all documents as a heading, of levels that go up and down."""
    mark = lambda x, k: F.when(k % 3 == 0, F.concat(F.repeat(F.lit("#"), (1 + (k * 7 + F.col("doc_id")) % 6).cast("int")), F.lit(" "), x)).otherwise(F.concat(F.lit("."), x))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), mark)
    docs = m.table("documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return chunking.sections(docs).select("doc_id", "ordinal", "parent", "heading", "depth", "heading_path")


# Histories and partitions.


def appended(m: Model, feed: DataFrame, key: list[str], parts: list) -> DataFrame:
    """The history of a feed that comes in parts, each appended to what is stored."""
    h = temporal.History(m.spark, f"{shared_dir(m.spark)}/history-{uuid.uuid4().hex}", key)
    for p in parts:
        h.append(feed.where(p))
    return h.rows()


@query(sql("SELECT user_id, seq, op, k, valid_from, valid_to FROM intervals", FEED, INTERVALS))
def h06_history_appended(m: Model) -> DataFrame:
    """The history of ``h06_history``, from a first half in order of time, a second one, and late changes to both."""
    half = F.col("ts") < F.lit(AS_OF).cast("timestamp")
    late = F.col("seq") % 10 == 0
    return appended(m, feed(m), ["user_id"], [half & ~late, ~half & ~late, late])


EDGE_FEED = """edge_feed AS (SELECT e.edge_id, e.source_doc, e.target_doc, v.event_id seq, v.ts, CASE v.event_type WHEN 'error' THEN 'delete' ELSE 'update' END op, round(e.confidence::DOUBLE * (1 + v.k % 3) / 3, 6) confidence FROM edges e JOIN ev v ON v.user_id = e.edge_id)"""


@query(sql("SELECT edge_id, source_doc, target_doc, seq, op, confidence, ts valid_from, CASE WHEN op = 'delete' THEN ts ELSE lead(ts) OVER (PARTITION BY edge_id ORDER BY ts, seq) END valid_to FROM edge_feed", EDGE_FEED))
def h07_edge_history(m: Model) -> DataFrame:
    """Relationships with their endpoints, as changes came day by half."""
    e = m.edges.select("edge_id", "source_doc", "target_doc", "confidence")
    v = m.events.select(F.col("user_id").alias("edge_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"), "k")
    changes = e.join(v, "edge_id").withColumn("confidence", F.round(F.col("confidence").cast("double") * (1 + F.col("k") % 3) / 3, 6)).drop("k")
    changes = stored(changes, "edge-feed")
    half = F.col("ts") < F.lit(AS_OF).cast("timestamp")
    return appended(m, changes, ["edge_id"], [half, ~half])


DAYS = """days AS (SELECT DISTINCT 'day' kind, ts::DATE starts, ts::DATE + 1 ends FROM ev),
actual AS (SELECT kind, CASE WHEN day(starts) % 10 = 3 THEN starts - 1 ELSE starts END::DATE starts, CASE WHEN day(starts) % 10 = 7 THEN ends + 2 WHEN day(starts) % 10 = 9 THEN starts ELSE ends END::DATE ends FROM days WHERE day(starts) % 10 <> 5)"""


@query(sql("""SELECT d.kind, d.starts, CASE WHEN count(a.ends) = 0 THEN 'missing' ELSE 'wrong bounds' END problem FROM days d LEFT JOIN actual a USING (kind, starts) GROUP BY d.kind, d.starts, d.ends HAVING count(a.ends) = 0 OR count(DISTINCT a.ends) > 1 OR min(a.ends) <> d.ends
UNION ALL SELECT kind, starts, CASE WHEN starts < e THEN 'overlap' ELSE 'gap before' END FROM (SELECT *, max(ends) OVER (PARTITION BY kind ORDER BY starts, ends ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) e FROM actual WHERE starts < ends) WHERE starts <> e
UNION ALL SELECT kind, starts, 'empty' FROM actual WHERE starts >= ends""", DAYS))
def io13_partition_problems(m: Model) -> DataFrame:
    """A partition for each day that has events; some are missing, begin early, end late or are empty."""
    days = m.events.select(F.lit("day").alias("kind"), F.col("ts").cast("date").alias("starts")).distinct().withColumn("ends", F.date_add("starts", 1))
    d = F.dayofmonth("starts") % 10
    actual = days.where(d != 5).select("kind", F.when(d == 3, F.date_sub("starts", 1)).otherwise(F.col("starts")).alias("starts"), F.when(d == 7, F.date_add("ends", 2)).when(d == 9, F.col("starts")).otherwise(F.col("ends")).alias("ends"))
    return temporal.partition_problems(actual, days)


# Indexes.


@query(sql("SELECT query_id, chunk_id, score, pos FROM hits", POINTS, ASK, FOUND, HITS))
def v09_retrieve_by_index(m: Model) -> DataFrame:
    """``v09_retrieve`` with reach taken from an inverted index of the points, unit by unit."""
    return retrieved(m, reach=reach_by_index).select("query_id", "chunk_id", "score", "pos")


def index(m: Model) -> DataFrame:
    """The inverted index of all points, as it would be kept: a folder for each company."""
    # Only documents with points: the others' units would be found in vain.
    docs = m.documents.select("company_id", "doc_id", "owner_unit_id").join(m.vectors.select("doc_id"), "doc_id", "left_semi")
    units = access.resource_scope(docs, m.grants, m.closure, AS_OF).groupBy("company_id", "doc_id").agg(F.collect_set("unit_id").alias("scope_ids"))
    now = m.versions.where("version = 2").select("company_id", "doc_id", "lifecycle", "sensitivity")
    points = m.vectors.select("doc_id", "chunk_id").join(now, "doc_id").join(units, ["company_id", "doc_id"])
    path = f"{shared_dir(m.spark)}/postings-{uuid.uuid4().hex}"
    made = vectors.postings(points)
    made.write.partitionBy("company_id").parquet(path)
    return m.spark.read.parquet(path).withColumn("company_id", F.col("company_id").cast("long")).select(*made.columns)


def reach_by_index(m: Model, mine: DataFrame) -> DataFrame:
    return vectors.prefilter(index(m), mine, CLEARED).select("company_id", "user_id", "doc_id")


@query(sql("SELECT s.company_id, s.user_id, count(*)::BIGINT n FROM visible s JOIN vectors x USING (doc_id) JOIN versions v ON v.doc_id = s.doc_id AND v.version = 2 AND v.lifecycle = 'active' AND v.sensitivity IN ('public', 'internal', 'confidential') WHERE s.user_id % 50 = 0 GROUP BY ALL"))
def p07_prefilter(m: Model) -> DataFrame:
    """How many points are in the reach of each user that asks."""
    mine = scope(m).where("user_id % 50 = 0")
    like = access.alike(mine)
    return access.shared(vectors.prefilter(index(m), access.only(mine, like), CLEARED).groupBy("company_id", "user_id").agg(F.count("*").alias("n")), like)


ASKED = """asked AS (SELECT edge_id * 10 + i event_id, CASE WHEN edge_id % 23 = 0 THEN edge_id + 5000000 ELSE edge_id END edge_id, (i % 3)::BIGINT model_id FROM edges, range(0, 4) r(i)),
before AS (SELECT edge_id, 0::BIGINT model_id, (edge_id % 4)::INT indexed_version FROM edges WHERE edge_id % 3 = 0),
judged AS (SELECT a.*, CASE WHEN e.edge_id IS NULL THEN 'NoEdge' WHEN b.indexed_version >= 1 + e.edge_id % 3 THEN 'Superseded' WHEN a.model_id > 1 THEN 'ModelDisabled' WHEN e.edge_id % 19 = 0 THEN 'retry: missing endpoint vector' ELSE 'Completed' END outcome, (1 + e.edge_id % 3)::INT edge_version
  FROM asked a LEFT JOIN edges e USING (edge_id) LEFT JOIN before b ON b.edge_id = a.edge_id AND b.model_id = a.model_id)"""


def indexed(m: Model) -> tuple[DataFrame, DataFrame]:
    """Four events for each edge, two of one model; a third of the edges is indexed already, some at their present version."""
    vec = lambda key, name: m.vectors.select(F.col("doc_id").alias(key), F.col("v").alias(name))
    auth = lambda key, name: m.documents.select(F.col("doc_id").alias(key), F.col("authority").alias(name))
    e = m.edges.select("edge_id", "source_doc", "target_doc", "edge_type", (1 + F.col("edge_id") % 3).cast("int").alias("edge_version"))
    live = e.join(auth("source_doc", "auth_s"), "source_doc").join(auth("target_doc", "auth_t"), "target_doc").join(vec("source_doc", "v_s"), "source_doc").join(vec("target_doc", "v_t"), "target_doc")
    live = live.join(vec("edge_type", "v_type").withColumn("edge_type", F.col("edge_type").cast("int")), "edge_type").withColumn("v_t", F.when(F.col("edge_id") % 19 != 0, F.col("v_t")))
    live = stored(live, "live")
    events = e.select("edge_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select((F.col("edge_id") * 10 + F.col("i")).alias("event_id"), F.when(F.col("edge_id") % 23 == 0, F.col("edge_id") + 5_000_000).otherwise(F.col("edge_id")).alias("edge_id"), (F.col("i") % 3).cast("long").alias("model_id"))
    models = m.spark.range(2).select(F.col("id").alias("model_id"), F.lit(True).alias("enabled"))
    before = e.where("edge_id % 3 = 0").select("edge_id", F.lit(0).cast("long").alias("model_id"), (F.col("edge_id") % 4).cast("int").alias("indexed_version"), F.array().cast("array<double>").alias("vector"))
    return vectors.index_edges(events, live, models, before)


@query(sql("SELECT event_id, edge_id, model_id, outcome FROM judged", ASKED))
def v06_index_outcomes(m: Model) -> DataFrame:
    return indexed(m)[0]


@query(sql("""SELECT coalesce(n.edge_id, b.edge_id) edge_id, coalesce(n.model_id, b.model_id) model_id, coalesce(n.edge_version, b.indexed_version) indexed_version, round(CASE WHEN n.edge_id IS NOT NULL THEN p.v[1] END, 5) v0
FROM (SELECT DISTINCT edge_id, model_id, edge_version FROM judged WHERE outcome = 'Completed') n FULL JOIN before b ON b.edge_id = n.edge_id AND b.model_id = n.model_id LEFT JOIN edge_points p ON p.edge_id = n.edge_id""", ASKED, SHARES))
def v07_index_after(m: Model) -> DataFrame:
    """The points after those events; versions only go up."""
    return indexed(m)[1].select("edge_id", "model_id", "indexed_version", F.round(F.get("vector", F.lit(0)), 5).alias("v0"))


# Retrieval by intent, and how good it is.


REQUESTS = """requests AS (SELECT user_id query_id, (['fact', 'bridge', 'automatic', 'guess'])[(user_id // 50 % 4 + 1)::INT] intent, user_id % 350 <> 0 has_edges, CASE WHEN user_id % 150 = 0 THEN [] WHEN user_id % 100 = 0 THEN ['approved', 'auto'] ELSE ['approved'] END states FROM users WHERE user_id % 50 = 0),
answers AS (SELECT *, CASE WHEN intent = 'guess' THEN 'invalid_input' WHEN intent = 'bridge' AND NOT has_edges THEN 'unavailable' WHEN (intent = 'bridge' OR intent = 'automatic' AND has_edges) AND len(states) = 0 THEN 'invalid_input' ELSE 'ok' END outcome FROM requests),
sides AS (SELECT h.query_id, 'chunk' kind, h.chunk_id id, 2 * (row_number() OVER (PARTITION BY h.query_id ORDER BY h.pos) - 1) p FROM hits h JOIN answers a ON a.query_id = h.query_id AND a.outcome = 'ok' AND a.intent <> 'bridge'
  UNION ALL SELECT g.query_id, 'relationship', g.edge_id, 2 * (row_number() OVER (PARTITION BY g.query_id ORDER BY g.rank, g.edge_id) - 1) + 1 FROM edge_gate g JOIN edges e USING (edge_id) JOIN answers a ON a.query_id = g.query_id AND a.outcome = 'ok' AND (a.intent = 'bridge' OR a.intent = 'automatic' AND a.has_edges) AND list_contains(a.states, e.review_state))"""


def requests(m: Model) -> DataFrame:
    u = F.col("user_id")
    states = F.when(u % 150 == 0, F.array().cast("array<string>")).when(u % 100 == 0, F.array(F.lit("approved"), F.lit("auto"))).otherwise(F.array(F.lit("approved")))
    intent = F.element_at(F.array(*map(F.lit, ("fact", "bridge", "automatic", "guess"))), (F.expr("user_id div 50") % 4 + 1).cast("int"))
    return m.users.where("user_id % 50 = 0").select(u.alias("query_id"), intent.alias("intent"), (u % 350 != 0).alias("has_edges"), states.alias("states"))


@query(sql("""SELECT a.query_id, a.intent, a.outcome, s.pos, s.kind, s.id FROM answers a LEFT JOIN (SELECT query_id, kind, id, row_number() OVER (PARTITION BY query_id ORDER BY p)::INT pos FROM sides QUALIFY pos <= 12) s ON s.query_id = a.query_id""", POINTS, ASK, FOUND, HITS, EDGE_CANDIDATES, OK, EDGE_GATE, REQUESTS))
def v10_intents(m: Model) -> DataFrame:
    """Requests for facts, bridges, either or neither, some without an edge store or a state that they allow."""
    chunks = retrieved(m).select("query_id", F.col("pos").alias("rank"), F.col("chunk_id").alias("id"))
    found = edge_gate(m, edge_candidates(m).where("query_id % 50 = 0")).rows.select("query_id", "rank", F.col("edge_id").alias("id"))
    found = found.join(m.edges.select(F.col("edge_id").alias("id"), "review_state"), "id")
    outcomes, evidence = retrieve.by_intent(requests(m), chunks, found, 12)
    return outcomes.select("query_id", "intent", "outcome").join(evidence, "query_id", "left").select("query_id", "intent", "outcome", "pos", "kind", "id")


@query(sql("SELECT g.query_id, count(*)::BIGINT n, 1.0::DOUBLE AS precision FROM merged g GROUP BY g.query_id", POINTS, ASK, FOUND, HITS, EDGE_CANDIDATES, OK, EDGE_GATE, TURNS))
def x09_authorised(m: Model) -> DataFrame:
    """The share of evidence that its user may read, decided anew by meeting expanded sets. It must be 1."""
    found = merged(m)
    key = F.concat("kind", F.lit(":"), F.col("id").cast("string")).alias("key")
    chunks = found.where("kind = 'chunk'").join(m.vectors.select(F.col("chunk_id").alias("id"), "doc_id"), "id").select("query_id", F.col("query_id").alias("user_id"), key, "doc_id")
    ends = m.edges.select(F.col("edge_id").alias("id"), F.explode(F.array("source_doc", "target_doc")).alias("doc_id"))
    edges = found.where("kind <> 'chunk'").join(ends, "id").select("query_id", F.col("query_id").alias("user_id"), key, "doc_id")
    evidence = stored(chunks.unionByName(edges), "evidence")
    pairs = evidence.select("user_id", "doc_id").distinct()
    named = m.documents.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    units = access.resource_scope(named, m.grants, m.closure, AS_OF).select("company_id", "doc_id", "unit_id")
    seen = pairs.join(units, "doc_id").join(scope(m), ["company_id", "user_id", "unit_id"], "left_semi").select("user_id", "doc_id").distinct()
    return graph.authorised(evidence, seen)


@query(sql("""SELECT w.query_id, bool_or(coalesce(g.rank <= 10, false)) found FROM (SELECT c.query_id, c.edge_id FROM edge_candidates c JOIN edges e USING (edge_id) JOIN vectors a ON a.doc_id = e.source_doc JOIN vectors b ON b.doc_id = e.target_doc WHERE a.label <> b.label) w
LEFT JOIN edge_gate g ON g.query_id = w.query_id AND g.edge_id = w.edge_id GROUP BY w.query_id""", EDGE_CANDIDATES, OK, EDGE_GATE))
def x09_bridges(m: Model) -> DataFrame:
    """For each user with a relationship between documents of two labels among the candidates: whether one passed the gate within the first ten."""
    label = lambda key, name: m.vectors.select(F.col("doc_id").alias(key), F.col("label").alias(name))
    across = m.edges.join(label("source_doc", "a"), "source_doc").join(label("target_doc", "b"), "target_doc").where("a <> b").select("edge_id")
    wanted = edge_candidates(m).join(across, "edge_id", "left_semi").select("query_id", F.col("edge_id").alias("id"))
    return graph.bridges(edge_gate(m).rows.select("query_id", "rank", F.col("edge_id").alias("id")), wanted, 10)


# Guards.


@query(sql("""SELECT 'endpoints are fixed' AS rule, edge_id::VARCHAR AS key FROM edges WHERE edge_id % 7 = 0 OR edge_id % 11 = 0
UNION ALL SELECT 'turns are fixed', conv_id || ':' || turn FROM conversations WHERE turn % 9 = 5"""))
def r03_frozen(m: Model) -> DataFrame:
    """Every seventh edge has another target and every eleventh is gone; each ninth turn's text was changed."""
    e = m.edges.select("edge_id", "source_doc", "target_doc", "confidence")
    after = e.where("edge_id % 11 <> 0").withColumns({"target_doc": F.when(F.col("edge_id") % 7 == 0, F.col("target_doc") + 1).otherwise(F.col("target_doc")), "confidence": F.col("confidence") + 1})
    turns = m.table("conversations").select("conv_id", "turn", "role", "text")
    later = turns.withColumn("text", F.when(F.col("turn") % 9 == 5, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return checks.changed(e, after, ["edge_id"], ["source_doc", "target_doc"], "endpoints are fixed").union(checks.changed(turns, later, ["conv_id", "turn"], ["role", "text"], "turns are fixed"))
