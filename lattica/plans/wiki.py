"""Registered queries over pages: citations, the graph of their links, and what a change of documents touches; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import graph

from .model import PER_DOC, Model, sql
from .queries import query

#: Pages have the first word of their title as a slug; pages of one slug are all meant by it.
WIKI = r"""wiki AS MATERIALIZED (SELECT page_id::BIGINT page_id, lower(regexp_extract(html, '<title>([^ <]*)', 1)) slug, list_transform(regexp_extract_all(html, '<a href="/([^"]*)"', 1), lambda x: lower(x)) named FROM pages),
wiki_links AS MATERIALIZED (SELECT DISTINCT page_id, unnest(named) slug FROM wiki),
hrefs AS MATERIALIZED (SELECT DISTINCT l.page_id AS source, t.page_id target FROM wiki_links l JOIN wiki t USING (slug) WHERE t.page_id <> l.page_id)"""
CITED = "cited AS MATERIALIZED (SELECT page_id, page_id doc_id, (1 + page_id % 2)::INT AS version, CASE WHEN page_id % 4 <> 0 THEN page_id * 100000 + page_id % 9 END chunk_id FROM wiki)"
STALE = "('deprecated', 'archived')"


def wiki(m: Model) -> DataFrame:
    """(page_id, slug)."""
    return m.table("pages").select(F.col("page_id").cast("long").alias("page_id"), F.lower(F.regexp_extract("html", "<title>([^ <]*)", 1)).alias("slug"))


def named(m: Model) -> DataFrame:
    """(page_id, slug): the slugs that each page links to."""
    found = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    return m.table("pages").select(F.col("page_id").cast("long").alias("page_id"), F.explode(found).alias("slug")).select("page_id", F.lower("slug").alias("slug")).distinct()


def cited(m: Model) -> DataFrame:
    """Page n cites document n, the older version if n is even; but for each fourth page, one of its first nine chunks."""
    p = F.col("page_id")
    return wiki(m).select("page_id", p.alias("doc_id"), (1 + p % 2).cast("int").alias("version"), F.when(p % 4 != 0, p * PER_DOC + p % 9).alias("chunk_id"))


@query(sql("SELECT 'broken' problem, slug FROM wiki_links WHERE slug NOT IN (SELECT slug FROM wiki) GROUP BY slug UNION ALL SELECT DISTINCT 'orphan', slug FROM wiki w WHERE slug NOT IN (SELECT t.slug FROM hrefs h JOIN wiki t ON t.page_id = h.target)", WIKI))
def r19_link_problems(m: Model) -> DataFrame:
    """Links to no page, and pages without a link to them."""
    return graph.link_problems(wiki(m), named(m))


@query(sql("""SELECT c.page_id, c.doc_id, c.version, c.chunk_id, CASE WHEN v.doc_id IS NULL THEN 'no such version' WHEN c.chunk_id IS NOT NULL AND p.chunk_id IS NULL THEN 'no such chunk' ELSE v.lifecycle END state
FROM cited c LEFT JOIN versions v ON v.doc_id = c.doc_id AND v.version = c.version LEFT JOIN paragraphs p ON p.chunk_id = c.chunk_id""", WIKI, CITED))
def r19_citations(m: Model) -> DataFrame:
    """Citations with the version's lifecycle, or what is wrong with them; those without a chunk are of the version."""
    return graph.citations(cited(m), m.versions.select("doc_id", "version", "lifecycle"), m.paragraphs.select("doc_id", "chunk_id"))


@query(sql(f"SELECT page_id, min(hops)::INT hops FROM reach GROUP BY page_id", WIKI, CITED, f"""reach AS (SELECT c.page_id, 0 hops FROM cited c JOIN versions v USING (doc_id, version) WHERE v.lifecycle IN {STALE}
  UNION SELECT h.source, r.hops + 1 FROM reach r JOIN hrefs h ON h.target = r.page_id WHERE r.hops < 64)"""))
def x05_affected_pages(m: Model) -> DataFrame:
    """Pages that cite a version that is no more in force, and those that lead to such a page, with the fewest links between."""
    stale = graph.citing(cited(m), m.versions, ["deprecated", "archived"]).select(F.col("page_id").alias("page"))
    return graph.reached_by_name(wiki(m), named(m), stale).select(F.col("page").alias("page_id"), "hops")


@query(sql(f"""SELECT t.conv_id, t.turn, t.doc_id, t.version, v.lifecycle FROM (SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, ((conv_id * 7 + turn) % n)::BIGINT doc_id, (1 + turn % 2)::INT AS version FROM conversations, (SELECT count(*) n FROM documents)) t
JOIN versions v ON v.doc_id = t.doc_id AND v.version = t.version WHERE v.lifecycle IN {STALE}"""))
def x05_affected_turns(m: Model) -> DataFrame:
    """Turns of conversations that cite a version no more in force."""
    doc = (F.col("conv_id") * 7 + F.col("turn")) % m.n_docs
    turns = m.table("conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), doc.cast("long").alias("doc_id"), (1 + F.col("turn") % 2).cast("int").alias("version"))
    return graph.citing(turns, m.versions, ["deprecated", "archived"]).select("conv_id", "turn", "doc_id", "version", "lifecycle")


@query(sql("SELECT edge_id, concat_ws(',', CASE WHEN s.deleted THEN 'source' END, CASE WHEN t.deleted THEN 'target' END) lost FROM edges e JOIN docs s ON s.doc_id = e.source_doc JOIN docs t ON t.doc_id = e.target_doc WHERE s.deleted OR t.deleted"))
def x05_edges_losing_ends(m: Model) -> DataFrame:
    """Relationships of which a document is deleted, and which end it is."""
    gone = m.documents.where("deleted").select("doc_id")
    return graph.losing_ends(m.edges.select("edge_id", F.col("source_doc").alias("source"), F.col("target_doc").alias("target")), gone)
