"""Scores, paths and reports over document relationships."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.tables import stored

#: How far an origin is trusted, and the discount of a hop.
ORIGIN = {"manual": 1.0, "imported": 0.9, "rule": 0.9, "model": 0.8}
HOP = 0.8


def origin_factor(origin: Column) -> Column:
    c = F.lit(None).cast("double")
    for name, f in ORIGIN.items():
        c = F.when(origin == name, f).otherwise(c)
    return c


def chunk_score(similarity: Column, authority: Column) -> Column:
    return similarity * authority / 100


def relationship_score(similarity: Column, confidence: Column, origin: Column, authority: Column, hops: Column) -> Column:
    return similarity * confidence * origin_factor(origin) * authority / 100 * F.pow(F.lit(HOP), hops - 1)


#: Halvings of the best edge score by which edges are told apart; what rounding may do to a bound.
STEPS, SLACK = 15, 1e-9


def paths(edges: DataFrame, starts: DataFrame, authority: DataFrame, hops: int = 2, policy: bool = False, best: int | None = None, least: float = 0.0) -> DataFrame:
    """(start, hops, nodes, edge_ids, score) of paths without a repeated node or edge.

    ``edges`` (edge_id, source, target, confidence) hold in both directions and
    count if their confidence, at most 1, is positive; ``starts`` (start);
    ``authority`` (node, factor from 0 to 1), 0 where it is missing. Two hops
    are the most, three under a ``policy``. The score is the geometric mean of
    the confidences, discounted by hop, times the least factor on the path.

    With ``best`` only that many paths of each start come, by score, fewer hops
    and nodes; with ``least`` only those of this score or more. Then a path
    goes on only where the most that any longer one could score reaches what
    its start needs. Edges are joined by node and by halvings of confidence, so
    a hub's weak edges, which no path needs, don't meet it. The bound holds
    for every path, so nothing that belongs to the result is lost.
    """
    most = 3 if policy else 2
    if not 1 <= hops <= most:
        raise ValueError(f"one to {most} hops")
    factor = authority.select(F.col("node").alias("y"), F.col("factor").cast("double").alias("f"))
    e = edges.where("confidence > 0").select("edge_id", "source", "target", F.least(F.lit(0.0), F.ln(F.col("confidence").cast("double"))).alias("log"))
    both = e.select("edge_id", F.col("source").alias("x"), F.col("target").alias("y"), "log").union(e.select("edge_id", "target", "source", "log"))
    both = stored(both.join(factor, "y", "left").select("edge_id", "x", "y", "log", F.coalesce("f", F.lit(0.0)).alias("f"), F.least(F.lit(STEPS), F.floor(-F.col("log") / math.log(2))).cast("int").alias("step")), "links")
    own = authority.select(F.col("node").alias("start"), F.col("factor").cast("double").alias("f"))
    at = starts.join(own, "start", "left").select("start", F.array("start").alias("nodes"), F.array().cast("array<long>").alias("edge_ids"), F.lit(0.0).alias("logs"), F.coalesce("f", F.lit(0.0)).alias("f"), F.col("start").alias("end"))
    pruned = best is not None or least > 0
    found = None
    for n in range(1, hops + 1):
        if pruned:
            at = at.withColumn("need", F.lit(float(least)))
            if found is not None and best is not None:
                full = found.where(F.col("_n") == best).select("start", F.col("score").alias("_kth"))
                at = at.join(full, "start", "left").withColumn("need", F.greatest("need", F.coalesce("_kth", F.lit(0.0)))).drop("_kth")
            # The log that the next edge needs at least if the path gets m hops in all, the later ones being perfect.
            at = at.withColumn("low", F.when(F.col("need") <= 0, F.lit(float("-inf"))).when(F.col("f") > 0, F.least(*[m * (F.ln("need") - F.ln("f") - (m - 1) * math.log(HOP)) - F.col("logs") for m in range(n, hops + 1)], F.lit(float("inf"))) - SLACK).otherwise(F.lit(float("inf"))))
            last = F.when(F.col("low") > 0, -1).when(F.col("low") < -STEPS * math.log(2), STEPS).otherwise(F.floor(-F.col("low") / math.log(2))).cast("int")
            at = at.where("low <= 0").withColumn("step", F.explode(F.sequence(F.lit(0), last)))
            at = at.withColumnRenamed("end", "x").withColumnRenamed("f", "_f").join(both, ["x", "step"]).where(F.col("log") >= F.col("low"))
        else:
            at = at.withColumnRenamed("end", "x").withColumnRenamed("f", "_f").join(both.drop("step"), "x")
        at = at.where(~F.array_contains("nodes", F.col("y")) & ~F.array_contains("edge_ids", F.col("edge_id")))
        at = at.select("start", F.array_append("nodes", F.col("y")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), (F.col("logs") + F.col("log")).alias("logs"), F.least("_f", "f").alias("f"), F.col("y").alias("end"))
        if n < hops:
            at = stored(at, "paths")  # read for the scores and for the next hop
        step = at.select("start", F.lit(n).alias("hops"), "nodes", "edge_ids", (F.exp(F.col("logs") / n) * HOP ** (n - 1) * F.col("f")).alias("score")).where(F.col("score") >= least)
        found = step if found is None else found.drop("_n").unionByName(step)
        if best is not None:
            order = Window.partitionBy("start").orderBy(F.desc("score"), "hops", "nodes", "edge_ids")
            found = stored(found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= best), "best-paths")
    return found.select("start", "hops", "nodes", "edge_ids", "score")


def path_vector(vectors: Column, confidences: Column, dimensions: int, penalty: float = HOP) -> Column:
    """The sum of a path's vectors, each by its confidence and discounted by place, to unit length."""
    parts = F.transform(F.arrays_zip(vectors.alias("v"), confidences.alias("c")), lambda p, i: F.transform(p["v"], lambda x: x * p["c"] * F.pow(F.lit(penalty), i)))
    total = F.aggregate(parts, F.array_repeat(F.lit(0.0), dimensions), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, y: s + y * y)))


def impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_id, n_dependents, n_edges): what hangs on each of ``changed`` (doc_id)."""
    ends = edges.select(F.col("source").alias("doc_id"), F.col("target").alias("other"), "edge_id").union(edges.select("target", "source", "edge_id"))
    return changed.join(ends, "doc_id", "left").groupBy("doc_id").agg(F.count_distinct("other").alias("n_dependents"), F.count("edge_id").alias("n_edges"))


def citing(citations: DataFrame, versions: DataFrame, states: list[str]) -> DataFrame:
    """Citations (doc_id, version, ...) of versions in one of ``states``, with ``lifecycle``."""
    return citations.join(versions.where(F.col("lifecycle").isin(states)).select("doc_id", "version", "lifecycle"), ["doc_id", "version"])


def citations(cited: DataFrame, versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (doc_id, version, chunk_id, ...) with ``state``: the version's lifecycle, or what is missing.

    ``versions`` (doc_id, version, lifecycle), ``chunks`` (doc_id, chunk_id). A
    citation without a chunk is one of the whole version.
    """
    both = cited.join(versions.select("doc_id", "version", F.col("lifecycle").alias("_state")), ["doc_id", "version"], "left")
    both = both.join(chunks.select("doc_id", "chunk_id", F.lit(True).alias("_chunk")), ["doc_id", "chunk_id"], "left")
    state = F.when(F.col("_state").isNull(), "no such version").when(F.col("chunk_id").isNotNull() & F.col("_chunk").isNull(), "no such chunk").otherwise(F.col("_state"))
    return both.select(*cited.columns, state.alias("state"))


def losing_ends(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(edge_id, lost): edges (edge_id, source, target) with an end among ``gone`` (doc_id), and which."""
    of = lambda end: gone.select(F.col("doc_id").alias(end), F.lit(end).alias(f"_{end}"))
    both = edges.join(of("source"), "source", "left").join(of("target"), "target", "left")
    return both.where("_source is not null or _target is not null").select("edge_id", F.concat_ws(",", "_source", "_target").alias("lost"))


def reached(links: DataFrame, first: DataFrame, most: int = 64) -> DataFrame:
    """(page, hops): pages that lead by links (source, target) to one of ``first`` (page), by the fewest hops.

    Those of ``first`` have no hop. Each round joins only the pages that are
    new with the links into them; what was visited before doesn't come again,
    so cycles end. More than ``most`` rounds that find new pages are an error.
    """
    into = stored(links.select(F.col("target").alias("page"), "source").where("page <> source").distinct(), "into")
    new = stored(first.select("page").distinct().withColumn("hops", F.lit(0)), "frontier")
    seen = new
    for n in range(1, most + 2):
        step = new.join(into, "page").select(F.col("source").alias("page")).distinct()
        new = stored(step.join(seen, "page", "left_anti").withColumn("hops", F.lit(n)), "frontier")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise ValueError(f"paths of more than {most} links")


def reached_by_name(pages: DataFrame, links: DataFrame, first: DataFrame, most: int = 64) -> DataFrame:
    """``reached`` where links (page_id, slug) name the slugs of ``pages`` (page_id, slug), of which many pages may have one.

    Steps go from pages to their slugs and from these to the pages that name
    them, each slug once, so links are never paired with all pages they mean.
    """
    links, pages = stored(links.select("page_id", "slug").distinct(), "named"), stored(pages.select(F.col("page_id").alias("page"), "slug").distinct(), "slugs")
    new = stored(first.select("page").distinct().withColumn("hops", F.lit(0)), "frontier")
    seen, known = new, None
    for n in range(1, most + 2):
        slugs = pages.join(new, "page", "left_semi").select("slug").distinct()
        slugs = stored(slugs if known is None else slugs.join(known, "slug", "left_anti"), "slugs")
        known = slugs if known is None else known.union(slugs)
        step = links.join(slugs, "slug", "left_semi").select(F.col("page_id").alias("page")).distinct()
        new = stored(step.join(seen, "page", "left_anti").withColumn("hops", F.lit(n)), "frontier")
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)
    raise ValueError(f"paths of more than {most} links")


def link_problems(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(problem, slug): slugs that links name and no page has, and pages that no other page links to.

    ``pages`` (page_id, slug), ``links`` (page_id, slug), the slug being the target's.
    """
    broken = links.select("slug").distinct().join(pages, "slug", "left_anti").select(F.lit("broken").alias("problem"), "slug")
    of = links.join(pages.select(F.col("page_id").alias("target"), "slug"), "slug").where(F.col("target") != F.col("page_id"))
    lonely = pages.join(of.select("slug").distinct(), "slug", "left_anti").select(F.lit("orphan").alias("problem"), "slug").distinct()
    return broken.union(lonely)


def precision_at(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision) over the first k of (query_id, id, rank)."""
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("precision"))


def authorised(evidence: DataFrame, visible: DataFrame) -> DataFrame:
    """(query_id, n, precision): the share of each query's evidence (query_id, user_id, key, doc_id) whose documents the user all sees.

    Evidence of several documents has a row for each. ``visible`` (user_id,
    doc_id) should be decided apart from the gate that let the evidence pass.
    """
    both = evidence.join(visible.select("user_id", "doc_id", F.lit(1).alias("_seen")), ["user_id", "doc_id"], "left")
    each = both.groupBy("query_id", "key").agg(F.min(F.coalesce("_seen", F.lit(0))).alias("_ok"))
    return each.groupBy("query_id").agg(F.count("*").alias("n"), (F.sum("_ok") / F.count("*")).alias("precision"))


def bridges(evidence: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query_id, found): whether the first ``k`` of (query_id, rank, id) hold one of the relationships wanted (query_id, id)."""
    hits = evidence.where(F.col("rank") <= k).join(wanted.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").select("query_id").distinct()
    return wanted.select("query_id").distinct().join(hits.withColumn("_hit", F.lit(True)), "query_id", "left").select("query_id", F.coalesce("_hit", F.lit(False)).alias("found"))
