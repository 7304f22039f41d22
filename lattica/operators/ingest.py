"""Writing documents: layouts that replace earlier ones, points that follow changed access, commits as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.sources.pointset import PointSet

VERSION = ["company_id", "doc_id", "version"]


def replace(old: DataFrame, new: DataFrame, versions: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """(rows after ``versions`` were ingested again, orphans).

    Within such a version a row of ``new`` takes the place of the old one with
    its ``number`` and keeps the old ``created_at``; old rows without a new one
    are orphans and go, all of them if nothing new came. Other versions stay.
    """
    mine = old.join(versions.select(*VERSION), VERSION, "left_semi")
    was = mine.select(*VERSION, number, F.col("created_at").alias("_was"))
    taken = new.join(was, [*VERSION, number], "left").withColumn("created_at", F.coalesce("_was", "created_at")).drop("_was")
    kept = old.join(versions.select(*VERSION), VERSION, "left_anti")
    return kept.unionByName(taken.select(*old.columns)), mine.join(new.select(*VERSION, number), [*VERSION, number], "left_anti")


def without_lost_sections(chunks: DataFrame, orphans: DataFrame) -> DataFrame:
    """Chunks whose section went have none."""
    gone = orphans.select(*VERSION, F.col("ordinal").alias("section")).withColumn("_gone", F.lit(True))
    return chunks.join(gone, [*VERSION, "section"], "left").withColumn("section", F.when(F.col("_gone").isNull(), F.col("section"))).select(*chunks.columns)


def resync(events: DataFrame, documents: DataFrame, scopes: DataFrame, versions: DataFrame, points: DataFrame, served: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, documents, points) after resync events (event_id, company_id, doc_id, acl_version).

    An event older than its document's ``acl_version``, or of a document that
    is gone, is superseded. Else the points of the document's active version
    get its present scopes, owner, label and ACL version, and the document is
    synced up to that version. If one of its points lies in a collection that
    isn't ``served``, the event fails and nothing of the document changes.
    ``scopes``: (company_id, doc_id, unit_id); only those of the documents
    concerned are gathered.
    """
    doc = ["company_id", "doc_id"]
    asked = events.join(documents.select(*doc, F.col("acl_version").alias("_now")), doc, "left")
    active = versions.where("lifecycle = 'active'").select(*doc, "version", "sensitivity")
    strange = points.join(active, [*doc, "version"], "left_semi").where(~F.col("collection").isin(served)).select(*doc).distinct().withColumn("_strange", F.lit(True))
    asked = asked.join(strange, doc, "left")
    outcome = F.when(F.col("_now").isNull() | (F.col("acl_version") < F.col("_now")), "superseded").when(F.col("_strange"), "failed").otherwise("completed")
    outcomes = asked.withColumn("outcome", outcome).select(*events.columns, "outcome")
    done = outcomes.where("outcome = 'completed'").select(*doc).distinct()
    units = scopes.join(done, doc, "left_semi").groupBy(*doc).agg(F.array_sort(F.collect_set("unit_id")).alias("_scopes"))
    now = active.select(*doc, "version", F.col("sensitivity").alias("_label")).join(documents.select(*doc, F.col("owner_unit_id").alias("_owner"), F.col("acl_version").alias("_acl")), doc).join(units, doc)
    both = points.join(now, [*doc, "version"], "left")
    here = F.col("_acl").isNotNull()
    new = {"scope_ids": "_scopes", "sensitivity": "_label", "owner_unit_id": "_owner", "acl_version": "_acl"}
    patched = both.withColumns({c: F.when(here, F.col(v)).otherwise(F.col(c)) for c, v in new.items()}).select(*points.columns)
    synced = documents.join(done.withColumn("_done", F.lit(True)), doc, "left")
    return outcomes, synced.withColumn("synced_version", F.when(F.col("_done"), F.col("acl_version")).otherwise(F.col("synced_version"))).select(*documents.columns), patched


def drop_points(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points left after edge-delete events with the ids of their points (point_ids)."""
    return points.join(events.select(F.explode("point_ids").alias("point_id")), "point_id", "left_anti")


def newest(points: DataFrame, changes: DataFrame) -> DataFrame:
    """Points (doc_id, acl_version, label, gone, ...) after changes (doc_id, acl_version, gone, label).

    A document's change of the highest version counts, and only if it is
    higher than the points' own; so changes may come in any order, and again.
    A deleted document's points stay as tombstones (``gone``), which keep
    their version, so that an older change can't bring them back.
    """
    last = changes.groupBy("doc_id").agg(F.max_by(F.struct("acl_version", "gone", "label"), "acl_version").alias("_c"))
    both = points.join(last, "doc_id", "left")
    here = F.coalesce(F.col("_c.acl_version") > F.col("acl_version"), F.lit(False))
    return both.withColumns({c: F.when(here, F.col(f"_c.{c}")).otherwise(F.col(c)) for c in ("gone", "label", "acl_version")}).select(*points.columns)


def follow(changes: DataFrame, points: PointSet, checkpoint: str) -> None:
    """Apply a stream of changes (as in ``newest``) to a stored point set until all that is available is in.

    The set's one writer is ``foreachBatch``; a batch that is replayed after a
    failure finds its number in the set and changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        touched = batch.select(points.key).distinct()
        points.apply(number, touched, lambda p: newest(p, batch))

    changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def commit(tables: dict[str, DataFrame], path: str) -> str:
    """Write one ingest (sections, chunks, audit and so on) as a whole; returns its name.

    All tables are written first, then one marker. Without the marker nothing
    of it is ever read, so a run that broke off leaves nothing behind.
    """
    name = uuid.uuid4().hex
    for table, rows in tables.items():
        rows.write.parquet(f"{path}/{table}/run={name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(name,)], "run string").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return name


def committed(spark: SparkSession, path: str, table: str, schema: StructType) -> DataFrame:
    """Rows of ``table`` from ingests that have their marker."""
    rows = spark.read.schema(StructType(list(schema.fields)).add("run", "string")).option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")
    return rows.join(spark.read.parquet(f"{path}/commits"), "run", "left_semi").select(*schema.names)


def oriented(role_0: Column, role_1: Column) -> Column:
    """Which end stands on the left: 1 if only that one is a source or a subject, else 0."""
    acts = lambda c: F.coalesce(c.isin("source", "subject"), F.lit(False))
    return F.when(acts(role_1) & ~acts(role_0), 1).otherwise(0)
