"""Versions, histories and retention. Times are parameters; nothing asks the clock."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import at


class PromotionError(ValueError):
    pass


def promote(versions: DataFrame, changes: DataFrame, t: str) -> DataFrame:
    """Versions after each (doc_id, version) of ``changes`` has become the active one.

    The document's active version becomes deprecated first. Archived versions
    can't be promoted, and what is active already keeps its times.
    """
    new = changes.select("doc_id", F.col("version").alias("_new"))
    rows = versions.join(new, "doc_id", "left")
    if not rows.where("version = _new and lifecycle = 'archived'").isEmpty():
        raise PromotionError("an archived version can't be promoted")
    mine = F.coalesce(F.col("version") == F.col("_new"), F.lit(False))
    other = F.coalesce((F.col("version") != F.col("_new")) & (F.col("lifecycle") == "active"), F.lit(False))
    return rows.withColumns({
        "activated_at": F.when(mine & (F.col("lifecycle") != "active"), at(t)).otherwise(F.col("activated_at")),
        "superseded_at": F.when(mine, F.lit(None)).when(other, at(t)).otherwise(F.col("superseded_at")),
        "lifecycle": F.when(mine, "active").when(other, "deprecated").otherwise(F.col("lifecycle")),
    }).select(*versions.columns)


def history(changes: DataFrame, key: list[str], order: list[str] = ["ts", "seq"]) -> DataFrame:
    """Intervals [valid_from, valid_to) from a change feed with ``op`` (insert, update, delete).

    Each change closes the row before it; a delete leaves an interval of no
    length that says who went.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    until = F.when(F.col("op") == "delete", F.col("ts")).otherwise(F.lead("ts").over(w))
    return changes.withColumn("valid_from", F.col("ts")).withColumn("valid_to", until).drop("ts")


def as_of(rows: DataFrame, t: str) -> DataFrame:
    return rows.where((F.col("valid_from") <= at(t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at(t))))


def in_force(versions: DataFrame, t: str) -> DataFrame:
    """Versions that were active at ``t``."""
    return versions.where((F.col("activated_at") <= at(t)) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > at(t))))


def retention_due(rows: DataFrame, t: str, days: Column | int) -> DataFrame:
    """Rows (created_at, retention_until) whose time is over."""
    days = F.lit(days) if isinstance(days, int) else days
    return rows.where(F.coalesce("retention_until", F.col("created_at") + F.make_dt_interval(days)) <= at(t))


def without_targets(grants: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """Grants left after documents and units are gone."""
    docs = grants.where("resource_type = 'document'").join(documents.select("company_id", F.col("doc_id").alias("resource_id")), ["company_id", "resource_id"], "left_semi")
    of = units.select("company_id", F.col("unit_id").alias("resource_id"))
    on_units = grants.where("resource_type = 'org_unit'").join(of, ["company_id", "resource_id"], "left_semi")
    rest = grants.where("resource_type not in ('document', 'org_unit')")
    return reduce(DataFrame.unionByName, (docs, on_units, rest)).join(units.select("company_id", F.col("unit_id").alias("principal_id")), ["company_id", "principal_id"], "left_semi")


def sign_in(users: DataFrame, seen: DataFrame, t: str) -> DataFrame:
    """Users (issuer, subject, email, deactivated_at, last_seen) after a batch of sign-ins; they come back if deactivated."""
    new = seen.groupBy("issuer", "subject").agg(F.max("email").alias("_email"))
    both = users.join(new.withColumn("_now", F.lit(True)), ["issuer", "subject"], "full")
    return both.select("issuer", "subject", F.coalesce("_email", "email").alias("email"), F.when(F.col("_now"), None).otherwise(F.col("deactivated_at")).alias("deactivated_at"), F.when(F.col("_now"), at(t)).otherwise(F.col("last_seen")).alias("last_seen"))


def expected_partitions(spark, t: str, quarters: int = 4, months: int = 12) -> DataFrame:
    """(kind, starts, ends): the quarters and months for which partitions must exist."""
    of = lambda kind, unit, n, step: spark.range(n).select(F.lit(kind).alias("kind"), F.add_months(F.trunc(at(t).cast("date"), unit), (F.col("id") * step).cast("int")).alias("starts")).withColumn("ends", F.add_months("starts", step))
    return of("quarter", "quarter", quarters, 3).union(of("month", "month", months, 1))


def overflow(rows: DataFrame, partitions: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows that no partition (starts, ends) holds."""
    p = partitions.select("starts", "ends").distinct()
    return rows.join(p, (rows[ts] >= p.starts) & (rows[ts] < p.ends), "left_anti")


def append(kept: DataFrame, feed: DataFrame, key: list[str], order: list[str] = ["seq"]) -> tuple[DataFrame, DataFrame]:
    """(rows that go, rows that come) when more of a change feed meets a stored history of the part before.

    ``kept`` has the columns of ``history``. Only keys of the feed are looked
    at, and of those only the rows that the first new change may still touch:
    the ones that were open at its time or begin later. In a feed that comes
    in order of time those are the open rows, one for each key; a late change
    reopens closed rows. Whatever the split, the result is the history of the
    whole feed, if ``order`` tells apart a key's changes of equal time.
    """
    first = feed.groupBy(*key).agg(F.min("ts").alias("_first"))
    touched = kept.join(first, key).where(F.col("valid_to").isNull() | (F.col("valid_to") >= F.col("_first")) | (F.col("valid_from") >= F.col("_first"))).drop("_first")
    again = touched.withColumn("ts", F.col("valid_from")).drop("valid_from", "valid_to")
    return touched, history(again.unionByName(feed), key, ["ts", *order])


class History:
    """A stored history, open and closed rows apart, so that changes in order of time read and write few rows.

    Closed rows are only added to, in folders of their own for each append,
    unless late changes reopen some. One writer appends.
    """

    def __init__(self, spark, path: str, key: list[str], order: list[str] = ["seq"]):
        self.spark, self.path, self.key, self.order = spark, path, key, order
        self.open: DataFrame | None = None
        self.closed: list[DataFrame] = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.open, *self.closed])

    def append(self, feed: DataFrame) -> None:
        is_open = F.col("valid_to").isNull()
        if self.open is None:
            new = self._kept(history(feed, self.key, ["ts", *self.order]), "new")
            self.open, self.closed = self._kept(new.where(is_open), "open"), [self._kept(new.where(~is_open), "closed")]
            return
        feed = self._kept(feed, "feed")
        first = feed.groupBy(*self.key).agg(F.min("ts").alias("_first"))
        late = lambda df: df.join(first, self.key).where((F.col("valid_to") >= F.col("_first")) | (F.col("valid_from") >= F.col("_first"))).drop("_first")
        reopened = self._kept(reduce(DataFrame.unionByName, [late(c) for c in self.closed]), "reopened")
        gone, come = append(self.open.unionByName(reopened), feed, self.key, self.order)
        come = self._kept(come, "come")
        same = [*self.key, *self.order, "valid_from"]
        if not reopened.isEmpty():
            self.closed = [self._kept(c.join(reopened.select(*same), same, "left_anti"), "closed") for c in self.closed]
        self.open = self._kept(self.open.join(gone.select(*same), same, "left_anti").unionByName(come.where(is_open)), "open")
        self.closed.append(self._kept(come.where(~is_open), "closed"))


def partition_problems(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(kind, starts, problem) for partitions (kind, starts, ends) of a table: missing, wrong bounds, gap before, overlap.

    ``expected`` says which must exist. Beyond that the ranges of each kind are
    swept in order of their starts: one that begins before the latest end so
    far overlaps an earlier one, not only its neighbour; one that begins after
    it leaves a gap. Ranges that end before they begin are empty.
    """
    e = expected.select("kind", "starts", F.col("ends").alias("_ends"))
    both = e.join(actual.groupBy("kind", "starts").agg(F.collect_set("ends").alias("_found")), ["kind", "starts"], "left")
    bounds = both.select("kind", "starts", F.when(F.col("_found").isNull(), "missing").when((F.size("_found") > 1) | (F.col("_found")[0] != F.col("_ends")), "wrong bounds").alias("problem")).where("problem is not null")
    before = Window.partitionBy("kind").orderBy("starts", "ends").rowsBetween(Window.unboundedPreceding, -1)
    swept = actual.where("starts < ends").withColumn("_end", F.max("ends").over(before))
    swept = swept.select("kind", "starts", F.when(F.col("starts") < F.col("_end"), "overlap").when(F.col("starts") > F.col("_end"), "gap before").alias("problem")).where("problem is not null")
    return bounds.union(swept).union(actual.where("starts >= ends").select("kind", "starts", F.lit("empty").alias("problem")))
