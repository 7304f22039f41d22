"""Who may read what.

Reader side: memberships expand to the units a user reads for. Resource side:
grants expand to the units that may read a document. A document is visible to
a user if the two sets meet; that is decided without expanding the resource
side, by semi-joins: ``Readers.among`` for given pairs, ``visible_docs`` for
all users and documents at once. ``t`` is the time as of which expiry counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.tables import stored

SUB, SELF = "self_and_descendants", "self_only"
ROLES = {"viewer": 1, "editor": 2, "admin": 3}
#: Sensitivity from low to high; readers are cleared up to the third.
LABELS = ("public", "internal", "confidential", "restricted")
READING = ("read", "write", "admin")


def at(t: str) -> Column:
    return F.lit(t).cast("timestamp")


def not_expired(t: str, column: str = "expires_at") -> Column:
    return F.col(column).isNull() | (F.col(column) > at(t))


def covers(applies_to: str = "applies_to", depth: str = "depth") -> Column:
    """Whether something that holds for a unit holds for a descendant at this depth."""
    return (F.col(applies_to) == SUB) | (F.col(depth) == 0)


def clearance(principal: str = "member") -> list[str]:
    """Labels that any kind of principal may read; none goes beyond confidential."""
    return list(LABELS[:3])


def labels_up_to(label: str) -> list[str]:
    return list(LABELS[: LABELS.index(label) + 1])


@dataclass(frozen=True)
class Cohorts:
    """Who is in which groups, by cohorts of users who are in the same ones.

    ``groups`` (company_id, group_id, cohort), ``users`` (company_id, user_id,
    cohort). Both grow with the input, while the rows of groups with their
    members grow with groups times users.
    """

    groups: DataFrame
    users: DataFrame

    def each(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """(company_id, user_id, columns...) of ``rows`` (company_id, group_id, columns...), for each user once."""
        few = rows.join(self.groups, ["company_id", "group_id"]).select("company_id", "cohort", *columns).distinct()
        return few.join(self.users, ["company_id", "cohort"]).select("company_id", "user_id", *columns)

    def counts(self) -> DataFrame:
        """(company_id, user_id, n): of how many groups each user is, without those in none."""
        n = self.groups.groupBy("company_id", "cohort").agg(F.count("*").alias("n"))
        return self.users.join(n, ["company_id", "cohort"]).select("company_id", "user_id", "n")


def of_members(rows: DataFrame, members: DataFrame | Cohorts, columns: list[str]) -> DataFrame:
    """(company_id, user_id, columns...): rows of groups for each user in them (company_id, group_id, user_id)."""
    if isinstance(members, Cohorts):
        return members.each(rows, columns)
    return rows.join(members, ["company_id", "group_id"]).select("company_id", "user_id", *columns)


def all_memberships(memberships: DataFrame, group_memberships: DataFrame, group_members: DataFrame | Cohorts, t: str) -> DataFrame:
    """Direct and group memberships that haven't expired, each once."""
    columns = ["unit_id", "applies_to", "role", "expires_at"]
    by_group = of_members(group_memberships.where(not_expired(t)), group_members, columns)
    return memberships.where(not_expired(t)).select("company_id", "user_id", *columns).union(by_group).distinct()


def expand(memberships: DataFrame, tree: DataFrame) -> DataFrame:
    """Memberships on each unit that they reach (``unit_id``)."""
    found = memberships.withColumnRenamed("unit_id", "ancestor").join(tree, ["company_id", "ancestor"]).where(covers())
    return found.withColumnRenamed("descendant", "unit_id")


def reader_scope(memberships: DataFrame, tree: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(company_id, user_id, unit_id), on request only below units of ``within`` (company_id, unit_id)."""
    scope = expand(memberships, tree).select("company_id", "user_id", "unit_id").distinct()
    if within is None:
        return scope
    below = within.withColumnRenamed("unit_id", "ancestor").join(tree, ["company_id", "ancestor"]).select("company_id", F.col("descendant").alias("unit_id"))
    return scope.join(below, ["company_id", "unit_id"], "left_semi").select("company_id", "user_id", "unit_id")


def resolve(users: DataFrame, memberships: DataFrame, tree: DataFrame, epochs: DataFrame, scope_epochs: DataFrame, t: str, minutes: int = 5) -> DataFrame:
    """One row for every user: size of the scope, epochs, and until when it may be cached.

    A user without a scope still has a row. The cache ends after ``minutes`` or
    with the first membership that expires, in whole milliseconds.
    """
    n = reader_scope(memberships, tree).groupBy("company_id", "user_id").agg(F.count("*").alias("n_units"))
    first = memberships.groupBy("company_id", "user_id").agg(F.min("expires_at").alias("first_expiry"))
    out = users.select("company_id", "user_id").join(n, ["company_id", "user_id"], "left").join(first, ["company_id", "user_id"], "left")
    out = out.join(epochs, "company_id", "left").join(scope_epochs, ["company_id", "user_id"], "left")
    until = F.least(F.unix_millis(at(t)) + minutes * 60_000, F.unix_millis("first_expiry"))
    return out.select("company_id", "user_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("acl_epoch", F.lit(0)).alias("acl_epoch"), F.coalesce("scope_epoch", F.lit(0)).alias("scope_epoch"), until.alias("cache_until_ms"))


def cached(entries: DataFrame, live: DataFrame, t: str) -> DataFrame:
    """Cache entries that still hold: in time, and with both epochs as now."""
    found = entries.alias("e").join(live.alias("l"), ["company_id", "user_id"])
    return found.where((F.unix_millis(at(t)) < F.col("e.cache_until_ms")) & (F.col("e.acl_epoch") == F.col("l.acl_epoch")) & (F.col("e.scope_epoch") == F.col("l.scope_epoch"))).select("e.*")


def has_role(memberships: DataFrame, tree: DataFrame, required: str) -> DataFrame:
    """(company_id, user_id, unit_id) where the role is ``required`` at least; none for an unknown role."""
    enough = [r for r, k in ROLES.items() if required in ROLES and k >= ROLES[required]]
    return expand(memberships.where(F.col("role").isin(enough)), tree).select("company_id", "user_id", "unit_id").distinct()


def reading(grants: DataFrame, t: str) -> DataFrame:
    return grants.where(not_expired(t) & F.col("permission").isin(*READING))


def covered_docs(grants: DataFrame, documents: DataFrame, tree: DataFrame) -> DataFrame:
    """(company_id, doc_id, principal_id, principal_applies_to): documents with the grants that cover them."""
    columns = ["company_id", "doc_id", "principal_id", "principal_applies_to"]
    direct = grants.where("resource_type = 'document'").withColumnRenamed("resource_id", "doc_id").join(documents.select("company_id", "doc_id"), ["company_id", "doc_id"])
    owned = documents.select("company_id", "doc_id", F.col("owner_unit_id").alias("descendant")).join(tree, ["company_id", "descendant"]).withColumnRenamed("ancestor", "resource_id")
    by_unit = grants.where("resource_type = 'org_unit'").join(owned, ["company_id", "resource_id"]).where(covers("resource_applies_to"))
    return direct.select(*columns).union(by_unit.select(*columns)).distinct()


def resource_scope(documents: DataFrame, grants: DataFrame, tree: DataFrame, t: str) -> DataFrame:
    """(company_id, doc_id, unit_id): all units that may read each document."""
    own = documents.select("company_id", "doc_id", F.col("owner_unit_id").alias("unit_id"))
    given = covered_docs(reading(grants, t), documents, tree).withColumnRenamed("principal_id", "ancestor")
    given = given.join(tree, ["company_id", "ancestor"]).where(covers("principal_applies_to"))
    return own.union(given.select("company_id", "doc_id", F.col("descendant").alias("unit_id"))).distinct()


def alike(scope: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """(company_id, user_id, like): for each user the least one with the same scope, who sees the same documents.

    What hangs on the scope alone is worked out for those few and holds for
    all. With ``users`` (company_id, user_id) those without a scope come too.
    """
    sets = scope.groupBy("company_id", "user_id").agg(F.array_sort(F.collect_set("unit_id")).alias("units"))
    if users is not None:
        sets = users.select("company_id", "user_id").distinct().join(sets, ["company_id", "user_id"], "left").withColumn("units", F.coalesce("units", F.array().cast("array<long>")))
    sets = stored(sets, "sets")
    least = sets.groupBy("company_id", "units").agg(F.min("user_id").alias("like"))
    return stored(sets.join(least, ["company_id", "units"]).select("company_id", "user_id", "like"), "alike")


def only(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` (company_id, user_id, ...) of those users that stand for others."""
    return rows.join(like.select("company_id", F.col("like").alias("user_id")).distinct(), ["company_id", "user_id"], "left_semi").select(*rows.columns)


def shared(rows: DataFrame, like: DataFrame) -> DataFrame:
    """``rows`` (company_id, user_id, ...) of users that stand for others, for each of these; no shuffle follows."""
    found = rows.withColumnRenamed("user_id", "like").join(in_blocks(like), ["company_id", "like"])
    return found.select(*[c for c in rows.columns if c not in ("company_id", "user_id")], "company_id", F.inline("users")).select(*rows.columns)


#: Users of one scope that come as one list, about.
BLOCK = 1024


def in_blocks(like: DataFrame, columns: list[str] = ["user_id"]) -> DataFrame:
    """(company_id, like, users): users (company_id, user_id, like, ...) of the same ``like`` as lists of ``columns``.

    What they share joins a list at once, and the lists then open into rows.
    """
    most = like.groupBy("company_id", "like").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    block = F.pmod(F.xxhash64("user_id"), F.lit(max(1, -(-most // BLOCK)))).alias("_block")
    return like.groupBy("company_id", "like", block).agg(F.collect_list(F.struct(*columns)).alias("users")).drop("_block")


#: Users of one scope in one list: a multiple of 8, as many as Parquet packs into one run, so that lists that come again repeat byte by byte.
LIST = 504
#: Lists that meet in one tile and rows of a tile: at most, about. The fewest rows worth a tile, and tiles for each core.
LISTS, ROWS, LEAST, TILES = 256, 8192, 512, 16


@dataclass(frozen=True)
class Crowd:
    """All users as lists of users of the same scope, dealt to blocks (``in_lists``).

    ``lists`` (company_id, like, block, ``columns``...): each of ``columns`` is
    an array with an entry for each user. What lists and rows make together
    grows with their product, so nothing of it is shuffled or stored: lists and
    rows are dealt to tiles, in which each list meets all rows in turn.
    """

    lists: DataFrame
    columns: list[str]
    companies: int
    blocks: int

    def everywhere(self, rows: DataFrame) -> DataFrame:
        """``rows`` for each block."""
        return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))

    def met(self, rows: DataFrame, on: str | None = None) -> DataFrame:
        """``rows`` (company_id, block, ...), stored, with each list of their company and block for which ``on`` holds, as ``like`` and arrays.

        A list meets its rows one after the other, and so do the users in it
        when it opens: long runs of the same values, and the same users again
        and again, which is what keeps a result of this length small on disk.
        """
        tile, spark = ["company_id", "block", "_stripe"], rows.sparkSession
        n = rows.groupBy("company_id", "block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
        stripes = max(1, -(-n // ROWS), min(-(-n // LEAST), -(-TILES * spark.sparkContext.defaultParallelism // (self.companies * self.blocks))))
        tiles = max(self.companies * self.blocks * stripes, int(spark.conf.get("spark.sql.shuffle.partitions")))
        lists = self.lists.withColumn("_stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).repartition(tiles, *tile)
        dealt = rows.withColumn("_stripe", F.pmod(F.monotonically_increasing_id(), F.lit(stripes)).cast("int")).repartition(tiles, *tile)
        # Merged, as the left side then comes list by list; sent to all tasks, lists would change from row to row.
        both = lists.hint("merge").join(dealt, tile).drop("block", "_stripe")
        both = both if on is None else both.where(on)
        # Generated code holds all that one row of it makes; coalesce ends it here, so that is a list's rows, then a row's users, not their product.
        return both.coalesce(tiles)

    def opened(self, met: DataFrame) -> DataFrame:
        """``met`` with a row for each user of its lists."""
        first, *more = self.columns
        if not more:
            return met.withColumn(first, F.explode(first))
        rows = met.select(*[c for c in met.columns if c != first], F.posexplode(first).alias("_i", first))
        return rows.withColumns({c: F.col(c)[F.col("_i")] for c in more}).drop("_i")


#: Whether the users of a list are among the row's ``likes``.
AMONG = "array_contains(likes, like)"


def in_lists(like: DataFrame, columns: list[str] = ["user_id"]) -> Crowd:
    """Users (company_id, user_id, like, ...) of the same ``like`` as lists of at most ``LIST``, in the order of ``columns``."""
    key = ["company_id", "like"]
    sizes = stored(like.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / (16 * LIST)).cast("int")), "sizes")
    n, most = sizes.groupBy("company_id").agg(F.sum(F.ceil(F.col("_n") / LIST)).alias("n")).agg(F.count("*"), F.max("n")).first()  # two numbers
    blocks = max(1, -(-(most or 0) // LISTS))
    parts = like.join(sizes, key).withColumn("_part", F.pmod(F.xxhash64("user_id"), F.col("_parts")).cast("int"))
    parts = parts.groupBy(*key, "_part").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_users"))
    cut = F.transform(F.sequence(F.lit(0), ((F.size("_users") - 1) / LIST).cast("int")), lambda i: F.slice("_users", i * LIST + 1, LIST))
    lists = parts.select(*key, "_part", F.posexplode(cut).alias("_k", "_users"))
    block = F.pmod(F.xxhash64("like", "_part", "_k"), F.lit(blocks)).cast("int").alias("block")
    return Crowd(stored(lists.select(*key, block, *[F.col("_users")[c].alias(c) for c in columns]), "lists"), columns, max(1, n), blocks)


def visible_docs(scope: DataFrame, documents: DataFrame, grants: DataFrame, tree: DataFrame, t: str, like: DataFrame | None = None) -> DataFrame:
    """(company_id, user_id, doc_id) that each reader of ``scope`` sees.

    Who sees a document is decided once for all readers of the same scope
    (``alike``), and these are kept as one list for each document and block.
    """
    crowd = in_lists(alike(scope) if like is None else like)
    seen = stored(Readers(scope, documents, grants, tree, t).seen(None, crowd), "seen")
    return crowd.opened(crowd.met(seen, AMONG)).select("company_id", "user_id", "doc_id")


def visible_to(scope: DataFrame, documents: DataFrame, grants: DataFrame, tree: DataFrame, t: str) -> DataFrame:
    """``visible_docs`` of each reader by itself: for few readers.

    Three arms: the owner is in scope, a grant on the document, a grant on a
    unit that covers the owner. A principal of a grant with descendants may be
    an ancestor of a unit in scope; otherwise it must be in scope itself.
    """
    own = documents.select("company_id", "doc_id", F.col("owner_unit_id").alias("unit_id")).join(scope, ["company_id", "unit_id"])
    given = covered_docs(reading(grants, t), documents, tree)
    exact = given.where(F.col("principal_applies_to") == SELF).withColumnRenamed("principal_id", "unit_id").join(scope, ["company_id", "unit_id"])
    # Reader side once: each unit that is in scope or above one.
    keys = scope.withColumnRenamed("unit_id", "descendant").join(tree, ["company_id", "descendant"]).select("company_id", "user_id", F.col("ancestor").alias("principal_id")).distinct()
    above = given.where(F.col("principal_applies_to") == SUB).join(keys, ["company_id", "principal_id"])
    return reduce(DataFrame.union, [x.select("company_id", "user_id", "doc_id") for x in (own, exact, above)]).distinct()


@dataclass(frozen=True)
class Readers:
    """All that decides who reads what: scopes, documents with their owners, grants and the tree, as of ``t``."""

    scope: DataFrame
    documents: DataFrame
    grants: DataFrame
    tree: DataFrame
    t: str

    def among(self, pairs: DataFrame) -> DataFrame:
        """(company_id, user_id, doc_id): those of ``pairs`` in which the user sees the document.

        Scopes and documents are cut down to those that ``pairs`` name before
        anything expands, so the work follows the pairs. What a document needs
        is a unit, in the user's scope or, for grants that reach down, in scope
        or above it.
        """
        user, doc = ["company_id", "user_id"], ["company_id", "doc_id"]
        asked = stored(pairs.select("company_id", "user_id", "doc_id").distinct(), "asked")
        needs, has = self.needs(asked.select(*doc).distinct()), self.has(asked.select(*user).distinct())
        return asked.join(needs, doc).join(has, [*user, "unit_id", "down"], "left_semi").select("company_id", "user_id", "doc_id").distinct()

    def seen(self, docs: DataFrame | None, crowd: Crowd) -> DataFrame:
        """(company_id, doc_id, block, likes): who in each block of ``crowd`` sees one of ``docs``, or of all documents; no row where nobody does."""
        user, unit = ["company_id", "user_id"], ["company_id", "unit_id", "down"]
        who = stored(crowd.lists.select("company_id", F.col("like").alias("user_id"), "block").distinct(), "who")
        has = self.has(who.select(*user).distinct()).join(who, user).groupBy(*unit, "block").agg(F.collect_set("user_id").alias("likes"))
        met = self.needs(docs).join(has, unit)
        return met.groupBy("company_id", "doc_id", "block").agg(F.array_distinct(F.flatten(F.collect_list("likes"))).alias("likes"))

    def needs(self, docs: DataFrame | None) -> DataFrame:
        """(company_id, doc_id, unit_id, down): any one of these lets a user read one of ``docs`` (company_id, doc_id), which are distinct, or of all documents."""
        doc = ["company_id", "doc_id"]
        named = self.documents.select(*doc, "owner_unit_id")
        docs = named if docs is None else named.join(docs, doc, "left_semi")
        own = docs.select(*doc, F.col("owner_unit_id").alias("unit_id"), F.lit(False).alias("down"))
        given = covered_docs(reading(self.grants, self.t), docs, self.tree)
        return own.union(given.select(*doc, "principal_id", F.col("principal_applies_to") == SUB)).distinct()

    def has(self, users: DataFrame) -> DataFrame:
        """(company_id, user_id, unit_id, down): what each of ``users`` (company_id, user_id) has to meet ``needs`` with."""
        user = ["company_id", "user_id"]
        scope = self.scope.join(users, user, "left_semi")
        above = scope.withColumnRenamed("unit_id", "descendant").join(self.tree, ["company_id", "descendant"]).select(*user, F.col("ancestor").alias("unit_id"), F.lit(True).alias("down"))
        return scope.select(*user, "unit_id", F.lit(False).alias("down")).union(above)


def affected_docs(changes: DataFrame, documents: DataFrame, tree: DataFrame) -> DataFrame:
    """(company_id, doc_id) whose readers a grant change may change; wiki pages affect none."""
    direct = changes.where("resource_type = 'document'").select("company_id", F.col("resource_id").alias("doc_id"))
    direct = documents.join(direct, ["company_id", "doc_id"], "left_semi").select("company_id", "doc_id")
    units = changes.where("resource_type = 'org_unit'").select("company_id", F.col("resource_id").alias("ancestor"), "resource_applies_to").join(tree, ["company_id", "ancestor"]).where(covers("resource_applies_to"))
    units = units.select("company_id", F.col("descendant").alias("owner_unit_id"))
    return direct.union(documents.join(units, ["company_id", "owner_unit_id"], "left_semi").select("company_id", "doc_id")).distinct()


def epoch_bumps(unit_changes: DataFrame, membership_changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How often the company's and the users' epochs go up.

    ``unit_changes`` (company_id); ``membership_changes`` (company_id,
    old_user, new_user): both count, once if equal. With a column ``n`` a row
    stands for that many changes.
    """
    n = F.sum("n") if "n" in membership_changes.columns else F.count("*")
    users = membership_changes.withColumn("user_id", F.explode(F.array_compact(F.array_distinct(F.array("old_user", "new_user")))))
    return unit_changes.groupBy("company_id").agg(F.count("*").alias("acl_epoch")), users.groupBy("company_id", "user_id").agg(n.alias("scope_epoch"))


def capabilities(features: DataFrame, user_grants: DataFrame, group_grants: DataFrame, unit_grants: DataFrame, group_members: DataFrame | Cohorts, scope: DataFrame, t: str) -> DataFrame:
    """(company_id, user_id, capability): enabled for the tenant and given to user, group or unit.

    It never says anything about evidence.
    """
    live = lambda g: g.where(F.col("revoked_at").isNull() & not_expired(t))
    one = live(user_grants).select("company_id", "user_id", "capability")
    two = of_members(live(group_grants), group_members, ["capability"])
    three = live(unit_grants).join(scope, ["company_id", "unit_id"]).select("company_id", "user_id", "capability")
    return one.union(two).union(three).distinct().join(features.where("enabled"), ["company_id", "capability"], "left_semi").select("company_id", "user_id", "capability")


#: Allowed steps of privileged sessions.
STEPS = {("requested", "approved"), ("requested", "denied"), ("requested", "cancelled"), ("approved", "active"), ("approved", "cancelled"), ("active", "ended"), ("active", "revoked")}


def session_problems(sessions: DataFrame, approvals: DataFrame, t: str) -> DataFrame:
    """(session_id, problem) for proposed steps that aren't legal.

    ``sessions``: session_id, requester, state, proposed, needed, starts_at,
    ends_at; ``approvals``: session_id, approver, decision.
    """
    votes = approvals.groupBy("session_id").agg(F.count_if(F.col("decision") == "approve").alias("yes"), F.count_if(F.col("decision") == "reject").alias("no"))
    own = approvals.select("session_id", F.col("approver").alias("requester")).distinct().withColumn("own", F.lit(True))
    s = sessions.join(votes, "session_id", "left").join(own, ["session_id", "requester"], "left").fillna(0, ["yes", "no"])
    allowed = reduce(lambda a, b: a | b, [(F.col("state") == x) & (F.col("proposed") == y) for x, y in sorted(STEPS)])
    approving = F.col("proposed") == "approved"
    problems = F.array_compact(F.array(
        F.when(~allowed, "transition"), F.when(approving & (F.col("yes") < F.col("needed")), "approvals"), F.when(approving & (F.col("no") > 0), "rejected"), F.when(approving & F.col("own"), "self approval"),
        F.when((F.col("proposed") == "active") & ~((F.col("starts_at") <= at(t)) & (at(t) < F.col("ends_at"))), "window"),
    ))
    return s.select("session_id", F.explode(problems).alias("problem"))


def shared_replay(citations: DataFrame, snapshots: DataFrame, scopes: DataFrame) -> DataFrame:
    """Cited chunks of shared threads whose readers meet the frozen ones.

    ``citations`` (thread_id, doc_id), ``snapshots`` (thread_id, unit_id),
    ``scopes`` (doc_id, unit_id).
    """
    return citations.join(scopes, "doc_id").join(snapshots, ["thread_id", "unit_id"], "left_semi").select("thread_id", "doc_id").distinct()
