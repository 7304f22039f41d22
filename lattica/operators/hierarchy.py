"""Unit trees: closure, moves and traversal.

A tree is (company_id, unit_id, parent_id, ...); its closure has a row for
each unit and each of its ancestors, itself included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.tables import stored


def closure(units: DataFrame) -> DataFrame:
    """(company_id, ancestor, descendant, depth) for trees of any size and depth.

    The known distance doubles in each round: pairs at the greatest distance
    are joined with all pairs known so far. Each round is stored. A cycle is an
    error.
    """
    of = units.select("company_id", "unit_id", "parent_id")
    itself = of.select("company_id", F.col("unit_id").alias("ancestor"), F.col("unit_id").alias("descendant"), F.lit(0).alias("depth"))
    links = of.where("parent_id is not null").select("company_id", F.col("parent_id").alias("ancestor"), F.col("unit_id").alias("descendant"), F.lit(1).alias("depth"))
    up = stored(links, "up")
    most, reach = up.count(), 1
    while True:
        far = up.where(F.col("depth") == reach).select("company_id", F.col("ancestor").alias("middle"), "descendant")
        near = up.select("company_id", "ancestor", F.col("descendant").alias("middle"), "depth")
        new = stored(far.join(near, ["company_id", "middle"]).select("company_id", "ancestor", "descendant", (F.col("depth") + reach).alias("depth")), "up")
        if new.isEmpty():
            return itself.union(up)
        if reach > most:
            raise ValueError("the units hold a cycle")
        up, reach = up.union(new), 2 * reach


class MoveError(ValueError):
    """A move that would break the tree."""


def move_unit(units: DataFrame, company: int, node: int, parent: int) -> DataFrame:
    """``units`` with ``node`` under ``parent``; its subtree goes with it.

    Roots stay, and a unit can't go below itself or into another company.
    """
    of = units.where((F.col("company_id") == company) & F.col("unit_id").isin(node, parent))
    found = {r.unit_id: r.parent_id for r in of.select("unit_id", "parent_id").collect()}  # two rows at most
    if node not in found or parent not in found:
        raise MoveError("both units must be in the company")
    if found[node] is None:
        raise MoveError("a root can't move")
    below = closure(units).where((F.col("company_id") == company) & (F.col("ancestor") == node) & (F.col("descendant") == parent))
    if not below.isEmpty():
        raise MoveError("the new parent lies below the unit")
    here = (F.col("company_id") == company) & (F.col("unit_id") == node)
    return units.withColumn("parent_id", F.when(here, F.lit(parent).cast("long")).otherwise(F.col("parent_id")))


def relink(tree: DataFrame, company: int, node: int, parent: int) -> DataFrame:
    """The closure after a move, from the closure alone: cut the subtree's outer links, add new ones."""
    mine = tree.where(F.col("company_id") == company)
    subtree = mine.where(F.col("ancestor") == node).select("company_id", "descendant", F.col("depth").alias("down"))
    inside = subtree.select("company_id", F.col("descendant").alias("ancestor"))
    outer = tree.join(subtree.select("company_id", "descendant"), ["company_id", "descendant"], "left_semi").join(inside, ["company_id", "ancestor"], "left_anti")
    kept = tree.join(outer, ["company_id", "ancestor", "descendant"], "left_anti").select("company_id", "ancestor", "descendant", "depth")
    above = mine.where(F.col("descendant") == parent).select("company_id", "ancestor", F.col("depth").alias("up"))
    new = above.join(subtree, "company_id").select("company_id", "ancestor", "descendant", (F.col("up") + F.col("down") + 1).alias("depth"))
    return kept.unionByName(new)


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """Descendants, itself included, of each (company_id, unit_id) of ``of``."""
    return of.join(tree, (of.company_id == tree.company_id) & (of.unit_id == tree.ancestor)).select(of.company_id, of.unit_id, "descendant", "depth")


def forest(units: DataFrame, scope: DataFrame, user: int) -> DataFrame:
    """The units a user sees, with ``is_root`` where the parent isn't seen."""
    seen = units.join(scope.where(F.col("user_id") == user).select("company_id", "unit_id").distinct(), ["company_id", "unit_id"], "left_semi")
    parents = seen.select("company_id", F.col("unit_id").alias("parent_id"), F.lit(True).alias("parent_seen"))
    out = seen.join(parents, ["company_id", "parent_id"], "left")
    return out.select("company_id", "unit_id", "parent_id", "name", F.col("parent_seen").isNull().alias("is_root"))


#: How many units a tenant's tree may have, and how deep a forest may be.
MOST_UNITS, MOST_DEPTH = 10_000, 64


def charts(units: DataFrame, seen: DataFrame) -> DataFrame:
    """(company_id, user_id, pos, unit_id, depth, error): each reader's forest, in order from the root down.

    ``seen`` (company_id, user_id, unit_id). A unit is a root where its parent
    isn't seen; siblings come by name and id, and each unit right behind its
    parent and that one's earlier children. A tenant of more than
    ``MOST_UNITS`` units, or a forest deeper than ``MOST_DEPTH``, is refused as
    a whole: one row with the ``error``.

    Each unit points to its parent; in each round a pointer skips to where its
    target points and the unit's sort key grows by the target's, so a forest of
    depth d takes log2(d) rounds. The order is that of the keys.
    """
    reader = ["company_id", "user_id"]
    size = units.groupBy("company_id").agg(F.count("*").alias("_n"))
    mine = seen.select(*reader, "unit_id").distinct().join(size, "company_id")
    large = mine.where(F.col("_n") > MOST_UNITS).select(*reader).distinct().withColumn("error", F.lit("too large"))
    named = mine.where(F.col("_n") <= MOST_UNITS).drop("_n").join(units.select("company_id", "unit_id", "parent_id", "name"), ["company_id", "unit_id"])
    parents = named.select(*reader, F.col("unit_id").alias("parent_id"), F.lit(True).alias("_seen"))
    at = named.join(parents, [*reader, "parent_id"], "left")
    at = at.select(*reader, "unit_id", F.when(F.col("_seen"), F.col("parent_id")).alias("to"), F.array(F.struct("name", "unit_id")).alias("path"))
    at = stored(at, "charts")
    for _ in range(MOST_DEPTH.bit_length()):
        if at.where("to is not null").isEmpty():
            break
        skip = at.select(*reader, F.col("unit_id").alias("to"), F.col("to").alias("_to"), F.col("path").alias("_path"))
        longer = at.where("to is not null").join(skip, [*reader, "to"]).select(*reader, "unit_id", F.col("_to").alias("to"), F.concat("_path", "path").alias("path"))
        at = stored(at.where("to is null").union(longer), "charts")
    # Keys that reach no root yet are longer than any that is allowed.
    deep = at.where(F.col("to").isNotNull() | (F.size("path") > MOST_DEPTH + 1)).select(*reader).distinct().withColumn("error", F.lit("too deep"))
    good = at.join(deep, reader, "left_anti")
    pos = F.row_number().over(Window.partitionBy(*reader).orderBy("path")) - 1
    none = F.lit(None)
    rows = good.select(*reader, pos.alias("pos"), "unit_id", (F.size("path") - 1).alias("depth"), none.cast("string").alias("error"))
    refused = large.union(deep).select(*reader, F.lit(0).alias("pos"), none.cast("long").alias("unit_id"), none.cast("int").alias("depth"), "error")
    return rows.union(refused)


def reply_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, depth, path) of conversation trees (conv_id, turn, parent_turn).

    Each turn points to its parent; in each round a pointer skips to where its
    target points, and the path grows by the target's. So a conversation of n
    turns takes log2(n) rounds, each stored. Turns that no root reaches are
    left out.
    """
    at = turns.select("conv_id", "turn", F.col("parent_turn").alias("to"), F.when(F.col("parent_turn").isNull(), 0).otherwise(1).alias("depth"), F.col("turn").cast("string").alias("path"))
    at = stored(at, "paths")
    rounds = at.count().bit_length() + 1  # more only on a cycle
    while rounds and not at.where(F.col("to").isNotNull()).isEmpty():
        whole = at.where("to is null")
        skip = at.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        longer = at.where("to is not null").join(skip, ["conv_id", "to"])
        longer = longer.select("conv_id", "turn", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat("_path", F.lit("/"), "path").alias("path"))
        at, rounds = stored(whole.union(longer), "paths"), rounds - 1
    return at.where("to is null").select("conv_id", "turn", "depth", "path")
