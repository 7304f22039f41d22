"""Resharding by minimum-cost flow.

From the bytes that each old shard holds and the capacities of the new shards a
transport problem is solved: keeping a byte costs nothing, moving it costs one
(or what ``cost`` says), so the flow found moves the fewest bytes. Rows are
grouped into blocks (old shard, size class, part); blocks lie in order of
falling row size, so each shard keeps its large rows, whole blocks of small
rows travel, and only a block that lies across a border is cut between rows.

Only numbers per shard and size class reach the driver (at most shards x
``CLASSES`` rows, whatever the input); numbers per block stay in Spark. A block
has about ``rows_per_block`` rows, so no window sees a whole shard.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

#: Eight size classes to a doubling; sizes up to 2**48 bytes.
CLASSES = 8 * 48


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard at the least total cost.

    Successive shortest paths with queue-based Bellman-Ford. ``cost(i, j)`` is
    the price of one byte. Capacities must hold the supply.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    to, left, price, out = [], [], [], [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, units: int, at: int) -> None:
        for x, y, u, c in ((a, b, units, at), (b, a, 0, -at)):
            out[x].append(len(to))
            to.append(y)
            left.append(u)
            price.append(c)

    for i, units in enumerate(supply):
        edge(source, i, units, 0)
    for j, units in enumerate(capacity):
        edge(n + j, sink, units, 0)
    arcs = {}
    for i in range(n):
        for j in range(m):
            arcs[i, j] = len(to)
            edge(i, n + j, supply[i], cost(i, j))
    while True:
        far, by, queue, queued = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                if left[e] > 0 and far[a] + price[e] < far.get(to[e], math.inf):
                    far[to[e]] = far[a] + price[e]
                    by[to[e]] = e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if sink not in far:
            break
        path, at = [], sink
        while at != source:
            path.append(by[at])
            at = to[by[at] ^ 1]
        units = min(left[e] for e in path)
        for e in path:
            left[e] -= units
            left[e ^ 1] += units
    return {k: left[e ^ 1] for k, e in arcs.items() if left[e ^ 1] > 0}


def flow_step(layout: DataFrame, capacity: list[int], cost=None, rows_per_block: int = 50_000) -> DataFrame:
    """One solve and move.

    ``layout`` has ``_row`` (unique), ``shard`` and ``size``; the result has
    the same rows with new ``shard`` and with ``slot``, gapless from 0 in each
    shard.
    """
    spark = layout.sparkSession
    cost = cost or (lambda i, j: int(i != j))
    size = F.greatest(F.col("size"), F.lit(1))
    layout = layout.withColumn("_class", F.least(F.lit(CLASSES), F.floor(8 * F.log2(size))).cast("int"))
    # Bounded by shards x CLASSES, so it may come to the driver.
    groups = layout.groupBy("shard", "_class").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    n_old = max([r.shard for r in groups], default=-1) + 1
    supply = [0] * n_old
    for r in groups:
        supply[r.shard] += r.bytes
    flow = min_cost_flow(supply, capacity, cost)
    borders = []
    for i in range(n_old):
        at = 0
        order = sorted((j != i, j) for (a, j) in flow if a == i)
        if not order:
            # No byte flows from it; rows without bytes stay, or go to the last shard if theirs is gone.
            borders.append((i, at, 2**62, min(i, len(capacity) - 1)))
        for k, (_, j) in enumerate(order):
            last = k == len(order) - 1
            borders.append((i, at, 2**62 if last else at + flow[i, j], j))
            at += flow[i, j]
    parts = [(r.shard, r._class, max(1, -(-r.rows // rows_per_block))) for r in groups]
    parts = spark.createDataFrame(parts, "shard int, _class int, _parts long")
    borders = spark.createDataFrame(borders, "shard int, _lo long, _hi long, _to int")
    # Both small sides are bounded by the numbers of shards and classes.
    rows = layout.join(F.broadcast(parts), ["shard", "_class"])
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")).drop("_parts")
    block = ["shard", "_class", "_part"]
    in_shard = Window.partitionBy("shard").orderBy(F.desc("_class"), "_part")
    sizes = rows.groupBy(*block).agg(F.sum("size").alias("_bytes"))
    sizes = sizes.withColumn("_start", F.sum("_bytes").over(in_shard) - F.col("_bytes")).drop("_bytes")
    in_block = Window.partitionBy(*block).orderBy(F.desc("size"), "_row")
    rows = rows.join(sizes, block)
    middle = F.col("_start") + F.sum("size").over(in_block) - F.floor(F.col("size") / 2)
    rows = rows.withColumn("_at", middle)
    rows = rows.join(F.broadcast(borders), (rows.shard == borders.shard) & (F.col("_at") >= F.col("_lo")) & (F.col("_at") < F.col("_hi"))).drop(borders.shard)
    # Slots: numbers of rows per (new shard, block) give each block its start.
    moved = ["_to", *block]
    starts = rows.groupBy(*moved).agg(F.count("*").alias("_rows"))
    starts = starts.withColumn("_first", F.sum("_rows").over(Window.partitionBy("_to").orderBy("shard", F.desc("_class"), "_part")) - F.col("_rows")).drop("_rows")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*moved).orderBy(F.desc("size"), "_row")) - 1)
    rows = rows.join(starts, moved).withColumn("slot", (F.col("_first") + F.col("_n")).cast("long"))
    kept = [c for c in layout.columns if c not in ("shard", "slot", "_class")]
    return rows.select(*kept, F.col("_to").alias("shard"), "slot")


def reshard(df: DataFrame, old_shard, size, capacity_shares: list[float] | int, steps: int = 3, rows_per_block: int = 50_000) -> DataFrame:
    """Lay ``df`` out anew; adds ``old_shard``, ``size``, ``shard``, ``slot`` and ``least_moved``.

    ``old_shard`` and ``size`` are columns; ``capacity_shares`` is a number of
    equal shards, or the share of each. The first step moves what the flow
    says; the next ones even out what cutting between whole rows left over, at
    the price of a few small rows. So a little more moves than the cost of the
    first flow, which every row has as ``least_moved``. Rows whose old shard is null count as shard
    0 and null sizes as 0; equal rows are placed one by one; an empty input
    gives an empty result. Columns of ``df`` named like the added ones are
    replaced.
    """
    taken = {"old_shard", "size", "shard", "slot", "least_moved", "_row", "_class", "_part", "_start", "_at", "_to", "_first", "_n"}
    kept = [c for c in df.columns if c not in taken]
    rows = df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("size"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = stored(rows.withColumn("shard", F.col("old_shard")), "layout")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shares = [1 / capacity_shares] * capacity_shares if isinstance(capacity_shares, int) else capacity_shares
    bounds = [round(total * sum(shares[: j + 1]) / sum(shares)) for j in range(len(shares))]
    capacity = [b - a for a, b in zip([0, *bounds], bounds)]
    held: dict[int, int] = {r.shard: r.bytes for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row for each old shard
    supply = [held.get(k, 0) for k in range(max(held, default=-1) + 1)]
    least = sum(u for (i, j), u in min_cost_flow(supply, capacity, lambda i, j: int(i != j)).items() if i != j)
    for step in range(steps):
        rows = flow_step(rows.drop("slot"), capacity, rows_per_block=rows_per_block)
        if step < steps - 1:
            rows = stored(rows, "layout")
    return rows.drop("_row").withColumn("least_moved", F.lit(least).cast("long"))


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and its kind of path."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def publish(spark: SparkSession, path: str, layout: dict[int, str]) -> None:
    """Make ``layout`` (the folder below ``path`` of each shard) the current one, by one rename."""
    fs, kind = _files(spark, path)
    name = f"{path}/_layout-{len(markers(spark, path)):06d}.json"
    draft = kind(f"{path}/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps({str(k): v for k, v in sorted(layout.items())}).encode()))
    out.close()
    if not fs.rename(draft, kind(name)):
        raise OSError(f"{name} is there already")


def markers(spark: SparkSession, path: str) -> list[str]:
    fs, kind = _files(spark, path)
    if not fs.exists(kind(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(kind(path))]
    return sorted(n for n in names if n.startswith("_layout-"))


def current(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each shard, from the last marker."""
    found = markers(spark, path)
    if not found:
        return {}
    fs, kind = _files(spark, path)
    stream = fs.open(kind(f"{path}/{found[-1]}"))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return {int(k): v for k, v in json.loads(text).items()}


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the current layout of the data set at ``path``; ``schema`` has ``shard``."""
    folders = [f"{path}/{v}" for v in current(spark, path).values()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def write(df: DataFrame, path: str) -> dict[int, str]:
    """Write ``df`` in folders by ``shard`` that no layout names yet; returns them."""
    spark = df.sparkSession
    made = f"made={uuid.uuid4().hex}"
    df.write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/{made}")
    fs, kind = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(kind(f"{path}/{made}"))]
    return {int(n.removeprefix("shard=")): f"{made}/{n}" for n in names if n.startswith("shard=")}


def rewrite_affected(before: DataFrame, after: DataFrame, path: str, key: str = "doc_id") -> list[int]:
    """Rewrite only the shards whose rows changed; returns them.

    ``before`` and ``after`` hold the same rows with ``shard``, ``slot`` and a
    column ``key``; the data set at ``path`` has been written by ``write`` and
    ``publish``. Shards that gain or lose a row, or a slot of which changes,
    are written anew beside the old ones; then one rename makes the new layout
    the current one, and the old files of these shards go. Until that rename
    readers see the old layout, whole. Files of other shards stay. Null and
    repeated keys count as often as they are there. ``after`` may be read from
    ``path``.
    """
    spark = after.sparkSession
    place = ["shard", "slot", key]
    both = before.select(*place, F.lit(1).alias("_n")).unionByName(after.select(*place, F.lit(-1).alias("_n")))
    changed = both.groupBy(*place).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    # At most as many rows as there are shards.
    ids = sorted(r[0] for r in changed.select("shard").distinct().collect())
    if ids:
        old = current(spark, path)
        new = write(after.where(F.col("shard").isin(ids)), path)
        publish(spark, path, {k: v for k, v in old.items() if k not in ids} | new)
        fs, kind = _files(spark, path)
        for shard in ids:
            if shard in old:
                fs.delete(kind(f"{path}/{old[shard]}"), True)
    return ids


def lay_out_anew(df: DataFrame, old_shard, size, capacity_shares: list[float] | int, path: str) -> DataFrame:
    """``df`` as a data set of old shards at ``path``, moved to the new ones there and read back.

    Adds ``shard``, ``slot`` and ``least_moved``, the bytes that any move to
    these capacities has to move; arguments as for ``reshard``. Rows are known
    by a number of their own (``_id``), so null and repeated ids are safe.
    Each writing task has a file in each shard that it has rows of; texts are
    shuffled once, where they meet their new places.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot", "_id", "least_moved")]
    old = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(old_shard.cast("int"), F.lit(0)).alias("shard"), F.monotonically_increasing_id().alias("_id"), F.lit(None).cast("long").alias("slot"))
    publish(spark, path, write(old, path))
    before = read(spark, path, old.schema)
    plan = reshard(before.select("_id", F.col("shard").alias("_old"), size.alias("_size")), F.col("_old"), F.col("_size"), capacity_shares)
    plan = stored(plan.select("_id", "shard", "slot", "least_moved"), "places")
    # Places grow with the rows, so they are never sent to all tasks.
    after = before.drop("shard", "slot").join(plan.drop("least_moved").hint("merge"), "_id")
    rewrite_affected(before, after, path, "_id")
    least = plan.agg(F.max("least_moved")).first()[0]
    return read(spark, path, old.schema).drop("_id").withColumn("least_moved", F.lit(least).cast("long"))
