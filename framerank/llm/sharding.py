"""Resharding by minimum-cost flow.

From the bytes that each old shard holds and the bytes that each new shard is to hold, a flow is
solved in which staying costs nothing and moving costs its bytes, so the fewest bytes move. The
blocks that move are groups of rows (equal texts) or single rows. Each old shard's blocks, largest
first, are cut into runs as the flow says: what stays comes first, so the blocks that move and those
at the cuts are the smallest. Further passes over the outcome even out what large blocks at a cut
left. Groups of more than half a shard's bytes are dealt out by rows.

The flow has one node per shard and is solved on the driver from one sum per shard. Running sums
over all blocks are taken in range partitions of about `RANGE_ROWS` blocks: each partition sums its
own, and the driver adds up one total per partition and shard. Slots are numbered the same way over
the input's partitions. No task gets a whole shard, and a group's size is an aggregate with map-side
partials; the join that hands a group's shard to its rows can be split by AQE.

`rewrite` writes only the shards that a plan changes, and a manifest that points to the old files of
the others. op9 writes the old shards with an id for each row, rewrites by that id and takes its columns
from the rows it reads back from the new shards.

Cases: a null text has size 1 (no bytes, plus 1) and the CRC-32 of nothing. Repeated rows are dealt
like any others. A null doc_id doesn't matter. More shards
than rows leaves shards empty. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

SHARDS, RANGE_ROWS, PASSES = 8, 250_000, 3
#: Rows that one task of a rewrite takes, which it writes as a file a shard.
TASK_ROWS = 50_000


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink, of least total cost; sum(supply) <= sum(demand).
    Successive shortest paths with potentials; costs are not negative."""
    n, m = len(supply), len(demand)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    potential = [0] * (n + m)
    while any(left):
        far = [None] * (n + m)
        via = [None] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                far[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            # From a source along every edge; from a sink back along edges that carry flow.
            steps = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                at = d + c + potential[u] - potential[v]
                if far[v] is None or at < far[v]:
                    far[v], via[v] = at, u
                    heapq.heappush(heap, (at, v))
        ends = [j for j in range(m) if room[j] and far[n + j] is not None]
        if not ends:
            raise ValueError("the new shards hold less than the old ones")
        end = min(ends, key=lambda j: (far[n + j] + potential[n + j], j))
        most = max(f for f in far if f is not None)
        for u in range(n + m):
            potential[u] += far[u] if far[u] is not None else most
        path, u = [], n + end
        while via[u] is not None:
            path.append((via[u], u))
            u = via[u]
        units = min([left[u], room[end], *(flow[v][a - n] for a, v in path if a >= n)])
        left[u] -= units
        room[end] -= units
        for a, v in path:
            if a < n:
                flow[a][v - n] += units
            else:
                flow[v][a - n] -= units
    return flow


def capacities(total: int, shards: int) -> list[int]:
    """Equal bytes, the remainder one each to the first."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(old: dict[int, int], shards: int, capacity: list[int] | None = None) -> dict[int, list[tuple[int, int]]]:
    """For each old shard (new shard, bytes), what stays first."""
    names = sorted(old)
    room = capacity or capacities(sum(old.values()), shards)
    flow = min_cost_flow([old[i] for i in names], room, [[int(i != j) for j in range(shards)] for i in names])
    return {i: [(j, flow[k][j]) for j in sorted(range(shards), key=lambda j: (j != i, j)) if flow[k][j]] for k, i in enumerate(names)}


def _offsets(totals: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """From (part, shard, amount): what the same shard has in lower parts."""
    before: dict[int, int] = {}
    out = []
    for part, shard, amount in sorted(totals):
        out.append((part, shard, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + amount
    return out


def _running(parts: DataFrame, shard: str, order: list, amount, out: str) -> DataFrame:
    """Adds the sum of `amount` over all rows of the same shard that come before, by (part, order)."""
    from pyspark.sql import Window

    spark = parts.sparkSession
    # One row per range partition and shard: a few hundred thousand at 100 TB.
    totals = [(r.part, r.s, r.n) for r in parts.groupBy("part", F.col(shard).alias("s")).agg(F.sum(amount).alias("n")).collect()]
    offsets = spark.createDataFrame(_offsets(totals), f"part int, {shard} int, offset long")
    here = F.sum(amount).over(Window.partitionBy("part", shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return parts.join(offsets, ["part", shard]).withColumn(out, F.col("offset") + F.coalesce(here, F.lit(0))).drop("offset")


def _spread(blocks: DataFrame, shards: int, capacity: list[int] | None) -> DataFrame:
    """blocks: key, shard (where it is now), size. The same with the new shard. Each pass moves what the cuts of the
    one before were off, among ever smaller blocks."""
    now = blocks
    for _ in range(PASSES):
        n, held = 0, {}
        for r in now.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect():  # one row a shard
            n, held = n + r.n, held | {r.shard: r.bytes}
        order = [F.col("shard"), F.desc("size"), F.col("key")]
        ranged = C.materialise(now.drop("part").repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).withColumn("part", F.spark_partition_id()), "reshard_ranges")
        placed = _running(ranged, "shard", order[1:], F.col("size"), "before")
        now = C.materialise(placed.withColumn("shard", _cut(transfers(held, shards, capacity))).drop("before"), "reshard_shards")
    return now.drop("part")


def reshard(rows: DataFrame, shards: int = SHARDS, capacity: list[int] | None = None, row: str | None = None) -> DataFrame:
    """rows: any columns, with old (int), size (long) and group (long; rows of a group stay together, null stands
    alone). Adds shard (int) and slot (long, from 0 without gaps in each shard). row: a column that already holds
    monotonically increasing ids, which is kept."""
    kept = C.materialise(rows.withColumn("row", F.col(row) if row else F.monotonically_increasing_id()), "reshard_rows")
    groups = kept.where("group is not null").groupBy("group").agg(F.sum("size").alias("size"))
    least = min(capacity) if capacity else (kept.agg(F.sum("size")).first()[0] or 0) / shards
    # Groups too large for that: at most 2 a shard's bytes, whose rows go their own ways.
    large = [r.group for r in groups.where(F.col("size") > max(1.0, least / 2)).select("group").collect()]
    alone = F.col("group").isNull() | F.col("group").isin(large)
    keyed = kept.withColumn("key", F.when(alone, F.xxhash64("row", F.lit("row"))).otherwise(F.xxhash64("group", F.lit("group"))))
    blocks = C.materialise(keyed.groupBy("key").agg(F.min("old").cast("int").alias("shard"), F.sum("size").alias("size")), "reshard_blocks")
    placed = keyed.join(_spread(blocks, shards, capacity).select("key", "shard"), "key").drop("key")
    # The input's own partitions number the slots.
    sharded = C.materialise(placed.withColumn("part", F.shiftright("row", 33).cast("int")), "reshard_placed")
    return _running(sharded, "shard", [F.col("row")], F.lit(1).cast("long"), "slot").drop("part", *([] if row == "row" else ["row"]))


def _cut(runs: dict[int, list[tuple[int, int]]]):
    """The new shard of a row from the bytes that come before it in its shard: where its middle byte goes."""
    shard = F.lit(None).cast("int")
    for i, own in runs.items():
        end, to = 0, F.lit(own[-1][0])
        ends = []
        for j, units in own:
            end += units
            ends.append((end, j))
        for end, j in reversed(ends[:-1]):
            to = F.when(F.col("before") + F.col("size") / 2 < end, j).otherwise(to)
        shard = F.when(F.col("shard") == i, to).otherwise(shard)
    return shard.cast("int")


def rewrite(data: DataFrame, plan: DataFrame, key: str, current: dict[int, str], folder: str, shards: int = SHARDS) -> dict[int, str]:
    """data: all rows. plan: key, old, shard. key: an id that each row has alone. current: the files of each old
    shard. Writes the shards that gain or lose rows under `folder` and returns the files of each new shard."""
    moved = plan.where("old != shard").select(F.explode(F.array("old", "shard")).alias("s")).distinct().collect()  # at most one row a shard
    dirty = {r.s for r in moved} | {s for s in range(shards) if s not in current}
    if dirty:
        changed = plan.where(F.col("shard").isin(sorted(dirty))).select(key, "shard")
        # Rows meet their plan and are written where they met: they are shuffled once.
        parts = max(1, -(-plan.count() // TASK_ROWS))
        met = data.repartition(parts, key).join(changed.repartition(parts, key), key)
        met.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(folder)
        # A key that is null or stands for several rows would lose or multiply them.
        schema = T.StructType([*data.schema.fields, T.StructField("shard", T.IntegerType())])
        counts = [{r.shard: r["count"] for r in df.groupBy("shard").count().collect()} for df in (changed, data.sparkSession.read.schema(schema).parquet(folder))]
        if counts[0] != counts[1]:
            raise ValueError(f"{key} is not an id of the rows: planned {counts[0]}, written {counts[1]}")
    return {s: f"{folder}/shard={s}" if s in dirty else current[s] for s in range(shards)}


def layout(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, dict[int, str]]:
    """Writes docs as the old shards, plans, and rewrites the shards that change. The rows that were written (row, an
    id; doc, all columns; old), the plan by row, and the files of each new shard that has rows."""
    spark, base = docs.sparkSession, C.fresh_path(docs.sparkSession, "reshard_old")
    group = F.xxhash64(_bytes("text"))
    old = F.pmod(F.shiftright(group, 20), F.lit(shards)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"), old.alias("old"))
    rows.write.option("compression", "zstd").partitionBy("old").parquet(base)
    data = spark.read.schema(rows.schema).parquet(base)
    sizes = data.select("row", _size("doc.text").alias("size"), F.xxhash64(_bytes("doc.text")).alias("group"), "old")
    plan = C.materialise(reshard(sizes, shards, row="row"), "reshard_plan")
    current = {r.old: f"{base}/old={r.old}" for r in plan.select("old").distinct().collect()}
    files = rewrite(data.select("row", "doc"), plan, "row", current, C.fresh_path(spark, "reshard_new"), shards)
    return data, plan, {r.shard: files[r.shard] for r in plan.select("shard").distinct().collect()}


def _bytes(text: str):
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def _size(text: str):
    return (F.octet_length(_bytes(text)) + 1).cast("long")


def digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The columns of op9, by the law `bytes`, of the rows read back from the new shards. The old shards are those of a
    hash of the text, so equal texts start together, and they stay together."""
    data, plan, files = layout(docs, shards)
    kept = data.select("row", "doc")
    parts = [docs.sparkSession.read.schema(kept.schema).parquet(path).withColumn("shard", F.lit(s)) for s, path in sorted(files.items())]
    there = functools.reduce(DataFrame.unionByName, parts) if parts else kept.withColumn("shard", F.lit(0)).limit(0)
    slim = there.select("row", F.col("doc.doc_id").alias("doc_id"), _size("doc.text").alias("size"), F.crc32(_bytes("doc.text")).alias("text_crc32"), "shard")
    found = slim.join(plan.select("row", "slot", "old"), "row")
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))
