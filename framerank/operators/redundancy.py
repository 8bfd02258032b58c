"""Near-duplicate reduction: leader clustering by similarity, temporal gap clustering, best of each cluster."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framerank.session import shared_folder

#: Vectors compared to a leader at once, which bounds what a task computes with.
BLOCK = 65_536


def leaders_cosine(x: np.ndarray, threshold: float) -> np.ndarray:
    """Index of each row's leader. In input order the first free row leads; every row still free whose cosine to
    the leader reaches the threshold joins it. Not transitive."""
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    leader = np.full(len(x), -1)
    for i in range(len(x)):
        if leader[i] >= 0:
            continue
        leader[i] = i
        for a in range(i + 1, len(x), BLOCK):
            free = a + np.flatnonzero(leader[a : a + BLOCK] < 0)
            near = free[x[free] @ x[i] / (size[free] * size[i] + 1e-8) >= threshold]
            leader[near] = i
    return leader


def leaders_hamming(bits: np.ndarray, most: int) -> np.ndarray:
    """The same for rows of unsigned 64-bit words and at most `most` differing bits."""
    leader = np.full(len(bits), -1)
    for i in range(len(bits)):
        if leader[i] >= 0:
            continue
        leader[i] = i
        free = i + 1 + np.flatnonzero(leader[i + 1 :] < 0)
        leader[free[np.bitwise_count(bits[free] ^ bits[i]).sum(axis=1) <= most]] = i
    return leader


#: Features that rows are compared by.
KINDS = ("clip", "histogram", "phash")


def _words_of(x: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Perceptual hashes as unsigned words, and the bits in which like ones may differ."""
    return x.astype(np.int64).view(np.uint64), int(64 * x.shape[1] * (1 - threshold) + 1e-9)


def _leaders(x: np.ndarray, kind: str, threshold: float) -> np.ndarray:
    return leaders_hamming(*_words_of(x, threshold)) if kind == "phash" else leaders_cosine(x, threshold)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def leader_clusters(items: DataFrame, group: str, order: str, feature: str, threshold: float, kind: str = "clip") -> DataFrame:
    """Adds leader (the `order` value of the row's leader) to (group, order, feature). kind: `clip` and `histogram`
    compare by cosine, `phash` (arrays of 64-bit words) by int(bits x (1 - threshold)) differing bits. One group is
    one task's work: groups are segments. long_leader_clusters() is for those that are too long for it."""
    if kind not in KINDS:
        raise ValueError(f"unknown feature {kind!r}")

    def clustered(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        found = _leaders(_rows(table[feature]), kind, threshold)
        return table.drop_columns([feature]).append_column("leader", table[order].take(pa.array(found)))

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    return items.select(group, order, feature).groupBy(group).applyInArrow(clustered, f"{group} {kinds[group]}, {order} {kinds[order]}, leader {kinds[order]}")


def _written(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _joined(x: np.ndarray, heads: np.ndarray, kind: str, threshold: float) -> np.ndarray:
    """For each row the first of the heads that it is near enough to, -1 if there is none."""
    first = np.full(len(x), -1)
    if kind == "phash":
        (x, most), (heads, _) = _words_of(x, threshold), _words_of(heads, threshold)
    else:
        x, heads = x.astype(np.float64), heads.astype(np.float64)
        size, lengths = np.linalg.norm(x, axis=1), np.linalg.norm(heads, axis=1)
    for k, head in enumerate(heads):
        free = np.flatnonzero(first < 0)
        if not len(free):
            break
        if kind == "phash":
            near = np.bitwise_count(x[free] ^ head).sum(axis=1) <= most
        else:
            near = x[free] @ head / (size[free] * lengths[k] + 1e-8) >= threshold
        first[free[near]] = k
    return first


def long_leader_clusters(items: DataFrame, group: str, order: str, feature: str, threshold: float, kind: str = "clip", batch: int = 20_000) -> DataFrame:
    """leader_clusters() for groups of any size, with the same result: no task holds more than two times `batch` rows.
    In rounds, the first `batch` free rows of each group are clustered, and the rest, in parts of that size, joins the first
    of the new leaders that is near enough or stays free. Rounds are written to the shared folder, and end with the
    free rows; a group whose rows are all unlike each other takes a round for every `batch` of them. `order` is unique
    within a group."""
    if kind not in KINDS:
        raise ValueError(f"unknown feature {kind!r}")
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    base = f"{group} {kinds[group]}, {order} {kinds[order]}, leader {kinds[order]}, {feature} {kinds[feature]}"

    def clustered(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        found = _leaders(_rows(table[feature]), kind, threshold)
        # Only a leader's feature is needed again.
        kept = table[feature].take(pa.array(found, mask=found != np.arange(len(found))))
        return pa.table({group: table[group], order: table[order], "leader": table[order].take(pa.array(found)), feature: kept})

    def settled(rows: pa.Table, heads: pa.Table) -> pa.Table:
        heads = heads.sort_by("leader")
        first = _joined(_rows(rows[feature]), _rows(heads[feature]), kind, threshold) if len(rows) else np.empty(0, int)
        return pa.table({group: rows[group], order: rows[order], "leader": heads["leader"].take(pa.array(first, mask=first < 0)), feature: rows[feature]})

    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    free, done = items.select(group, order, feature), []
    while True:
        placed = _written(free.withColumn("__part", F.floor((place - 1) / batch)))
        found = _written(placed.where("__part = 0").drop("__part").groupBy(group).applyInArrow(clustered, base))
        done.append(found.select(group, order, "leader"))
        rest = placed.where("__part > 0")
        if not rest.limit(1).count():
            break
        heads = found.where(F.col(order) == F.col("leader")).select(group, "leader", feature).alias("h")
        parts = rest.groupBy(group).agg(F.max("__part").alias("__last")).withColumnRenamed(group, "__group")
        spread = heads.join(parts, F.col(f"h.{group}").eqNullSafe(F.col("__group"))).select("h.*", F.explode(F.sequence(F.lit(1).cast("long"), "__last")).alias("__part"))
        after = _written(rest.groupBy(group, "__part").cogroup(spread.groupBy(group, "__part")).applyInArrow(settled, base))
        done.append(after.where("leader is not null").select(group, order, "leader"))
        free = after.where("leader is null").select(group, order, feature)
    return reduce(DataFrame.unionByName, done)


def temporal_clusters(items: DataFrame, group: Sequence[str], index: str, gap: float, ties: Sequence[str] = (), out: str = "cluster") -> DataFrame:
    """Adds a cluster number: a row starts a new cluster if it is at least `gap` after the one before it. (A session
    window would join rows exactly `gap` apart.)"""
    by = Window.partitionBy(*group).orderBy(index, *ties)
    new = F.when(F.col(index) - F.lag(index).over(by) < gap, 0).otherwise(1)
    return items.withColumn(out, F.sum(new).over(by))


def best_of(clusters: DataFrame, keys: Sequence[str], score: str, order: Sequence[str], top_k: int = 1) -> DataFrame:
    """Adds cluster_size and selected: the top_k (at least 1) by score, a missing score being 0, ties by order."""
    by = Window.partitionBy(*keys)
    rank = F.row_number().over(by.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), *order))
    return clusters.withColumns({"cluster_size": F.count("*").over(by), "selected": rank <= max(1, int(top_k))})


def cluster_log(selected: DataFrame, stage: str, keys: Sequence[str], path: str, score: str, segment: str) -> DataFrame:
    """Membership of every row, as a table of its own."""
    return selected.select(
        F.concat_ws("_", F.lit(stage), *(F.col(k).cast("string") for k in keys)).alias("cluster_id"), F.lit(stage).alias("stage"), F.col(path).cast("string").alias("path"),
        F.coalesce(F.col(score), F.lit(0.0)).alias("score"), "selected", F.col("cluster_size").cast("int").alias("cluster_size"), F.col(segment).alias("segment_id"),
    )


def visual(items: DataFrame, group: str, order: str, feature: str, score: str | None, threshold: float = 0.92, kind: str = "histogram", top_k: int = 1) -> DataFrame:
    """All items with leader, cluster_size and selected. Scores count only for the `clip` feature; otherwise the first of a cluster stays."""
    found = leader_clusters(items, group, order, feature, threshold, kind)
    rows = items.join(found, [group, order])
    value = score if kind == "clip" and score else "__zero"
    return best_of(rows.withColumn("__zero", F.lit(0.0)), [group, "leader"], value, [order], top_k).drop("__zero")


def temporal(items: DataFrame, group: str, index: str, order: str, score: str, gap: float = 24, top_k: int = 1) -> DataFrame:
    return best_of(temporal_clusters(items, [group], index, gap, [order]), [group, "cluster"], score, [order], top_k)


def hybrid(items: DataFrame, group: str, index: str, order: str, feature: str, score: str, gap: float = 12, threshold: float = 0.90, kind: str = "clip", top_k: int = 1) -> DataFrame:
    """Survivors of leader clustering, then of temporal clustering among them."""
    first = visual(items, group, order, feature, score, threshold, kind, top_k).where("selected").select(*items.columns)
    value = score if kind == "clip" else "__zero"
    second = temporal(first.withColumn("__zero", F.lit(0.0)), group, index, order, value, gap, top_k)
    return second.where("selected").select(*items.columns)


def reduce_redundancy(method: str, items: DataFrame, **how) -> DataFrame:
    """Survivors by method `visual`, `temporal` or `hybrid`."""
    if method == "hybrid":
        return hybrid(items, **how)
    if method not in ("visual", "temporal"):
        raise ValueError(f"unknown method {method!r}")
    return {"visual": visual, "temporal": temporal}[method](items, **how).where("selected").select(*items.columns)


def sizes(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of clusters, and their smallest, largest and mean size."""
    n = clusters.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.avg("n").alias("mean"))
