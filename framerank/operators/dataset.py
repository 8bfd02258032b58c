"""Building a balanced, group-disjoint training set from annotations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.config import SAMPLE_FACTOR
from framerank.functions import scalars as S
from framerank.operators.redundancy import _rows
from framerank.operators.segments import number

TAIL = 60.0


def annotations(raw: DataFrame) -> DataFrame:
    """(half, seconds, label) of rows with an array of annotations; incomplete and malformed ones are left out."""
    a = raw.select("*", F.explode("annotations").alias("a"))
    label = F.trim(F.coalesce(F.nullif(F.col("a.label"), F.lit("")), F.lit("unknown")))
    out = a.withColumns({"half": S.half_of("a.gameTime"), "seconds": S.millis_to_seconds("a.position"), "label": label})
    return out.where("half is not null and seconds is not null").drop("annotations", "a")


def shots(cuts: DataFrame, keys: Sequence[str], time: str, label: str, ties: Sequence[str] = ()) -> DataFrame:
    """Intervals (keys, start, end, label): an annotation closes a shot that began at the one before it, the first at
    0; the last also opens one of 60 s. Intervals without length are left out. One sort by key."""
    by = Window.partitionBy(*keys).orderBy(time, *ties)
    t = F.col(time).cast("double")
    closed = F.struct(F.coalesce(F.lag(t).over(by), F.lit(0.0)).alias("start"), t.alias("end"))
    tail = F.when(F.lead(t).over(by).isNull(), F.struct(t.alias("start"), (t + TAIL).alias("end")))
    both = cuts.withColumn("__shots", F.filter(F.array(closed, tail), lambda s: s.isNotNull() & (s["end"] > s["start"])))
    return both.select(*keys, F.explode("__shots").alias("s"), F.col(label).alias("label")).select(*keys, "s.start", "s.end", "label")


def factors(table: Mapping[str, float] = SAMPLE_FACTOR, label: str = "label") -> Column:
    """A label's sampling factor, 1 for any other."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(label)), F.lit(1.0))


def sample_frames(intervals: DataFrame, fps: str, duration: str, factor: Column | None = None) -> DataFrame:
    """One row per distinct frame to sample (frame_idx) of intervals clamped to the video, and the middle frame."""
    start, end = (F.least(F.greatest(F.lit(0.0), F.col(c)), F.col(duration)) for c in ("start", "end"))
    rows = intervals.withColumns({"start": start, "end": end}).where("end > start")
    times = F.filter(S.sample_times("start", "end", F.lit(1.0) if factor is None else factor), lambda t: (t >= 0) & (t < F.col(duration)))
    frames = F.array_distinct(F.transform(times, lambda t: (t * F.col(fps)).cast("bigint")))
    return rows.withColumn("middle", ((F.col("start") + F.col("end")) / 2 * F.col(fps)).cast("bigint")).withColumn("frame_idx", F.explode(frames))


def hash_order(key: Column | str, seed: int = 42) -> Column:
    """A repeatable shuffle: rows in the order of a hash of seed and key, in place of a seeded permutation, which would
    need all keys in one place. Any engine with MD5 gives the same order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


#: Candidates of a group that one round of dedup looks at.
ROUND = 20_000


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return _rows(column).astype(np.int64).view(np.uint64)


def _apart(x: np.ndarray, most: int, target: int | None) -> list[int]:
    """Positions kept, in order: each differs from every kept one before it in more than `most` bits."""
    free = np.ones(len(x), bool)
    taken: list[int] = []
    while free.any() and (target is None or len(taken) < target):
        i = int(np.argmax(free))
        taken.append(i)
        free[: i + 1] = False
        rest = np.flatnonzero(free)
        free[rest[np.bitwise_count(x[rest] ^ x[i]).sum(axis=1) <= most]] = False
    return taken


def _far_from(kept: dict[object, np.ndarray], most: int):
    """Whether words differ from all that their group has kept."""

    @F.arrow_udf(T.BooleanType())
    def far(groups: pa.Array, bits: pa.Array) -> pa.Array:
        x = bits.flatten().to_numpy(zero_copy_only=False).reshape(len(groups), -1).astype(np.int64).view(np.uint64) if len(groups) else np.empty((0, 1), np.uint64)
        out = np.ones(len(x), bool)
        names = groups.to_pylist()
        for g in set(names) & set(kept):
            at = np.flatnonzero([n == g for n in names])
            for words in kept[g]:
                at = at[np.bitwise_count(x[at] ^ words).sum(axis=1) > most]
            mine = np.zeros(len(x), bool)
            mine[at] = True
            out &= mine | np.array([n != g for n in names])
        return pa.array(out)

    return far


def hamming_dedup(items: DataFrame, group: str, order: Sequence[str], key: str, bits: str, most: int = 5, target: int | None = 1437) -> DataFrame:
    """(group, key, kept_rank) of rows kept per group: in order, a row is kept if it differs from every kept one in more
    than `most` bits (arrays of 64-bit words), until `target` are kept. Copies of the same words fall to the first in
    an aggregate with map-side partials. With a target the rest goes in rounds: a task sees the first ROUND of a
    group's rows that are still far from everything kept, so no task and no row list grows with the group; what
    comes back, and meets the rows again, is at most `target` words a group. Without one a group is one task's work."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    marks = [f"__o{i}" for i in range(len(order))]
    place = F.struct(*(F.expr(o).alias(m) for o, m in zip(order, marks)), F.col(key).alias("__key"))
    rows = items.groupBy(group, bits).agg(F.min(place).alias("__p")).select(group, bits, "__p")

    def chosen(limit: dict[object, int] | None):
        def pick(table: pa.Table) -> pa.Table:
            table = table.append_column("__n", pa.array(np.arange(len(table)))) if "__n" not in table.column_names else table.sort_by("__n")
            most_of = None if limit is None else limit.get(table[group][0].as_py(), target)
            found = _apart(_words(table[bits]), most, most_of)
            out = table.take(pa.array(found, pa.int64()))
            return pa.table({group: out[group], key: out["__key"], bits: out[bits], "kept_rank": pa.array(np.arange(1, len(found) + 1, dtype=np.int32)), "seen": pa.array([len(table)] * len(found), pa.int64())})

        return pick

    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, {bits} {kinds[bits]}, kept_rank int, seen long"
    first = Window.partitionBy(group).orderBy("__p")
    numbered = lambda df: df.withColumn("__n", F.row_number().over(first)).withColumn("__key", F.col("__p.__key")).drop("__p")
    if target is None:
        return numbered(rows).groupBy(group).applyInArrow(chosen(None), schema).select(group, key, "kept_rank")
    rows = rows.persist()
    kept: dict[object, list[tuple]] = {}
    closed: set = set()
    while True:
        rest = rows
        if kept:
            words = {g: np.array([r[1] for r in own], np.int64).view(np.uint64) for g, own in kept.items() if g not in closed}
            done = [g for g in closed if g is not None]
            rest = rest.where(F.coalesce(~F.col(group).isin(done), F.lit(None not in closed))) if closed else rest
            rest = rest.where(_far_from(words, most)(group, bits))
        batch = numbered(rest).where(F.col("__n") <= ROUND)
        found = batch.groupBy(group).applyInArrow(chosen({g: target - len(own) for g, own in kept.items()}), schema).collect()
        for r in sorted(found, key=lambda r: r["kept_rank"]):
            kept.setdefault(r[group], []).append((r[key], r[bits]))
        seen = {r[group]: r["seen"] for r in found}
        closed |= {g for g, own in kept.items() if len(own) >= target or seen.get(g, 0) < ROUND}
        if set(kept) <= closed:
            break
    rows.unpersist()
    return items.sparkSession.createDataFrame([(g, k, n) for g, own in kept.items() for n, (k, _) in enumerate(own, 1)], f"{group} {kinds[group]}, {key} {kinds[key]}, kept_rank int")


# Counts ---------------------------------------------------------------------------------------


def label_counts(rows: DataFrame, *by: str, label: str = "label") -> DataFrame:
    return rows.groupBy(*by, label).agg(F.count("*").alias("n"))


def label_counts_both(rows: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Counts by label, and by (group, label), in one pass; group is null in the rows of the first kind (level 1)."""
    return rows.groupingSets([[label], [group, label]], group, label).agg(F.count("*").alias("n"), (F.grouping_id() > 0).cast("int").alias("level"))


def zero_filled(rows: DataFrame, domain: Sequence[str], label: str = "label") -> DataFrame:
    """Counts of every label of the domain, 0 for absent ones."""
    spark = rows.sparkSession
    labels = spark.createDataFrame([(d,) for d in domain], f"{label} string")
    return F.broadcast(labels).join(label_counts(rows, label=label), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def top_groups(rows: DataFrame, group: str, label: str = "label", most: int = 5) -> DataFrame:
    """The groups with the most rows per label, ties by group: (label, group, n, rank)."""
    counts = label_counts(rows, group, label=label)
    by = Window.partitionBy(label).orderBy(F.desc("n"), group)
    return counts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


# Splits ---------------------------------------------------------------------------------------


def group_split(rows: DataFrame, group: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds is_test: the ceil(share x groups) groups that come first in the shuffle. Groups never straddle. Only the
    distinct groups are ranked."""
    groups = rows.select(group).distinct()
    n = groups.count()
    test = groups.orderBy(hash_order(group, seed), group).limit(math.ceil(share * n))
    return rows.join(test.withColumn("is_test", F.lit(True)), group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def hash_split(rows: DataFrame, group: str, share: float = 0.15) -> DataFrame:
    """Adds is_test from the group alone: no shuffle, and a new group moves no other; the share is met on average."""
    return rows.withColumn("is_test", F.conv(F.substring(F.md5(F.col(group).cast("string")), 1, 7), 16, 10).cast("bigint") % 10_000 < int(share * 10_000))


def dense_ids(rows: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """Labels numbered from 0 in sorted order; only the distinct labels are numbered, in ranges. Rows without a label
    are left out."""
    labels = rows.select(label).where(F.col(label).isNotNull()).distinct()
    return rows.join(number(labels, [label], out=out).withColumn(out, F.col(out).cast("int")), label)


def complete_folders(files: DataFrame, required: Sequence[str], path: str = "path") -> DataFrame:
    """Folders that hold all the required file names."""
    p = F.col(path)
    return files.select(F.regexp_replace(p, r"/[^/]*$", "").alias("folder"), S.basename(p).alias("file")).where(F.col("file").isin(*required)).groupBy("folder").agg(F.count_distinct("file").alias("n")).where(F.col("n") == len(set(required))).select("folder")


def folder_scan(files: DataFrame, path: str = "path") -> DataFrame:
    """(game, label, filename) of files laid out as game/label/file."""
    return files.select(S.part(path, 3).alias("game"), S.part(path, 2).alias("label"), S.part(path, 1).alias("filename"))
