"""SimHash near-duplicates by the Jaccard similarity of word shingles: simhash's trie self-join, an exact check of what it
finds, and the pairs beyond its error budget.

Two texts are linked if their `SHINGLE`-word shingles (of the whole text if it is shorter) have a
similarity of `SIMILARITY` or more; the k-th occurrence of a shingle is an element of its own, so a text is
not like the short one that it repeats a line after; groups are the connected components of the links. Equal sets are
one node.

First all distinct fingerprints go through simhash's self-join: tries below the 15 choices of equal segments, walked with
its budget of 4 bits, as op2 does (on the shingles of this stage). What links them is a spanning forest of pairs within the budget,
and each pair is checked by its whole sets. Where the sets refuse a pair of the forest, what else joins its texts
is found by the second step, which compares all that share a band.

At similarity 0.8 fingerprints differ in 10 to 13 bits of 64 on average, with a deviation of 3, so most links are beyond that
budget, and the second step has one of `BITS`. No choice of equal bit segments holds such pairs, as it does for op2's four bits, so the
tries stand below minima instead: `BANDS` bands of `BAND` least hashes each, of which a pair at 0.8 shares none
once in 2e7. A pair within the budget is compared by its whole sets.

Each member of a band is first compared with the band's least one, which links most of a cluster of near copies without
a square of its size. Bands whose members are not all in one group after that are compared whole. Those of up to
`FEW_ROWS` members give their pairs of different groups within the budget as rows, each checked once. The others
are walked as tries, in tasks of a bounded size: a pair is looked at in the first band that it shares only, nearest first,
and not once both are in one group, and a task puts out the links that join groups, so no table of pairs is made of
a large band. A band beyond `TASK_ROWS` or `TASK_BYTES` is dealt out as a grid of its parts.

Cases: null, empty and blank texts have the empty set and are in one group. Repeated rows stay and share
a group. A null doc_id takes part; a group's id is its smallest non-null doc_id, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C
from framerank.llm import simhash
from framerank.llm.components import components
from framerank.llm.simhash import majority, near_pairs

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, BAND = 32, 4
#: Bits of a fingerprint in which linked texts may differ.
BITS = 26
#: Members up to which an open band is compared by pair rows: fewer than half as many a member.
FEW_ROWS = 32
#: Members of a band, and bytes of their sets, that are one part of a task; a task has two parts at most.
TASK_ROWS, TASK_BYTES = 1024, 8 << 20
#: Ids up to this number travel to the documents (8 bytes each); more meet them in a shuffle.
FEW_IDS = 2_000_000

_KEY = ["same", "n", "fp"]
_DRAW = np.random.default_rng(SEED)
_XOR = _DRAW.integers(0, 1 << 64, BANDS * BAND, np.uint64, endpoint=False)
_ODD = _DRAW.integers(0, 1 << 64, BANDS * BAND, np.uint64, endpoint=False) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Ascending hashes of a text's shingles, each with the number of its occurrence."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    n = max(1, len(own) - SHINGLE + 1)
    x = np.sort(np.fromiter((xxh64_intdigest(b" ".join(own[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n))
    first = np.concatenate(([True], x[1:] != x[:-1]))
    at = np.arange(n)
    again = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    if not again.any():
        return x
    x += again * np.uint64(0x9E3779B97F4A7C15)
    x[again > 0] = (x[again > 0] ^ (x[again > 0] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0 if len(b) else 1.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)


def _minima(own: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * BAND, ~np.uint64(0))
    for k in range(0, len(own), 1024):
        x = (own[k : k + 1024, None] ^ _XOR) * _ODD
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return least


@F.arrow_udf(T.StructType([*(T.StructField(k, T.IntegerType() if k == "n" else T.LongType()) for k in _KEY), T.StructField("bands", T.ArrayType(T.LongType()))]))
@C.tidy
def _sketches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from xxhash import xxh64_intdigest

    signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
    for texts in batches:
        same, n, fp, bands, ends = [], [], [], [], [0]
        for text in texts:
            own = shingles(text.as_py())
            least = _minima(own)
            same.append(xxh64_intdigest(own.tobytes(), SEED))
            n.append(len(own))
            fp.append(majority(own))
            if len(own):
                bands += [xxh64_intdigest(least[k * BAND : (k + 1) * BAND].tobytes(), k) for k in range(BANDS)]
            ends.append(len(bands))
        yield pa.StructArray.from_arrays([signed(same), pa.array(n, pa.int32()), signed(fp), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(bands))], names=[*_KEY, "bands"])


@F.arrow_udf(T.BinaryType())
@C.tidy
def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([shingles(t.as_py()).tobytes() for t in texts], pa.binary())


@F.arrow_udf(T.BooleanType())
@C.tidy
def _alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for left, right in batches:
        yield pa.array([similarity(_set(a), _set(b)) >= SIMILARITY for a, b in zip(left, right)], pa.bool_())


def _set(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _may_be(a: str, b: str):
    """Whether sizes and fingerprints leave a similarity of SIMILARITY possible."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    # A rounding error wide: the sets decide.
    return (F.least(n, m) >= F.greatest(n, m) * (SIMILARITY - 1e-9)) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= BITS)


def _sets_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, s): the shingle sets of the rows whose ids are given, written already and distinct."""
    few = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    return C.materialise(rows.select("row", "text").join(few, "row").select("row", _sets("text").alias("s")), "similar_texts")


def _linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of row ids whose texts are similar. pairs: written already."""
    ids = C.materialise(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "similar_ids")
    own = _sets_of(ids, rows)
    both = pairs.join(own.toDF("a", "left"), "a").join(own.toDF("b", "right"), "b")
    return C.materialise(both.where(_alike("left", "right")).select("a", "b"), "similar_links")


def _forest(table: pa.Table) -> tuple[list[int], list[int]]:
    """Links between the rows of whole tasks (task, band, row, root, n, fp, bands, s) that join their groups."""
    task, x = table["task"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
    order = np.lexsort((x, task))
    task, x = task[order], x[order]
    table = table.take(order)
    row, root, n, band = (table[c].to_numpy() for c in ("row", "root", "n", "band"))
    bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(x), BANDS)
    cut = np.flatnonzero(task[1:] != task[:-1]) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))
    # Rows of one group have one label within a task.
    by = np.lexsort((root, task))
    new = np.concatenate(([True], (task[by][1:] != task[by][:-1]) | (root[by][1:] != root[by][:-1])))
    label = np.empty(len(x), np.int64)
    label[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    parent = {}
    sets: dict[int, np.ndarray] = {}

    def top(i: int) -> int:
        while (up := parent.get(i, i)) != i:
            parent[i] = parent.get(up, up)
            i = up
        return i

    def own(i: int) -> np.ndarray:
        found = sets.get(i)
        if found is None:
            found = sets[i] = _set(table["s"][i])
        return found

    out: tuple[list[int], list[int]] = ([], [])
    many = ends - starts > 1
    for i, j in near_pairs(x, starts[many], ends[many], label, BITS):
        ok = (i < j) & (label[i] != label[j]) & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * (SIMILARITY - 1e-9))
        i, j = i[ok], j[ok]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            shared = bands[a] == bands[b]
            first = shared.argmax(axis=1)
            here = bands[a, first] == band[a]
            a, b = a[here], b[here]
            nearest = np.argsort(np.bitwise_count(x[a] ^ x[b]), kind="stable")
            for p, q in zip(a[nearest].tolist(), b[nearest].tolist()):
                u, v = top(int(label[p])), top(int(label[q]))
                if u != v and similarity(own(p), own(q)) >= SIMILARITY:
                    parent[max(u, v)] = min(u, v)
                    out[0].append(int(row[p]))
                    out[1].append(int(row[q]))
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by task: whole tasks are joined as they complete."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = _forest(pa.Table.from_batches(parts))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != task[0]:
            yield joined(held)
            held = []
        last = int(np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))[-1])
        if last:
            yield joined([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield joined(held)


def _across(named: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between the groups of bands that hold several. named: (band, row, root), written already."""
    open_ = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo != hi").select("band", "m")
    open_ = C.materialise(named.join(open_, "band"), "similar_open")
    small = open_.where(F.col("m") <= FEW_ROWS).join(sets.select("row", "n", "fp"), "row")
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & _may_be("x", "y"))
    pairs = C.materialise(pairs.select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct(), "similar_pairs")
    found = _linked(pairs, rows)
    left = open_.where(F.col("m") > FEW_ROWS)
    if not left.limit(1).count():
        return found
    own = _sets_of(C.materialise(left.select("row").distinct(), "similar_ids"), rows)
    whole = C.materialise(sets.select("row", "n", "fp", "bands").join(own, "row"), "similar_whole")
    full = left.join(whole, "row")
    parts = F.greatest(F.ceil(F.col("m") / TASK_ROWS), F.ceil(F.col("bytes") / TASK_BYTES)).cast("int")
    sizes = left.join(whole.select("row", (F.col("n") * 8).alias("b")), "row").groupBy("band").agg(F.max("m").alias("m"), F.sum("b").alias("bytes")).withColumn("parts", parts)
    large = C.materialise(sizes.where("parts > 1").select("band", "parts"), "similar_large")
    if large.limit(1).count():
        full = full.join(large, "band", "left").withColumn("p", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))))
        full = full.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
        task = F.xxhash64("band", F.least("p", "q"), F.greatest("p", "q"))
    else:
        task = F.xxhash64("band")
    dealt = full.select(task.alias("task"), "band", "row", "root", "n", "fp", "bands", "s").repartition("task").sortWithinPartitions("task")
    return found.unionByName(C.materialise(dealt.mapInArrow(C.tidy(_walk), "a long, b long"), "similar_across"))


def _self_joined(sets: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Simhash's self-join of all fingerprints: the pairs of row ids (a < b) that it finds, and those whose texts are similar."""
    first = C.materialise(sets.groupBy("fp").agg(F.min("row").alias("first")), "similar_fingerprints")
    near = C.materialise(simhash.links(first.select("fp"), forest=True).distinct(), "similar_near")
    both = near.join(first.toDF("a", "p"), "a").join(first.toDF("b", "q"), "b").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    equal = sets.join(first, "fp").where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    pairs = C.materialise(_possible(both.unionByName(equal), sets), "similar_self_joined")
    return pairs, _linked(pairs, rows)


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    slim = sets.select("row", "n", "fp")
    return pairs.join(slim.alias("x"), F.col("a") == F.col("x.row")).join(slim.alias("y"), F.col("b") == F.col("y.row")).where(_may_be("x", "y")).select("a", "b")


def links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """sets: row, n, fp, bands of each distinct set, written already. Edges (a, b) between their row ids that
    span the same groups as all similar pairs."""
    tried, joined = _self_joined(sets, rows)
    banded = sets.select("row", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("row").alias("lead"), F.count("*").alias("m")).where("m > 1").drop("m")
    shared = C.materialise(banded.join(least, "band"), "similar_bands")
    stars = shared.where("row != lead").select(F.col("lead").alias("a"), F.col("row").alias("b")).distinct()
    stars = C.materialise(_possible(stars, sets).join(tried, ["a", "b"], "left_anti"), "similar_stars")
    found = joined.unionByName(_linked(stars, rows))
    root = components(found).withColumnRenamed("node", "row")
    named = C.materialise(shared.drop("lead").join(root, "row", "left").withColumn("root", F.coalesce("root", "row")), "similar_roots")
    return found.unionByName(_across(named, sets, rows))


def groups(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows: row (long, unique), id_col and text, written already. (row, id_col, component_id, kept) of every row; kept
    holds for one row of each group, that with the smallest id (null the last) and row."""
    C.arrow_limits(rows.sparkSession)
    sketched = C.materialise(rows.select("row", id_col, _sketches("text").alias("k")).select("row", id_col, "k.*"), "similar_sketches")
    equal = C.materialise(sketched.groupBy(*_KEY).agg(F.min("row").alias("least"), F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row")).alias("best"), F.count("*").alias("m")), "similar_sets")
    sets = C.materialise(sketched.join(equal.select(F.col("least").alias("row")), "row", "left_semi").select("row", "n", "fp", "bands"), "similar_distinct")
    roots = components(links(sets, rows)).withColumnRenamed("node", "least")
    joined = equal.join(roots, "least", "left").withColumn("root", F.coalesce("root", "least"))
    named = joined.groupBy("root").agg(F.min("best").alias("best"), F.sum("m").alias("m"))
    # Only sets that are not alone need to be looked up; the others name themselves.
    shared = C.materialise(joined.select(*_KEY, "root").join(named.where("m > 1"), "root").select(*_KEY, "best"), "similar_groups")
    found = sketched.select("row", id_col, *_KEY).join(shared, _KEY, "left")
    shared = F.col("best").isNotNull()
    return found.select("row", id_col, F.when(shared, F.col("best.id")).otherwise(F.col(id_col)).alias("component_id"), (~shared | (F.col("row") == F.col("best.row"))).alias("kept"))
