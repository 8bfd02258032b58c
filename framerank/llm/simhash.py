"""SimHash fingerprints and near-duplicate groups, linked by a binary-trie self-join.

A fingerprint's bit is 1 if it is set in more than half of the XXH64 hashes of the text's word
shingles. Distinct fingerprints are linked if at most `BUDGET` bits differ, and groups are the
connected components of the links.

The self-join walks pairs of trie nodes together, adds up the bits in which their paths differ and
drops a pair once that exceeds the budget. To deal it out, the 64 bits are cut into six segments:
four differing bits leave at least two segments untouched, so for each of the 15 choices of two
segments the trie that has those segments on top is joined only below equal tops. Every link is
found below at least one top. A top with more than `TASK_ROWS` fingerprints is dealt out by pairs of
its next trie nodes. Within a task nodes are ranges of a sorted array, all node pairs of a level
advance together in numpy, and a pair of nodes whose fingerprints are already in one group is
dropped: a large cluster of near copies costs no square of its size.

Only distinct fingerprints are joined, so exact copies cost one row. Links leave a task as a
spanning forest, not as all pairs.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other. Repeated
rows stay and share a group. A null doc_id takes part; a group's id is its smallest non-null doc_id,
null if it has none. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C
from framerank.llm.components import components

SHINGLE, BUDGET, SEED = 4, 4, 42
#: Bit offsets and widths of the six segments, and the two that each table holds equal.
_SEGMENTS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
_TABLES = list(combinations(range(6), 2))
#: Fingerprints below one top that one task takes before the top is dealt out by node pairs.
TASK_ROWS, MOST_SPLIT_BITS = 4096, 10
#: Node pairs that advance together, which bounds a task's memory.
FRONT = 100_000

#: Spreads a byte's bits over the eight bytes of a word, so that sums of up to 255 stay apart.
_SPREAD = np.array([[b >> (7 - i) & 1 for i in range(8)] for b in range(256)], np.uint8).view(np.uint64).ravel()


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split() if text else []
    if not own:
        return 0
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(own) - SHINGLE + 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    spread = _SPREAD[hashes.astype(">u8").view(np.uint8).reshape(n, 8)]
    sums = np.add.reduceat(spread, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


@F.arrow_udf(T.LongType())
@C.tidy
def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.fromiter(map(fingerprint, texts.to_pylist()), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text"):
    """Column of signed 64-bit fingerprints."""
    C.arrow_limits(docs.sparkSession)
    return _fingerprints(F.col(text_col))


# The trie walk ------------------------------------------------------------------------------


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each index's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _hubs(x: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from a few central fingerprints of a large range: members share the centre's group at once."""
    left, to = [], []
    rest = np.arange(lo, hi)
    for _ in range(8):
        if len(rest) < 32:
            break
        bits = np.unpackbits(x[rest].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        centre = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(rest)).view(">u8").astype(np.uint64)[0]
        hub = rest[np.argmin(np.bitwise_count(x[rest] ^ centre))]
        near = np.bitwise_count(x[lo:hi] ^ x[hub]) <= BUDGET
        members = lo + np.flatnonzero(near)
        if len(members) < max(16, len(rest) // 20):
            break
        left.append(np.full(len(members), hub))
        to.append(members)
        rest = rest[~near[rest - lo]]
    return (np.concatenate(left), np.concatenate(to)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def _pairs(alo, ahi, blo, bhi):
    """All index pairs of small node pairs; of a node with itself each pair once."""
    na, nb = ahi - alo, bhi - blo
    each = na * nb
    k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    i, j = np.repeat(alo, each) + k // np.repeat(nb, each), np.repeat(blo, each) + k % np.repeat(nb, each)
    return i, j


def _hub_links(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What _hubs() finds in the large ranges."""
    left, right = [], []
    for lo, hi in zip(starts, ends):
        if hi - lo >= 64:
            a, b = _hubs(x, lo, hi)
            left.append(a)
            right.append(b)
    return left, right


def trie_links(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """x: unsigned fingerprints, ascending within each range starts[g]..ends[g]-1. Labels each index
    with the least index that links within its own range reach."""
    left, right = _hub_links(x, starts, ends)
    label = settle(len(x), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(x))
    for i, j in near_pairs(x, starts, ends, label):
        left.append(i)
        right.append(j)
    if not left:
        return np.arange(len(x))
    return settle(len(x), np.concatenate(left), np.concatenate(right))


def trie_forest(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within the budget that span the groups of trie_links(): each pair is a link itself, not a way to
    the least index, so that a check of its texts tells something."""
    root, kept = np.arange(len(x)), []

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        ok = root[i] != root[j]
        i, j = i[ok], j[ok]
        for k in np.argsort(np.bitwise_count(x[i] ^ x[j]), kind="stable"):
            u, v = top(i[k]), top(j[k])
            if u != v:
                root[max(u, v)] = min(u, v)
                kept.append((min(i[k], j[k]), max(i[k], j[k])))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped

    for i, j in zip(*_hub_links(x, starts, ends)):
        join(i, j)
    for i, j in near_pairs(x, starts, ends, root.copy()):
        join(i, j)
    found = np.array(kept, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def near_pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, label: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the budget from the same range, by walking pairs of trie nodes; ranges as in trie_links(). Node
    pairs of one label are left out."""
    change = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    ones: dict[int, np.ndarray] = {}
    stack = [(0, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, off = stack.pop()
        keep = (ahi > alo) & (bhi > blo) & (off <= budget) & ~((alo == blo) & (ahi - alo < 2))
        same = keep.copy()
        k = np.flatnonzero(keep)
        same[k] = (change[ahi[k] - 1] == change[alo[k]]) & (change[bhi[k] - 1] == change[blo[k]]) & (label[alo[k]] == label[blo[k]])
        keep &= ~same
        small = keep & ((ahi - alo) * (bhi - blo) <= 16)
        if small.any():
            i, j = _pairs(alo[small], ahi[small], blo[small], bhi[small])
            near = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= budget)
            yield i[near], j[near]
        keep &= ~small
        if d == 64:
            # Equal fingerprints: a pair of ranges at a time.
            for a, b, c, e in zip(alo[keep], ahi[keep], blo[keep], bhi[keep]):
                for i in range(a, b):
                    yield np.full(e - c, i), np.arange(c, e)
            continue
        if not keep.any():
            continue
        alo, ahi, blo, bhi, off = alo[keep], ahi[keep], blo[keep], bhi[keep], off[keep]
        if len(alo) > FRONT:
            for k in range(0, len(alo), FRONT):
                stack.append((d, *(v[k : k + FRONT] for v in (alo, ahi, blo, bhi, off))))
            continue
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum(x >> np.uint64(63 - d) & np.uint64(1), dtype=np.int32)))
        c = ones[d]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        cross = alo != blo
        stack.append((
            d + 1,
            np.concatenate((alo, amid, alo, amid[cross])), np.concatenate((amid, ahi, amid, ahi[cross])),
            np.concatenate((blo, bmid, bmid, blo[cross])), np.concatenate((bmid, bhi, bhi, bmid[cross])),
            np.concatenate((off, off, off + 1, off[cross] + 1)).astype(np.int8),
        ))


def _walk(batches: Iterator[pa.RecordBatch], forest: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches sorted by task: whole tasks are joined as they complete."""
    held: list[pa.RecordBatch] = []

    def joined(table: pa.Table) -> pa.RecordBatch:
        task, x = table["task"].to_numpy(), table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((x, task))
        task, x = task[order], x[order]
        cut = np.flatnonzero(task[1:] != task[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))
        many = ends - starts > 1
        if forest:
            i, j = trie_forest(x, starts[many], ends[many])
        else:
            label = trie_links(x, starts[many], ends[many])
            i = np.flatnonzero(label != np.arange(len(x)))
            j = label[i]
        return pa.RecordBatch.from_arrays([pa.array(x[i].view(np.int64)), pa.array(x[j].view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(0).to_numpy()
        first = int(np.searchsorted(task != task[-1], False)) if task[0] == task[-1] else int(np.flatnonzero(task != task[-1])[-1]) + 1
        if first:
            yield joined(pa.Table.from_batches([*held, batch.slice(0, first)]))
            held = []
        held.append(batch.slice(first))
    if held:
        yield joined(pa.Table.from_batches(held))


def _mask(table: tuple[int, int]) -> int:
    bits = sum(((1 << w) - 1) << at for at, w in (_SEGMENTS[s] for s in table))
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def links(distinct: DataFrame, forest: bool = False) -> DataFrame:
    """distinct: column fp without repeats. Edges (a, b) between fingerprints that span the same
    groups as all pairs within the budget; with `forest` each edge is such a pair."""
    free = [min(set(range(6)) - set(t)) for t in _TABLES]
    tops = F.array(*(
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("top"), F.lit(_SEGMENTS[f][0] + _SEGMENTS[f][1]).alias("edge"))
        for i, (t, f) in enumerate(zip(_TABLES, free))
    ))
    below = distinct.select("fp", F.inline(tops))
    hot = C.materialise(
        below.groupBy("t", "top").count().where(F.col("count") > TASK_ROWS)
        .select("t", "top", F.least(F.ceil(F.log2(F.col("count") / TASK_ROWS)), F.lit(MOST_SPLIT_BITS)).cast("int").alias("bits")), "hot_tops",
    )
    if hot.limit(1).count():
        split = below.join(hot, ["t", "top"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
        node = F.expr("int(shiftrightunsigned(fp, edge - bits) & (shiftleft(1L, bits) - 1))")
        split = split.withColumn("p", node).withColumn("q", F.explode(F.expr(f"filter(sequence(0, shiftleft(1, bits) - 1), q -> bit_count(p ^ q) <= {BUDGET})")))
        below = split.select("fp", F.xxhash64("t", "top", F.least("p", "q"), F.greatest("p", "q")).alias("task"))
    else:
        # A task's name is a hash: two tasks under one name would only be compared in vain.
        below = below.select("fp", F.xxhash64("t", "top").alias("task"))
    return below.select("task", "fp").repartition("task").sortWithinPartitions("task").mapInArrow(C.tidy(partial(_walk, forest=forest)), "a long, b long")


def groups(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows: id_col and fp, written already. Adds component_id."""
    ids = rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n"))
    distinct = C.materialise(ids, "simhash_distinct")
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n"))
    # Only fingerprints that are not alone need to be looked up; the others name themselves.
    shared = joined.select("fp", "root").join(named.where("n > 1"), "root").select("fp", "component_id")
    found = rows.join(C.materialise(shared, "simhash_groups").withColumn("__in", F.lit(True)), "fp", "left")
    return found.withColumn("component_id", F.when(F.col("__in"), F.col("component_id")).otherwise(F.col(id_col))).drop("__in")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, fp (signed), component_id."""
    rows = C.materialise(docs.select(F.col(id_col), fingerprints(docs, text_col).alias("fp")), "simhash_rows")
    return groups(rows, id_col)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op2: doc_id, fingerprint, component_id."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
