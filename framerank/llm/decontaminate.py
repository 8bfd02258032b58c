"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of `window` consecutive words of the normalised benchmark items
(a shorter item is one window). Each document is normalised and scanned once; hits are mapped back
to code-point offsets of the original text. There is no shuffle: documents stay where they are and
only the windows travel.

Windows are broadcast in blocks of at most `block_chars` characters, which bounds the automaton's
memory whatever the benchmark's size; a benchmark of several blocks costs one scan a block.

Cases: a null or empty text has no words, no hits and is clean. A benchmark row that is null or has
no words adds no window; an empty benchmark contaminates nothing. Rows are handled one by one, so
repeated rows and null ids are kept as they are. Repeated item ids count once; a null item id is
named "null". Extra columns, also of the names used here, are kept out of the way: `scan` adds one
struct column under the name it is given.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

WINDOW, BLOCK_CHARS = 13, 2_000_000
#: A document is contaminated if at least this share of its words is hit: 1 in 20.
SHARE = 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("words_hit", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("words_hit", _PAIRS), ("spans", _PAIRS)])


def words(text: str | None) -> list[bytes]:
    """Words of a text as normalised UTF-8: A-Z lowered, anything but letters, digits and non-ASCII dropped."""
    return text.encode().translate(_TABLE).split() if text else []


def windows(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[str, list[str]]:
    """Each window, as the characters that stand for its bytes, with the items that hold it."""
    found: dict[str, set[str]] = defaultdict(set)
    for item_id, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            found[f" {b' '.join(own[i : i + window]).decode('latin-1')} "].add("null" if item_id is None else str(item_id))
    return {w: sorted(ids) for w, ids in found.items()}


def blocks(items: Iterable[tuple[object, str | None]], window: int, block_chars: int) -> Iterator[dict[str, list[str]]]:
    """Windows of the items in blocks of at most about `block_chars` characters, made as the items come; at
    least one block. A window that two blocks hold is found twice and counts once."""
    held: list[tuple[object, str | None]] = []
    size, any_block = 0, False
    for item in items:
        chars = window * len(item[1] or "")
        if held and size + chars > block_chars:
            yield windows(held, window)
            held, size, any_block = [], 0, True
        held.append(item)
        size += chars
    if held or not any_block:
        yield windows(held, window)


_automata: dict[str, object] = {}


def _automaton(key: str, block: dict[str, list[str]]):
    """Built once in each worker process; only the last one is kept."""
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for w, ids in block.items():
            made.add_word(w, (w.count(" ") - 1, ids))
        if block:
            made.make_automaton()
        _automata[key] = made
    return _automata[key]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans_of(raw: bytes, first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Code-point offsets of the runs of words first..last-1."""
    kept = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    starts, ends = _runs(kept)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(first, last)]


def scan_text(text: str | None, automaton) -> dict:
    """One pass over one text."""
    own = words(text)
    out = {"n_words": len(own), "n_hit": 0, "item_ids": [], "words_hit": [], "spans": []}
    if not own or not len(automaton):
        return out
    normal = f" {b' '.join(own).decode('latin-1')} "
    hits = list(automaton.iter(normal))
    if not hits:
        return out
    gaps = np.flatnonzero(np.frombuffer(normal.encode("latin-1"), np.uint8) == 32)
    end = np.searchsorted(gaps, np.fromiter((at for at, _ in hits), np.int64, len(hits)))
    start = end - np.fromiter((v[0] for _, v in hits), np.int64, len(hits))
    depth = np.zeros(len(own) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    mask = np.cumsum(depth)[:-1] > 0
    first, last = _runs(mask)
    out["n_hit"] = int(mask.sum())
    out["item_ids"] = sorted({i for _, v in hits for i in v[1]})
    out["words_hit"] = [{"start": int(a), "end": int(b)} for a, b in zip(first, last)]
    out["spans"] = spans_of(text.encode(), first, last)
    return out


def _scanner(shipped):
    key = uuid.uuid4().hex  # workers outlive queries: another benchmark never meets this automaton

    @F.arrow_udf(RESULT)
    @C.tidy
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(key, shipped.value)
        for texts in batches:
            yield pa.array([scan_text(t, automaton) for t in texts.to_pylist()], _ARROW)

    # Else a filter on the result is pushed below it with a scan of its own, in a second worker.
    return scanned.asNondeterministic()


def scan(docs: DataFrame, benchmark: DataFrame, out: str = "hits", *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` with a struct column `out`: n_words, n_hit, item_ids, words_hit (word index runs) and
    spans (code-point offsets of the runs in the original text)."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    parts = blocks(((r[0], r[1]) for r in benchmark.select(item_id_col, item_text_col).toLocalIterator()), window, block_chars)
    first, second = next(parts), next(parts, None)
    if second is None:
        return docs.withColumn(out, _scanner(spark.sparkContext.broadcast(first))(F.col(text_col)))
    # Several blocks: rows get a number that stays, each block writes only the rows that it hits. The
    # driver holds two blocks at a time.
    row, ids, runs = (C.free(docs, n) for n in ("row", "ids", "runs"))
    numbered = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate_rows")
    hit = None
    for block in chain((first, second), parts):
        shipped = spark.sparkContext.broadcast(block)
        part = C.materialise(numbered.select(row, _scanner(shipped)(F.col(text_col)).alias("__hit")).where("__hit.n_hit > 0"), "decontaminate_block")
        shipped.destroy()
        hit = part if hit is None else hit.unionByName(part)
    merged = hit.groupBy(row).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__hit.item_ids")))).alias(ids),
        F.array_sort(F.flatten(F.collect_list("__hit.words_hit"))).alias(runs),
    )
    joined = numbered.join(merged, row, "left")
    return joined.withColumn(out, _merge(F.col(text_col), F.col(runs), F.col(ids))).select(*(c for c in docs.columns if c != out), out)


@F.arrow_udf(RESULT)
def _merge(texts: pa.Array, runs: pa.Array, ids: pa.Array) -> pa.Array:
    rows = []
    for text, own_runs, own_ids in zip(texts.to_pylist(), runs.to_pylist(), ids.to_pylist()):
        own = words(text)
        mask = np.zeros(len(own), bool)
        for r in own_runs or []:
            mask[r["start"] : r["end"]] = True
        first, last = _runs(mask)
        rows.append({"n_words": len(own), "n_hit": int(mask.sum()), "item_ids": own_ids or [], "words_hit": [{"start": int(a), "end": int(b)} for a, b in zip(first, last)], "spans": spans_of(text.encode(), first, last) if len(first) else []})
    return pa.array(rows, _ARROW)


def contaminated(hits: Column) -> Column:
    return (hits["n_hit"] > 0) & (SHARE * hits["n_hit"] >= hits["n_words"])


def excise(text: Column, spans: Column) -> Column:
    """The text without its spans, which are sorted and apart. Spark's substring counts code points."""
    cuts = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), spans)
    kept = F.transform(cuts, lambda c, i: F.substring(text, (c["end"] + 1).cast("int"), (F.coalesce(F.get(spans, i)["start"], F.length(text).cast("long")) - c["end"]).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of op1: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = scan(docs.select("doc_id", "text"), benchmark, "__hits").select("doc_id", "__hits")
    h = F.col("__hits")
    return rows.select(
        "doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["item_ids"], ","), 256).alias("items_sha256"), contaminated(h).alias("contaminated"),
    )
