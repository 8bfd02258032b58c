"""Personal data, by fixed patterns and bootstrapped contextual extraction.

The base kinds (email, ip, card, phone) are found by rule and are the seeds of a bootstrap. The two
words before a seed, and the two after it, are lexical patterns. Identifier-like strings that no rule
takes (`candidates`: words with a digit, numbers in parts, spelt-out addresses) are instances of the
patterns they stand in, of no kind at first: the pattern gives it. Words with digits make no pattern.

Patterns and instances form a graph, scored in rounds: a pattern's reliability for a kind is the share
of all its occurrences in the corpus, identifiers or not, that are instances, each weighed by its own
reliability; a seed's is 1, a candidate's the noisy-or of its patterns'. A pattern needs `SUPPORT`
different confirmed instances of the kind, and is trusted from `TRUST` on. After `ROUNDS` rounds
the candidates in trusted patterns that reach `TRUST` themselves are confirmed: in the next generation
they support patterns as seeds do, so identifiers that never stand by a seed's words are reached too.
It ends when a generation confirms nothing new, after `GENERATIONS` at the latest. A candidate in a
trusted pattern is added as a span of the pattern's kind. Base spans always stay.

The corpus is counted whole, in one pass however many patterns there are: workers hold a Bloom filter
of the patterns in question, of at most `FILTER_BITS` bits, and the join with the patterns drops what
it lets through by chance. Words and values are hashes in the graph, so a row is small whatever their
length. The graph is scored in Spark and its tables are written after each round. Trusted patterns
travel to the workers in blocks of at most `BLOCK`, a block a pass. Documents are never shuffled.

Cases: a null or empty text has no spans. Rows are handled one by one; repeated rows stay (equal
values support a pattern once), null ids don't matter, extra columns are ignored. Without seeds or
candidates nothing is added. A candidate in trusted patterns of two kinds gets a span of each.
Matching takes linear time in a text's length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

KINDS = ("email", "ip", "card", "phone")
SUPPORT, TRUST, ROUNDS, GENERATIONS, BLOCK = 3, 0.8, 3, 3, 200_000
#: Bits of the filter for each pattern, of the whole filter at least (128 KB) and at most (16 MB).
BITS_EACH, LEAST_BITS, FILTER_BITS = 32, 1 << 20, 1 << 27
#: Characters of a word that make it a candidate, if one is a digit.
LEAST_WORD = 4
NO_KIND = -1

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is matched whole or not at all, so starting within one is never tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # kind, start, end
Pattern = tuple[int, int, int]  # side, hashes of two words


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str, marks: str = "@") -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find(marks)
    while at >= 0:
        left = text[done:at]
        start = done + len(left.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
        done = match.end() if match else at + 1
        at = text.find(marks, done)


def base(text: str | None) -> list[Span]:
    """Spans of the four kinds by rule, sorted by kind and start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        # Leading zeros don't count; int() of a very long part is never asked for.
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


_REST = re.compile(r"\S*")
_TWO_AFTER = re.compile(r"\s+(\S+)\s+(\S+)")
_MARKS = "\"'`.,;:!?()[]{}<>*_~|\u201c\u201d\u2018\u2019\u00ab\u00bb"
_LOOSE_RUN = re.compile(r"[0-9(][0-9 ().-]*+")
_HEX_RUN = re.compile(r"[0-9A-Fa-f:]++")
_AT = re.compile(r" ?[(\[](?:at|AT)[)\]] ?| (?:at|AT) ")
_SPELT = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[ ]?[(\[]?(?:dot|DOT)[)\]]?[ ]?)[A-Za-z0-9-]+)+")


def _shapes(text: str) -> Iterator[tuple[int, int]]:
    """Identifiers that may take several words: spelt-out addresses, IPv6 addresses, numbers of 7 to 19 digits."""
    if " at " in text or "(at)" in text or "[at]" in text or "[AT]" in text or "(AT)" in text or " AT " in text:
        done = 0
        for m in _AT.finditer(text):
            start = done + len(text[done : m.start()].rstrip(_LOCAL))
            tail = _SPELT.match(text, m.end()) if start < m.start() else None
            if tail:
                yield start, tail.end()
            done = m.end()
    if _DIGIT.search(text):
        if text.count(":") > 2:
            for m in _HEX_RUN.finditer(text):
                if 3 <= m[0].count(":") <= 7 and all(len(p) <= 4 for p in m[0].split(":")):
                    yield m.span()
        for m in _LOOSE_RUN.finditer(text):
            if m.end() - m.start() >= 7:
                run = m[0].rstrip(" ().-")
                if 7 <= len(_NOT_DIGIT.sub("", run)) <= 19:
                    yield m.start(), m.start() + len(run)


def _numbered(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit, without the marks around them."""
    done = 0
    while m := _DIGIT.search(text, done):
        start = _word_start(text, m.start(), done)
        done = _REST.match(text, m.end()).end()
        word = text[start:done]
        bare = word.strip(_MARKS)
        if len(bare) >= LEAST_WORD:
            start += len(word) - len(word.lstrip(_MARKS))
            yield start, start + len(bare)


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like strings, sorted, that overlap neither a base span nor each other."""
    out: list[tuple[int, int]] = []
    done = [0]
    for found in (_shapes(text), _numbered(text)):
        fixed = sorted([(a, b) for _, a, b in taken] + out)
        k = 0
        new = []
        for a, b in sorted(found):
            while k < len(fixed) and fixed[k][1] <= a:
                k += 1
            if (k == len(fixed) or fixed[k][0] >= b) and a >= done[-1]:
                new.append((a, b))
                done.append(b)
        out += new
        done = [0]
    return sorted(out)


def _word_start(text: str, at: int, least: int = 0) -> int:
    while at > least and not text[at - 1].isspace():
        at -= 1
    return at


def _two_before(text: str, at: int) -> str | None:
    """The two words that end before a word's start, joined by a space."""
    own = []
    for _ in range(2):
        while at and text[at - 1].isspace():
            at -= 1
        if not at:
            return None
        start = _word_start(text, at)
        own.append(text[start:at])
        at = start
    return f"{own[1]} {own[0]}"


def _hashed(words: str | None) -> tuple[int, int] | None:
    from xxhash import xxh3_64_intdigest

    if words is None or _DIGIT.search(words):
        return None
    a, b = words.lower().split()
    return xxh3_64_intdigest(a), xxh3_64_intdigest(b)


def contexts(text: str, found: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[Pattern]]]:
    """Spans, sorted, with their patterns (side, hash of the first word, of the second): the two words before the word
    in which a span starts (side 0) and the two after that in which it ends (side 1). What stands around a word is
    looked up once however many spans are in it."""
    word_end, ends_from, ends_to = -1, 0, -1
    left = right = None
    for a, b in found:
        if a >= word_end:
            word_end = _REST.match(text, a).end()
            left = _hashed(_two_before(text, _word_start(text, a)))
        if not ends_from <= b <= ends_to:
            ends_from, ends_to = b, _REST.match(text, b).end()
            after = _TWO_AFTER.match(text, ends_to)
            right = _hashed(f"{after[1]} {after[2]}" if after else None)
        yield a, b, [(side, *h) for side, h in enumerate((left, right)) if h]


_EDGE = pa.schema([("kind", pa.int32()), ("side", pa.int32()), ("h1", pa.uint64()), ("h2", pa.uint64()), ("value", pa.binary()), ("n", pa.int64())])
_PATTERN = ["side", "h1", "h2"]


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Unsigned columns as Spark's longs, bit for bit."""
    return pa.RecordBatch.from_arrays([c.view(pa.int64()) if c.type == pa.uint64() else c for c in batch.columns], names=batch.schema.names)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern-instance edges of a batch, counted."""
    from xxhash import xxh3_128_digest

    for batch in batches:
        n: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            own = base(text)
            kinds = {(a, b): [k for k, *_ in g] for (a, b), g in groupby(sorted(own, key=lambda s: s[1:]), key=lambda s: s[1:])}
            kinds |= dict.fromkeys(candidates(text, own), [NO_KIND])
            for a, b, found in contexts(text, sorted(kinds)):
                if found:
                    value = xxh3_128_digest(text[a:b])
                    n.update((kind, *p, value) for kind in kinds[a, b] for p in found)
        columns = list(zip(*n)) if n else [[]] * 5
        yield _signed(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, list(n.values())], _EDGE)], schema=_EDGE))


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of word pairs in a filter of `bits` bits, a power of two."""
    x = (h1 * np.uint64(0x9E3779B97F4A7C15)) ^ (h2 + (h1 << np.uint64(7)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    mask = np.uint64(bits - 1)
    return x & mask, (x >> np.uint64(32)) & mask


def _pair_filter(patterns: DataFrame) -> np.ndarray:
    """Bloom filter of the word pairs of `patterns` (written already), as bytes with a bit each. At most FILTER_BITS / 64
    rows reach the driver."""
    n = patterns.count()
    bits = min(FILTER_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH - 1).bit_length()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (c.to_numpy().view(np.uint64) for c in batch.columns)
            at = np.concatenate(_places(h1, h2, bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    rows = patterns.select("h1", "h2").mapInArrow(placed, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[rows["slot"].to_numpy()] = rows["bit"].to_numpy().view(np.uint64)
    return out


def _occurrences(known: np.ndarray):
    """(side, h1, h2, n): how often word pairs that the filter lets through stand before (side 0) or after (side 1) a word."""
    bits = len(known) << 6

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            held = []
            for text in batch.column(0).to_pylist():
                words = text.lower().split() if text else []
                k = len(words)
                if k < 3:
                    continue
                h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, k)
                p, q = _places(h[:-1], h[1:], bits)
                at = np.flatnonzero(known[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1))
                q = q[at]
                at = at[(known[q >> np.uint64(6)] >> (q & np.uint64(63)) & np.uint64(1)).astype(bool)]
                for side, own in ((0, at[at < k - 2]), (1, at[at > 0])):
                    held.append((np.full(len(own), side, np.int32), h[own], h[own + 1]))
            side, h1, h2 = (np.concatenate(c) for c in zip(*held)) if held else (np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint64))
            order = np.lexsort((h2, h1, side))
            side, h1, h2 = side[order], h1[order], h2[order]
            new = np.ones(len(side), bool)
            new[1:] = (side[1:] != side[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(side)))
            yield pa.RecordBatch.from_arrays([pa.array(side[first]), pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(n.astype(np.int64))], names=[*_PATTERN, "n"])

    return counted


def _blocks(rows: DataFrame, column: str) -> Iterator[list]:
    held = []
    for r in rows.toLocalIterator():
        held.append(r[column])
        if len(held) == BLOCK:
            yield held
            held = []
    if held:
        yield held


def learn(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, side, h1, h2, reliability) of the trusted patterns of all texts; the words as in contexts()."""
    spark = docs.sparkSession
    C.arrow_limits(spark)
    none = spark.createDataFrame([], "kind int, side int, h1 long, h2 long, reliability double")
    texts = docs.select(F.col(text_col).alias("text"))
    edges = texts.mapInArrow(C.tidy(_edges), "kind int, side int, h1 long, h2 long, value binary, n long").groupBy("kind", *_PATTERN, "value").agg(F.sum("n").alias("n"))
    edges = C.materialise(edges, "pii_edges")
    # Only patterns that can have support and have something to add are counted and scored.
    support = edges.groupBy(*_PATTERN).agg(F.count("*").alias("values"), F.count_if(F.col("kind") == NO_KIND).alias("others"))
    active = C.materialise(support.where((F.col("values") >= SUPPORT) & (F.col("others") > 0)).select(*_PATTERN), "pii_active")
    if not active.limit(1).count():
        return none
    counts = texts.mapInArrow(C.tidy(_occurrences(_pair_filter(active))), "side int, h1 long, h2 long, n long").groupBy(*_PATTERN).agg(F.sum("n").alias("total"))
    totals = C.materialise(active.join(counts, _PATTERN, "left"), "pii_counts")
    graph = C.materialise(edges.withColumnRenamed("kind", "own").join(totals, _PATTERN), "pii_graph")
    seeds = graph.where(F.col("own") != NO_KIND).select(F.col("own").alias("kind"), "value", F.lit(1.0).alias("r"), F.lit(True).alias("sure")).distinct()
    loose = graph.where(F.col("own") == NO_KIND).select(*_PATTERN, "value")
    confirmed, known, scored = None, 0, none
    for _ in range(GENERATIONS):
        sure = seeds if confirmed is None else seeds.unionByName(confirmed)
        instances = sure
        for _ in range(ROUNDS):
            met = graph.join(instances, "value").where((F.col("own") == NO_KIND) | (F.col("own") == F.col("kind")))
            found = met.groupBy("kind", *_PATTERN).agg(F.count_if("sure").alias("support"), F.sum(F.col("n") * F.col("r")).alias("mass"), F.max("total").alias("total"))
            scored = C.materialise(found.where(F.col("support") >= SUPPORT).select("kind", *_PATTERN, F.least(F.lit(1.0), F.col("mass") / F.col("total")).alias("reliability")), "pii_patterns")
            doubt = F.exp(F.sum(F.log1p(-F.least(F.col("reliability"), F.lit(1 - 1e-9)))))
            weighed = loose.join(scored, _PATTERN).groupBy("kind", "value").agg((1 - doubt).alias("r"), F.max(F.col("reliability") >= TRUST).alias("trusted"))
            weighed = C.materialise(weighed, "pii_instances")
            guessed = weighed.join(sure.select("kind", "value"), ["kind", "value"], "left_anti")
            instances = sure.unionByName(guessed.select("kind", "value", "r", F.lit(False).alias("sure")))
        confirmed = weighed.where(F.col("trusted") & (F.col("r") >= TRUST)).select("kind", "value", "r", F.lit(True).alias("sure"))
        confirmed = C.materialise(confirmed.join(seeds.select("kind", "value"), ["kind", "value"], "left_anti"), "pii_confirmed")
        before, known = known, confirmed.count()
        if known <= before:
            break
    return scored.where(F.col("reliability") >= TRUST)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def spans(text: str | None, trusted: dict[Pattern, set[int]]) -> list[tuple[int, int, int, bool]]:
    """All spans of a text, sorted by kind and start."""
    own = base(text)
    out = [(*s, True) for s in own]
    if trusted and text:
        for a, b, found in contexts(text, candidates(text, own)):
            out += [(k, a, b, False) for k in set().union(*(trusted.get(p, ()) for p in found))]
    return sorted(out)


def _finder(trusted: dict[Pattern, set[int]]):
    @F.arrow_udf(_SPANS)
    @C.tidy
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t, trusted)] for t in texts.to_pylist()], _SPANS_ARROW)

    return find


def _models(docs: DataFrame, text_col: str) -> Iterator[dict[Pattern, set[int]]]:
    """Trusted patterns of all texts with their kinds, in blocks; at least one."""
    keyed = learn(docs, text_col).groupBy(*_PATTERN).agg(F.collect_set("kind").alias("kinds")).select(F.struct(*_PATTERN, "kinds").alias("t"))
    any_block = False
    for block in _blocks(keyed, "t"):
        any_block = True
        yield {(r.side, r.h1 % (1 << 64), r.h2 % (1 << 64)): set(r.kinds) for r in block}
    if not any_block:
        yield {}


def _annotated(docs: DataFrame, models: Iterator[dict[Pattern, set[int]]], out: str, text_col: str) -> DataFrame:
    docs = docs.withColumn(out, _finder(next(models))(F.col(text_col)))
    for model in models:
        docs = C.materialise(docs, "pii_block").withColumn(out, F.array_sort(F.array_union(out, _finder(model)(F.col(text_col)))))
    return docs


def annotate(docs: DataFrame, out: str = "pii", text_col: str = "text") -> DataFrame:
    """`docs` with a column `out` of spans (kind index, start, end, base) in code points."""
    return _annotated(docs, _models(docs, text_col), out, text_col)


def redact_text(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    """The text with a kind's name in brackets for each span (kind, start, end); overlapping spans become one."""
    if not text or not found:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(found, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(parts) + text[at:]


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array([redact_text(t, [(s["kind"], s["start"], s["end"]) for s in own or []]) for t, own in zip(texts.to_pylist(), found.to_pylist())], pa.string())


def redact(text: Column, found: Column) -> Column:
    """The redacted text of a text and its spans."""
    return _redacted(text, found)


def redacted(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """`docs` with the redacted text as column `out`. One block of patterns is found and redacted in one UDF, so a task
    needs one Python worker."""
    models = _models(docs, text_col)
    first, second = next(models), next(models, None)
    if second is not None:
        own = C.free(docs, "spans")
        found = _annotated(docs, chain((first, second), models), own, text_col)
        return found.withColumn(out, redact(F.col(text_col), F.col(own))).drop(own)
    C.arrow_limits(docs.sparkSession)

    @F.arrow_udf(T.StringType())
    @C.tidy
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([redact_text(t, [s[:3] for s in spans(t, first)]) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(out, clean(F.col(text_col)))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op3: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = annotate(docs.select("doc_id", "text"), "__found").select("doc_id", F.col("__found").alias("f"))
    own = F.filter("f", lambda s: s["base"])

    def count(kind: int) -> Column:
        return F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("f")).alias("spans"))
