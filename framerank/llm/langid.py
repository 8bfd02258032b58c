"""Language identification by rank-order n-gram profiles.

A language's profile is the ranking of its most frequent letter n-grams (1 to 3 letters, words
padded by a blank), counted over all its learning documents. A document's own ranking is compared to
each profile by out-of-place distance: the sum of rank differences, an n-gram that a profile lacks
counting the most. The nearest language wins, ties by name.

Counting is one Arrow pass with counts kept per task, then a partial aggregate by (language, n-gram).
Profiles hold `TOP` n-grams a language, so what travels to the workers is bounded by the number of
languages (at most `MOST_LANGUAGES`, else an error names the column).

Cases: a null text or one without a letter is `und` with score 0. With nothing to learn from, every
text is `und`. Null languages are not learned; a null doc_id counts as not held out. Rows are
predicted one by one, so repeated rows stay and extra columns don't matter. Whole texts are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

TOP, MOST_LANGUAGES = 300, 2000
#: Texts whose n-grams a worker holds at once.
SLICE = 200
UNKNOWN = "und"
_PAD = 32
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Grams:
    """The n-grams of a batch of texts as small integers, in the order of their code points."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        raw = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), np.uint32)
        letter = _letters()[raw]
        sign = np.where(letter, raw, _PAD)
        keep = np.concatenate(([True], (sign[1:] != _PAD) | (sign[:-1] != _PAD)))
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))  # the blank before each text
        self.bounds = np.cumsum(keep)[at] - 1
        sign = sign[keep]
        present = np.zeros(0x110000, bool)
        present[sign] = True
        self.signs = np.flatnonzero(present)
        self.base = b = len(self.signs)
        kind = np.int32 if b + b**2 + b**3 < 1 << 31 else np.int64
        place = np.zeros(0x110000, kind)
        place[self.signs] = np.arange(b)
        d, pad = place[sign], sign == _PAD
        self.one = np.where(pad, -1, d).astype(kind)
        self.two = np.where(pad[:-1] & pad[1:], -1, b + d[:-1] * b + d[1:]).astype(kind)
        self.three = np.where(pad[1:-1], -1, b + b * b + (d[:-2] * b + d[1:-1]) * b + d[2:]).astype(kind) if len(d) > 2 else np.empty(0, kind)

    def of(self, k: int) -> np.ndarray:
        """All n-grams of text k, with repeats, -1 among them."""
        a, z = self.bounds[k], self.bounds[k + 1] + 1
        return np.concatenate((self.one[a:z], self.two[a : max(a, z - 1)], self.three[a : max(a, z - 2)]))

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Code points of n-grams, 21 bits each: the same number in every batch."""
        b = self.base
        signs = self.signs.astype(np.int64)
        codes = codes.astype(np.int64)
        out = np.empty(len(codes), np.int64)
        n1, n2 = codes < b, codes < b + b * b
        out[n1] = signs[codes[n1]]
        k = codes[n2 & ~n1] - b
        out[n2 & ~n1] = signs[k // b] << 21 | signs[k % b]
        k = codes[~n2] - b - b * b
        out[~n2] = signs[k // (b * b)] << 42 | signs[k // b % b] << 21 | signs[k % b]
        return out

    @staticmethod
    def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.sort(codes[codes >= 0])
        if not len(codes):
            return codes, codes
        cut = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]))
        return codes[cut[:-1]], np.diff(cut)

    def ranked(self, k: int, top: int) -> np.ndarray:
        """The most frequent n-grams of text k, packed, most frequent first, ties by code points."""
        codes, n = self.counted(self.of(k))
        if len(codes) > top:
            least = np.partition(n, len(n) - top)[len(n) - top]
            codes, n = codes[n >= least], n[n >= least]
        return self.packed(codes[np.argsort(-n, kind="stable")][:top])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task, merged as it grows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    size = 0

    def merged(parts):
        grams, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        cut = np.concatenate(([0], np.flatnonzero(grams[1:] != grams[:-1]) + 1))
        return grams[cut], np.add.reduceat(n, cut)

    def flush():
        for lang, parts in held.items():
            grams, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        grams = Grams(texts)
        rows = defaultdict(list)
        for k, lang in enumerate(langs):
            rows[lang].append(k)
        for lang, own in rows.items():
            codes, n = grams.counted(np.concatenate([grams.of(k) for k in own]))
            if len(codes):
                held[lang].append((grams.packed(codes), n))
                size += len(codes)
        if size > 1_000_000:
            for lang in held:
                held[lang] = [merged(held[lang])]
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > 500_000:
                yield from flush()
                size = 0
    yield from flush()


def fit(rows: DataFrame, top: int = TOP) -> dict[str, list[int]]:
    """rows: lang and text. Each language's n-grams, most frequent first."""
    C.arrow_limits(rows.sparkSession)
    counts = rows.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(C.tidy(_counts), "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    found: dict[str, list[int]] = defaultdict(list)
    # Bounded: `top` rows a language, checked as they come.
    for r in best.orderBy("lang", "rank").toLocalIterator():
        found[r.lang].append(r.gram)
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"column lang has more than {MOST_LANGUAGES} values")
    return dict(found)


class Model:
    """Profiles as one table: row = n-gram, column = language, value = rank."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.top, self.langs = top, sorted(profiles)
        self.grams = np.unique(np.array([g for own in profiles.values() for g in own], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, texts: list[str | None]) -> list[dict]:
        grams = Grams(texts)
        out = []
        for k in range(len(texts)):
            own = grams.ranked(k, self.top)
            if not len(own) or not self.langs:
                out.append({"lang": UNKNOWN, "score": 0.0})
                continue
            at = np.searchsorted(self.grams, own)
            at[at == len(self.grams)] = 0
            at = np.where(self.grams[at] == own, at, len(self.grams))
            ranks = self.ranks[at]
            off = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
            j = int(np.argmin(off))
            out.append({"lang": self.langs[j], "score": 1 - float(off[j]) / (self.top * len(own))})
        return out


def predict(text: Column, profiles: dict[str, list[int]], top: int = TOP) -> Column:
    """Struct column (lang, score): score is 1 for a ranking that equals the profile's, 0 for none in common."""

    @F.arrow_udf(RESULT)
    @C.tidy
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(profiles, top)
        for texts in batches:
            out: list[dict] = []
            for at in range(0, len(texts), SLICE):
                out += model.predict(texts.slice(at, SLICE).to_pylist())
            yield pa.array(out, _ARROW)

    return predicted(text)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op5: doc_id, held_out, lang_pred, score."""
    profiles = fit(docs.where(~held_out()).select("lang", "text"))
    rows = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), profiles).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
