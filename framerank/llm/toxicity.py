"""Toxicity by cumulative-link ordinal regression.

Severity has grades 0 (clean) to `GRADES`. A text's sparse features are log counts of vocabulary
terms, w their weights, and P(grade >= k) = logistic(w x - t_k): one weight vector for all ordered
thresholds t_1 < t_2 < ... The outputs are the expected severity, the likeliest grade, and
score = P(grade >= 1).

Labels only tell toxic from clean, so the grades of the learning rows come from the labels and the
vocabulary: a clean row is 0; a toxic row is 1 and one more from `STEPS[0]` and from `STEPS[1]` marked
words on, marked words being terms that stand out in toxic rows.

Terms are learned from a sample of at most `SAMPLE` labelled rows, the least by a hash of doc_id, the
same bound for any corpus. A term must occur in toxic rows in at least `CONTEXTS` different
surroundings (the words next to it): near copies of one text repeat its words in the same ones, and
so can't make a term. The `TERMS` terms of the sample with the largest z-scores are the model's features: a bound of the
model like the sample's, while of what is scored every word of every text is looked up. The sample's features, a few
numbers a row, are fitted on the driver. A severity is therefore how many of the learned words a text holds, weighted:
there are no graded labels to learn anything finer from.

Cases: null and empty texts have no terms. Labels that are null or neither 0 nor 1 are not learned,
nor are those of rows held out. Without rows of both classes there are no terms and every text is
clean with score 0. A null doc_id is not held out and has no label. Repeated rows stay. Extra columns
are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

GRADES, STEPS, SAMPLE, CONTEXTS, TERMS = 3, (3, 6), 20_000, 6, 512
#: A marked term's log odds, and its z-score.
MARK_ODDS, MARK_Z = 2.0, 3.0
RIDGE, ROUNDS = 1.0, 300
RESULT = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("score", T.DoubleType())])
_ARROW = pa.struct([("severity", pa.float64()), ("grade", pa.int32()), ("score", pa.float64())])
#: Everything of ASCII but letters and digits parts words; letters are lowered.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_TABLE).split() if text else []


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, before, after) of the toxic rows, each once a batch; hashed neighbours."""
    for batch in batches:
        seen = set()
        for text in batch.column(0).to_pylist():
            own = [b"", *words(text), b""]
            seen.update(zip(own[1:-1], own, own[2:]))
        term, before, after = (list(x) for x in zip(*seen)) if seen else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (term, before, after)], names=["term", "before", "after"])


def _frequencies(terms: frozenset[bytes]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n.update((label, t) for t in terms.intersection(words(text)))
            label, term = (list(x) for x in zip(*n)) if n else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(term, pa.binary()), pa.array(list(n.values()), pa.int64())], names=["label", "term", "n"])

    return counted


def sparse(text: str | None, place: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Indices and counts of the vocabulary terms of a text."""
    n = Counter([place[w] for w in words(text) if w in place])
    return list(n), list(n.values())


def _sparse(place: dict[bytes, int]):
    @F.arrow_udf(T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))]))
    def features(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip("in", sparse(t, place))) for t in texts.to_pylist()], pa.struct([("i", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))

    return features


def cumulative(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def grade_probabilities(xw: np.ndarray, t: np.ndarray) -> np.ndarray:
    """P(grade = k) for k = 0 to GRADES."""
    above = np.concatenate((np.ones((len(xw), 1)), cumulative(xw[:, None] - t[None]), np.zeros((len(xw), 1))), axis=1)
    return above[:, :-1] - above[:, 1:]


def fit_ordinal(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by accelerated gradient descent on the penalised likelihood.
    Thresholds are a first one and logs of the gaps, so they stay in order."""
    d = x.shape[1]
    theta = np.zeros(d + GRADES)
    theta[d] = 2.0
    k = np.arange(GRADES)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, raw = theta[:d], theta[d:]
        t = raw[0] + np.concatenate(([0], np.cumsum(np.exp(raw[1:]))))
        # Products in the precision of x, so that it is never copied to another.
        xw = (x @ w.astype(x.dtype)).astype(np.float64)
        above = np.concatenate((np.ones((len(x), 1)), cumulative(xw[:, None] - t[None]), np.zeros((len(x), 1))), axis=1)
        p = np.maximum(above[np.arange(len(y)), y] - above[np.arange(len(y)), y + 1], 1e-12)
        slope = above * (1 - above)
        dz = (slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / p
        dt = np.array([-(slope[y == j, j] / p[y == j]).sum() + (slope[y == j - 1, j] / p[y == j - 1]).sum() for j in k + 1])
        gaps = [dt[j:].sum() * np.exp(raw[j]) for j in k[1:]]
        grad = np.concatenate((ridge * w - x.T @ dz.astype(x.dtype), [-dt.sum()], -np.array(gaps))) / len(y)
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    raw = theta[d:]
    return theta[:d], raw[0] + np.concatenate(([0], np.cumsum(np.exp(raw[1:]))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """docs: doc_id, text. labels: doc_id, label. The vocabulary, weights and thresholds."""
    empty = {"place": {}, "w": np.zeros(0), "t": np.arange(GRADES) + 700.0}
    chosen = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # At most `sample` ids travel; of rows that repeat an id one counts, so no more come back.
    rows = C.materialise(docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "toxicity_sample")
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return empty
    around = rows.where("label = 1").select("text").mapInArrow(_contexts, "term binary, before binary, after binary").distinct()
    sides = around.groupBy("term").agg(F.count_distinct("before").alias("b"), F.count_distinct("after").alias("a"))
    # The sample bounds the terms: each takes CONTEXTS words of it.
    terms = frozenset(bytes(r.term) for r in sides.where(F.least("a", "b") >= CONTEXTS).select("term").toLocalIterator())
    seen = rows.select("label", "text").mapInArrow(_frequencies(terms), "label int, term binary, n long").groupBy("term").pivot("label", [0, 1]).agg(F.sum("n"))
    odds = []
    for r in seen.toLocalIterator():
        a, b = (r["1"] or 0), (r["0"] or 0)
        odd = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
        z = odd / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        odds.append((-abs(z), bytes(r.term), odd, z))
    best = sorted(odds)[:TERMS]
    place = {term: i for i, (_, term, _, _) in enumerate(best)}
    marked = np.array([odd >= MARK_ODDS and z >= MARK_Z for _, _, odd, z in best], bool)
    if not place:
        return empty
    kept = rows.select("label", _sparse(place)("text").alias("f")).select("label", "f.i", "f.n").collect()  # at most `sample` rows
    x, y = np.zeros((len(kept), len(place)), np.float32), np.zeros(len(kept), np.int64)
    for k, r in enumerate(kept):
        x[k, r.i] = np.log1p(r.n)
        m = int(np.array(r.n)[marked[r.i]].sum()) if r.i else 0
        y[k] = 0 if not r.label else 1 + sum(m >= s for s in STEPS)
    w, t = fit_ordinal(x, y)
    return {"place": place, "w": w, "t": t}


def predict(text: Column, model: dict) -> Column:
    """Struct column (severity, grade, score)."""

    @F.arrow_udf(RESULT)
    @C.tidy
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place, w, t = model["place"], model["w"], model["t"]
        for texts in batches:
            xw = np.zeros(len(texts))
            for k, text in enumerate(texts.to_pylist()):
                i, n = sparse(text, place)
                xw[k] = (w[i] * np.log1p(n)).sum() if i else 0.0
            p = grade_probabilities(xw, t)
            out = zip((p @ np.arange(GRADES + 1)).tolist(), p.argmax(axis=1).tolist(), (1 - p[:, 0]).tolist())
            yield pa.array([dict(zip(("severity", "grade", "score"), r)) for r in out], _ARROW)

    return predicted(text)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of op10: doc_id, held_out, severity, grade, score, predicted (1 if score >= 0.5).
    Learned only from labels whose crc32(doc_id as text) mod 5 is not 0."""
    C.arrow_limits(docs.sparkSession)
    model = fit(docs.select("doc_id", "text"), labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label")))
    rows = docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.severity", "p.grade", "p.score")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
