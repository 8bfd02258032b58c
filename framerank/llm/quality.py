"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text becomes `len(NAMES)` statistics, transformed towards a bell shape. Per class the mean and
the covariance are sums over all learning rows, added up per task in Arrow and then by Spark; the
driver gets two small matrices. The covariances are shrunk towards the pooled one and its diagonal
and factored once by Cholesky; the factors go to the workers, where a score is the logistic function
of the difference of the two log densities (Mahalanobis distance and determinant) and the log odds
of the classes.

Cases: null and empty texts have the statistics of no words and get a score like any other. Labels
that are null or neither 0 nor 1 and labels of unknown documents are not learned; a document with
several labels is learned once for each. Without rows of both classes every score is the share of
label 1, 0.5 without labels. A null doc_id is not held out and has no label. Repeated rows stay.
Extra columns are ignored. Whole texts are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.llm import _common as C

NAMES = (
    "chars", "words", "word_length", "word_spread", "letters", "upper", "digits", "marks", "symbols", "distinct", "top_word", "repeats",
    "lines", "lines_distinct", "bars", "short_words", "sentence", "capitalised", "stopped", "longest_run",
)
#: Shares of the pooled covariance, and of its diagonal within that, and what each variance gets added.
POOLED, DIAGONAL, RIDGE = 0.2, 0.2, 1e-3
THRESHOLD = 0.3


def _logit(share: float, n: int) -> float:
    share = (share * n + 0.5) / (n + 1)
    return float(np.log(share / (1 - share)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text, in the order of NAMES."""
    text = text or ""
    n = len(text)
    words = text.split()
    k = len(words)
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    small = raw < 128
    count = np.bincount(raw[small], minlength=128)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    letters = upper + lower + int((raw >= 192).sum())
    marks = int(sum(count[ord(c)] for c in ".,;:!?'\"-()"))
    symbols = int(count[33:127].sum()) - upper - lower - digits - marks
    lengths = np.fromiter(map(len, words), np.int64, k)
    found = Counter(words)
    own_lines = [s for s in text.split("\n") if s.strip()]
    stops = int(count[46] + count[33] + count[63])
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    run = max((sum(1 for _ in g) for _, g in groupby(words)), default=0) if repeats else min(k, 1)
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(np.log(lengths.mean() + 1)) if k else 0.0, float(np.log1p(lengths.std())) if k else 0.0,
        _logit(letters / max(n, 1), n), _logit(upper / max(n, 1), n), _logit(digits / max(n, 1), n), _logit(marks / max(n, 1), n), _logit(symbols / max(n, 1), n),
        _logit(len(found) / max(k, 1), k), _logit(max(found.values(), default=0) / max(k, 1), k), _logit(repeats / max(k, 1), k),
        float(np.log1p(len(own_lines))), _logit(len(set(own_lines)) / max(len(own_lines), 1), len(own_lines)), _logit(found["|"] / max(k, 1), k),
        _logit(int((lengths <= 3).sum()) / max(k, 1), k), float(np.log1p(k / (stops + 1))), _logit(sum(w[0].isupper() for w in words) / max(k, 1), k),
        _logit(sum(s.rstrip()[-1] in ".!?" for s in own_lines) / max(len(own_lines), 1), len(own_lines)), float(np.log1p(run)),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
@C.tidy
def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))


def features(docs: DataFrame, text_col: str = "text") -> Column:
    C.arrow_limits(docs.sparkSession)
    return _statistics(F.col(text_col))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: the sums of (1, x)(1, x)' over a task's rows."""
    d = len(NAMES) + 1
    sums = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for batch in batches:
        if not batch.num_rows:
            continue
        label = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(len(label), -1)
        x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
        for c in sums:
            own = x[label == c]
            sums[c] += own.T @ own
    yield pa.RecordBatch.from_pydict({"label": [0, 1], "m": [sums[0].ravel(), sums[1].ravel()]}, schema=pa.schema([("label", pa.int32()), ("m", pa.list_(pa.float64()))]))


def fit(rows: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> dict:
    """rows: label (0 or 1) and x (features). Means, inverse Cholesky factors and constants of both classes."""
    parts = rows.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int").alias("label"), "x").mapInArrow(_moments, "label int, m array<double>")
    total = parts.select("label", F.posexplode("m").alias("pos", "v")).groupBy("label", "pos").agg(F.sum("v").alias("v"))
    d = len(NAMES) + 1
    m = np.zeros((2, d * d))
    for r in total.collect():  # 2 d^2 numbers
        m[r.label, r.pos] = r.v
    m = m.reshape(2, d, d)
    n = m[:, 0, 0]
    if not n.min() > 0:
        return {"share": float(n[1] / n.sum()) if n.sum() else 0.5}
    mean = m[:, 0, 1:] / n[:, None]
    scatter = m[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    shared = scatter.sum(axis=0) / n.sum()
    target = (1 - diagonal) * shared + diagonal * np.diag(np.diag(shared))
    out = {"mean": mean, "inverse": [], "constant": []}
    for c in (0, 1):
        cov = (1 - pooled) * scatter[c] / n[c] + pooled * target + RIDGE * np.eye(d - 1)
        factor = np.linalg.cholesky(cov)
        out["inverse"].append(np.linalg.inv(factor))
        out["constant"].append(float(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()))
    return out


def score_matrix(x: np.ndarray, model: dict) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"])
    logs = [model["constant"][c] - 0.5 * (((x - model["mean"][c]) @ model["inverse"][c].T) ** 2).sum(axis=1) for c in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def score(x: Column, model: dict) -> Column:
    """Probability of label 1 from a column of features."""

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array(score_matrix(rows.flatten().to_numpy().reshape(len(rows), len(NAMES)), model))

    return scored(x)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of op8: doc_id, held_out, score, predicted."""
    rows = C.materialise(docs.select("doc_id", held_out().alias("held_out"), features(docs).alias("x")), "quality_features")
    learned = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    model = fit(rows.where("not held_out").join(learned, "doc_id").select("label", "x"))
    scored = rows.select("doc_id", "held_out", score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
