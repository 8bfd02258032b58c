"""Evaluation of classifiers, detectors and poses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framerank.config import PDJ_THRESHOLDS
from framerank.functions import scalars as S


def classified(rows: DataFrame, logits: str, labels: Sequence | None = None) -> DataFrame:
    """Adds probs, pred (index of the first largest, or its label) and confidence."""
    out = rows.withColumn("probs", S.softmax(logits)).withColumn("pred", S.argmax("probs"))
    out = out.withColumn("confidence", F.array_max("probs"))
    return out if labels is None else out.withColumn("pred", F.get(F.array(*map(F.lit, labels)), F.col("pred")))


def mean_probability(rows: DataFrame, p: str, *by: str) -> DataFrame:
    """Mean of a probability column, overall or per group."""
    return rows.groupBy(*by).agg(F.avg(p).alias("mean_p"), F.count("*").alias("n"))


def latency(batches: DataFrame, seconds: str = "seconds", images: str = "images", warm_up: int = 10, order: str = "batch") -> DataFrame:
    """Mean milliseconds per image of timed batches, the first `warm_up` left out."""
    return batches.where(F.col(order) >= warm_up).agg((1000.0 * F.sum(seconds) / F.sum(images)).alias("ms_per_image"))


def confusion(rows: DataFrame, domain: Sequence, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Counts of every (truth, pred) of the domain. The grid has the domain's size squared."""
    spark = rows.sparkSession
    kind = rows.schema[truth].dataType.simpleString()
    one = spark.createDataFrame([(d, e) for d in domain for e in domain], f"{truth} {kind}, {pred} {kind}")
    counts = rows.groupBy(truth, pred).agg(F.count("*").alias("n"))
    return F.broadcast(one).join(counts, [truth, pred], "left").select(truth, pred, F.coalesce("n", F.lit(0)).alias("n"))


def report(rows: DataFrame, domain: Sequence, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class, and the rows accuracy, macro avg and weighted avg. A class that is
    never predicted has precision 0. Everything follows from the confusion matrix."""
    cells = confusion(rows, domain, truth, pred)
    hit = F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hit")),
        F.struct(F.col(pred).alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("c").agg(*(F.sum(x).alias(x) for x in ("support", "predicted", "hit")))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    per = sums.withColumns({"precision": ratio("hit", "predicted"), "recall": ratio("hit", "support")})
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    three = ("precision", "recall", "f1")
    weighted = lambda x: F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0))
    accuracy = F.coalesce(F.try_divide(F.sum("hit").cast("double"), F.sum("support").cast("double")), F.lit(0.0))
    # One aggregate over as many rows as there are classes gives the three summary rows.
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("n").alias("support"))
    sums = per.agg(F.sum("support").alias("n"), accuracy.alias("a"), *(F.avg(x).alias(f"m_{x}") for x in three), *(weighted(x).alias(f"w_{x}") for x in three))
    summary = F.array(row("macro avg", *(F.col(f"m_{x}") for x in three)), row("weighted avg", *(F.col(f"w_{x}") for x in three)), row("accuracy", *[F.col("a")] * 3))
    return per.select(F.col("c").cast("string").alias("class"), *three, "support").unionByName(sums.select(F.inline(summary)))


def pr_curve(rows: DataFrame, domain: Sequence, probs: str = "probs", truth: str = "truth") -> DataFrame:
    """One against the rest: precision, recall and F1 of every class at every distinct score (predicted if the score
    is at least the threshold). Scores are aggregated first, so running sums see each distinct score once."""
    classes = F.array(*(F.struct(F.lit(d).alias("class"), F.get(probs, F.lit(i)).alias("score")) for i, d in enumerate(domain)))
    scored = rows.select(truth, F.explode(classes).alias("s")).groupBy("s.class", "s.score").agg(F.count("*").alias("all"), F.count_if(F.col(truth) == F.col("s.class")).alias("hits"))
    down = Window.partitionBy("class").orderBy(F.desc("score"))
    whole = Window.partitionBy("class")
    out = scored.select("class", F.col("score").alias("threshold"), F.sum("hits").over(down).alias("tp"), F.sum("all").over(down).alias("n"), F.sum("hits").over(whole).alias("pos"))
    out = out.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pos").cast("double")), F.lit(0.0))})
    return out.select("class", "threshold", "precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)).alias("f1"))


#: Truths taken before those that are left are packed together.
PACK = 2048


class _Truths:
    """Truths of one image that are free, by id: five numbers each."""

    def __init__(self, ids: np.ndarray, boxes: np.ndarray, threshold: float):
        self.ids, self.boxes, self.threshold = ids, boxes, threshold
        self.size = (boxes[2] - boxes[0]) * (boxes[3] - boxes[1])
        self.free, self.taken = np.ones(len(ids), bool), 0

    def _near(self, box: Sequence[float], part: slice) -> np.ndarray:
        """scalars.iou() against the threshold; fmin and maximum treat NaN as Spark's least and greatest do, and NaN passes."""
        x1, y1, x2, y2 = box
        t = self.boxes[:, part]
        inter = np.maximum(0.0, np.fmin(x2, t[2]) - np.maximum(x1, t[0])) * np.maximum(0.0, np.fmin(y2, t[3]) - np.maximum(y1, t[1]))
        return ~(inter / ((x2 - x1) * (y2 - y1) + self.size[part] - inter + 1e-6) < self.threshold)

    def take(self, boxes: Sequence[Sequence[float]]):
        """The first free id that any of the boxes is near to, None if there is none. Most find one early, so blocks grow."""
        a, step = 0, 64
        while a < len(self.ids):
            part = slice(a, a + step)
            found = np.zeros(len(self.ids[part]), bool)
            for box in boxes:
                found |= self._near(box, part)
            found &= self.free[part]
            if found.any():
                got = self.ids[a + int(found.argmax())]
                # Repeated ids are one truth.
                same = slice(np.searchsorted(self.ids, got), np.searchsorted(self.ids, got, "right"))
                self.free[same] = False
                self.taken += same.stop - same.start
                if self.taken >= PACK:
                    self.ids, self.boxes, self.size = self.ids[self.free], self.boxes[:, self.free], self.size[self.free]
                    self.free, self.taken = np.ones(len(self.ids), bool), 0
                return int(got)
            a, step = a + step, min(4 * step, 65_536)
        return None


def match_boxes(truths: DataFrame, preds: DataFrame, image: str, threshold: float = 0.5) -> DataFrame:
    """truths: image, gt, box. preds: image, pred, box. In the order of pred, each takes the first free gt (by gt) whose
    IoU reaches the threshold: (image, pred, gt), gt null for a false positive. Which truths are free depends on all
    predictions before, so an image is one task's work; it holds the image's truths, and predictions pass by in sorted
    batches, so no list of candidates is made."""
    edges = ("x1", "y1", "x2", "y2")
    side = lambda of, n, gt, pred: of.select(image, F.lit(n).alias("__side"), gt.cast("bigint").alias("gt"), pred.alias("pred"), *(F.col("box")[c].cast("double").alias(c) for c in edges))
    kinds = {f.name: f.dataType.simpleString() for f in preds.schema}
    able = reduce(and_, (F.col(c).isNotNull() for c in (image, "gt", *edges)))
    both = side(truths, 0, F.col("gt"), F.lit(None).cast(kinds["pred"])).where(able).unionByName(side(preds, 1, F.lit(None), F.col("pred")))
    count = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(count, image).sortWithinPartitions(image, "__side", "gt", "pred")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        free: _Truths | None = None
        now, held, waiting, out = None, None, [], ([], [], [])

        def settle() -> None:
            """Rows of one id take one after another, each near whatever any of their boxes is near to."""
            boxes = [] if held is None else [r for r in waiting if None not in r]
            for _ in waiting:
                for column, v in zip(out, (now, held, free.take(boxes) if boxes and free else None)):
                    column.append(v)
            waiting.clear()

        def batch() -> pa.RecordBatch:
            columns = [pa.array(v, t) for v, t in zip(out, (image_type, pred_type, pa.int64()))]
            for v in out:
                v.clear()
            return pa.RecordBatch.from_arrays(columns, [image, "pred", "gt"])

        with np.errstate(all="ignore"):
            for b in batches:
                image_type, pred_type = b.schema.field(image).type, b.schema.field("pred").type
                images, sides = b[image].to_pylist(), b["__side"].to_numpy()
                # Spans of one image and side.
                cuts = [0, *(i for i in range(1, len(images)) if images[i] != images[i - 1] or sides[i] != sides[i - 1]), len(images)]
                for i, j in zip(cuts, cuts[1:]):
                    if i == j:
                        continue
                    span = b.slice(i, j - i)
                    if images[i] != now:
                        settle()
                        now, held, free = images[i], None, None
                        parts.clear()
                    if not sides[i]:
                        parts.append((span["gt"].to_numpy(), np.stack([span[c].to_numpy(zero_copy_only=False) for c in edges])))
                        continue
                    if parts:
                        free = _Truths(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1), threshold)
                        parts.clear()
                    for pred, *box in zip(span["pred"].to_pylist(), *(span[c].to_pylist() for c in edges)):
                        if pred != held:
                            settle()
                            held = pred
                        waiting.append(box)
                    if len(out[0]) >= 8192:
                        yield batch()
            settle()
            if out[0]:
                yield batch()

    return dealt.mapInArrow(matched, f"{image} {kinds[image]}, pred {kinds['pred']}, gt bigint")


def detection_scores(matches: DataFrame, truths: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall (1e-6 in the denominators)."""
    m = matches.agg(F.count("gt").alias("tp"), F.count_if(F.col("gt").isNull()).alias("fp"))
    both = m.join(truths.agg(F.count("*").alias("gts")))  # one row each
    tp, fn = F.col("tp"), F.col("gts") - F.col("tp")
    return both.select("tp", "fp", fn.alias("fn"), (tp / (tp + F.col("fp") + 1e-6)).alias("precision"), (tp / (tp + fn + 1e-6)).alias("recall"))


def joint_errors(truths: DataFrame, preds: DataFrame, image: str, norm: str = "norm") -> DataFrame:
    """truths: image, joint, x, y, norm. preds: image, joint, x, y. Distances over the norm; a predicted (0, 0) is missing."""
    seen = preds.where((F.col("x") != 0) | (F.col("y") != 0)).select(image, "joint", F.col("x").alias("px"), F.col("y").alias("py"))
    return truths.where(F.col(norm).isNotNull()).join(seen, [image, "joint"]).select(image, "joint", F.try_divide(S.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")), F.col(norm)).alias("error"))


def pdj(errors: DataFrame, thresholds: Sequence[float] = PDJ_THRESHOLDS) -> DataFrame:
    """Shares of joints with an error below each threshold (pdj_1...), their mean, and the area under them by
    trapezoids over the thresholds' range. One pass."""
    t = list(thresholds)
    shares = [F.count_if(F.col("error") < x) / F.count("*") for x in t]
    area = sum(((t[i + 1] - t[i]) * (shares[i] + shares[i + 1]) / 2 for i in range(1, len(t) - 1)), (t[1] - t[0]) * (shares[0] + shares[1]) / 2) / (t[-1] - t[0])
    return errors.agg(F.count("*").alias("joints"), *(s.alias(f"pdj_{i + 1}") for i, s in enumerate(shares)), (sum(shares[1:], shares[0]) / len(t)).alias("mean_pdj"), area.alias("auc"))


def pdj_by_joint(errors: DataFrame, threshold: float = 0.5) -> DataFrame:
    return errors.groupBy("joint").agg((F.count_if(F.col("error") < threshold) / F.count("*")).alias("pdj"))
