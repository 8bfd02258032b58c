"""Final choice: best scores first, none within a window of a better one that was taken."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy(index: np.ndarray, window: float, top_n: int) -> np.ndarray:
    """Positions taken, in order: a position is taken if no taken one's index is nearer than `window`."""
    taken: list[int] = []
    free = np.ones(len(index), bool)
    while len(taken) < top_n and free.any():
        i = int(np.argmax(free))
        taken.append(i)
        free &= np.abs(index - index[i]) >= window
        free[: i + 1] = False
    return np.array(taken, np.int64)


def suppress(pool: DataFrame, video: str, index: str, score: str, ties: Sequence[str], window: int = 18, top_n: int = 50) -> DataFrame:
    """Rows chosen per video, with rank from 1. Indices are whole numbers, so a choice blocks at most 2 window - 1 of
    them, and only the best row of an index can be chosen: the best top_n x (2 window - 1) indices of a video hold
    every choice. That limit is taken natively, so one task gets that many rows of a video at most."""
    columns = list(dict.fromkeys([video, index, score, *ties]))
    order = [F.col(score).desc(), *ties]
    best = pool.select(*columns).withColumn("__n", F.row_number().over(Window.partitionBy(video, index).orderBy(*order))).where("__n = 1").drop("__n")
    best = best.withColumn("__n", F.row_number().over(Window.partitionBy(video).orderBy(*order))).where(F.col("__n") <= top_n * (2 * window - 1))

    def chosen(table: pa.Table) -> pa.Table:
        table = table.sort_by("__n")
        found = greedy(table[index].to_numpy(), window, top_n)
        return table.take(pa.array(found)).drop_columns(["__n"]).append_column("rank", pa.array(np.arange(1, len(found) + 1, dtype=np.int32)))

    kinds = {f.name: f.dataType.simpleString() for f in pool.schema}
    picked = best.groupBy(video).applyInArrow(chosen, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", rank int")
    return picked


def select_final(pool: DataFrame, video: str, index: str, ties: Sequence[str], floor: float = 0.30, fallback: float | None = 0.20, min_confidence: float = 0.40, window: int = 18, top_n: int = 50, score: str = "final_score") -> DataFrame:
    """Choice above the strict floor, or above the fallback if that leaves fewer than top_n. What the strict floor
    lets in comes first in the order of the relaxed one, so the strict choice is a prefix of the relaxed choice, and
    the relaxed choice is the answer in both cases."""
    low = floor if fallback is None else min(floor, fallback)
    able = pool.where((F.coalesce("model_confidence", F.lit(0.0)) >= min_confidence) & (F.coalesce(score, F.lit(0.0)) >= low))
    return suppress(able, video, index, score, ties, window, top_n)
