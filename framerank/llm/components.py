"""Connected components of an edge table, by alternating large and small stars.

Every round is joins and aggregates over the edges that are left; nothing is collected but one
count and checksum. A hub's edges are never gathered in one row: its minimum is an aggregate with
map-side partials, and the join that hands it back can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framerank.llm import _common as C


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """From edges (a, b), in any direction and with repeats: (node, root) for each node that is not
    the least of its component; root is the least node. No edges give no rows."""
    now = C.materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = C.materialise(_small_star(_large_star(now)), "edges")
        C.discard(now)
        now, was, seen = after, seen, _print(after)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
