"""Class runs over ordered frames, their numbering, and matching frames to segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_ignored(frames: DataFrame, ignored: Sequence[str], label: str = "pred_label") -> DataFrame:
    """Without the ignored labels. Done before runs(), because it decides which rows are neighbours."""
    return frames.where(~F.col(label).isin(*ignored))


def with_runs(frames: DataFrame, clip: Sequence[str], order: Sequence[str], label: str = "pred_label") -> DataFrame:
    """Adds `run`, which grows by 1 within a clip wherever the label differs from the row before. One sort by clip."""
    by = Window.partitionBy(*clip).orderBy(*order)
    return frames.withColumn("run", F.sum(F.when(F.col(label).eqNullSafe(F.lag(label).over(by)), 0).otherwise(1)).over(by))


def runs(frames: DataFrame, clip: Sequence[str], order: Sequence[str], index: str = "frame_idx", label: str = "pred_label", min_length: int = 3) -> DataFrame:
    """Maximal runs of at least `min_length` rows of one label: clip, label, num_frames, start_index, end_index.
    The clip partitioning of the window serves the aggregate too."""
    cut = with_runs(frames, clip, order, label)
    return cut.groupBy(*clip, "run", label).agg(F.count("*").alias("num_frames"), F.min(index).alias("start_index"), F.max(index).alias("end_index")).where(F.col("num_frames") >= min_length).drop("run")


#: Ranges that rows are numbered in, at most: as many as the session has shuffle partitions.
RANGES = 256


def number(segments: DataFrame, groups: Sequence[str], order: Sequence[str] = (), out: str = "segment_id") -> DataFrame:
    """Numbers rows from 0 by (groups, order), nulls first. Rows are numbered within ranges between the keys of least
    hashes, so a group of any size is spread too; only one count per range meets in a single task."""
    key = F.struct(*groups, *order)
    ranges = max(1, min(RANGES, int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    drawn = segments.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(ranges - 1)
    cuts = drawn.agg(F.array_sort(F.collect_list("k"))).scalar()
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c <= key)), F.lit(0))
    placed = segments.withColumn("__cuts", cuts).withColumn("__range", below).drop("__cuts")
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*groups, *order))
    return placed.withColumn("__place", place).join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.col("__place") - 1).drop("__range", "__place", "__start")


def shares(segments: DataFrame, label: str = "pred_label") -> DataFrame:
    """Segments per class and their share of all in percent."""
    counts = segments.groupBy(label).agg(F.count("*").alias("segments"))
    return counts.withColumn("share_pct", 100.0 * F.col("segments") / F.sum("segments").over(Window.partitionBy()))


def below_minimum(clips: DataFrame, segments: DataFrame, clip: Sequence[str], minimum: int) -> DataFrame:
    """Clips with fewer than `minimum` segments, those without any included."""
    counts = segments.groupBy(*clip).agg(F.count("*").alias("segments"))
    return clips.select(*clip).distinct().join(counts, list(clip), "left").withColumn("segments", F.coalesce("segments", F.lit(0))).where(F.col("segments") < minimum)


def _binned(segments: DataFrame, width: int) -> DataFrame:
    return segments.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start_index") / width), F.floor(F.col("end_index") / width))))


def _within() -> Column:
    return F.col("frame_idx").between(F.col("start_index"), F.col("end_index"))


def frames_by_segment(frames: DataFrame, segments: DataFrame, clip: Sequence[str] = (), width: int = 1024) -> DataFrame:
    """Range join start_index <= frame_idx <= end_index. Both sides are cut into bins of `width` indices, so it is
    an equi join on (clip, bin). Without clip columns frames of any clip match."""
    left = frames.withColumn("__bin", F.floor(F.col("frame_idx") / width))
    return left.join(_binned(segments, width), [*clip, "__bin"]).where(_within()).drop("__bin")


def count_by_label(frames: DataFrame, segments: DataFrame, label: str = "pred_label", width: int = 1024) -> DataFrame:
    """Pairs of a frame of any clip and a segment that it lies in, counted per label of the segment; labels without any
    are left out. Pairs grow with the square of the input, so none is made: a segment has the frames from its start on
    less those after its end. Both are counted per index first and ranked within bins of `width` indices; one count per
    bin meets in a single task."""
    edge = lambda index, n: F.struct(index.cast("bigint").alias("__at"), F.lit(n).cast("bigint").alias("__n"))
    both = F.explode(F.array(edge(F.col("start_index"), 1), edge(F.col("end_index") + 1, -1)))
    edges = segments.where("start_index <= end_index").select(label, both.alias("__edge")).groupBy(label, "__edge.__at").agg(F.sum("__edge.__n").alias("__n"))
    counts = frames.where("frame_idx is not null").groupBy(F.col("frame_idx").cast("bigint").alias("__at")).agg(F.count("*").alias("__frames"))
    place = F.floor(F.col("__at") / width)
    # Frames before a bin, for the bins of frames and of edges alike.
    bins = counts.select(place.alias("__bin"), "__frames").unionByName(edges.select(place.alias("__bin"), F.lit(0).cast("bigint").alias("__frames"))).groupBy("__bin").agg(F.sum("__frames").alias("__all"))
    bins = bins.select("__bin", (F.sum("__all").over(Window.orderBy("__bin")) - F.col("__all")).alias("__base"))
    points = counts.withColumns({label: F.lit(None).cast(segments.schema[label].dataType), "__n": F.lit(0).cast("bigint")}).unionByName(edges.withColumn("__frames", F.lit(0).cast("bigint")))
    # Frames before a point within its bin: rows of the same index are peers, and the frames among them don't count.
    by = Window.partitionBy("__bin").orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    points = points.withColumn("__bin", place).withColumn("__before", F.coalesce(F.sum("__frames").over(by), F.lit(0))).where("__n <> 0")
    before = points.join(bins, "__bin").withColumn("__before", F.col("__before") + F.col("__base"))
    return before.groupBy(label).agg(F.sum(-F.col("__n") * F.col("__before")).alias("frames")).where("frames > 0")


def frames_in_segments(frames: DataFrame, segments: DataFrame, clip: Sequence[str] = (), width: int = 1024) -> DataFrame:
    """Semi join: frames that lie in any segment, each once."""
    left = frames.withColumn("__bin", F.floor(F.col("frame_idx") / width)).alias("f")
    right = _binned(segments.select(*clip, "start_index", "end_index"), width).alias("s")
    on = F.col("f.__bin") == F.col("s.__bin")
    for c in clip:
        on &= F.col(f"f.{c}") == F.col(f"s.{c}")
    return left.join(right, on & F.col("f.frame_idx").between(F.col("s.start_index"), F.col("s.end_index")), "left_semi").drop("__bin")
