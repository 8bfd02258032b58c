"""Gates and the first-fail quality cascade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank.config import Thresholds

COUNTERS = ("luminance", "sharpness", "uniformity", "texture")


def keep_labels(frames: DataFrame, labels: Sequence[str], label: str = "pred_label") -> DataFrame:
    return frames.where(F.col(label).isin(*labels))


def confident(frames: DataFrame, minimum: float = 0.40, column: str = "confidence") -> DataFrame:
    """Rows of at least `minimum`. Null and NaN fail; without the column everybody has 0.5."""
    if column not in frames.columns:
        frames = frames.withColumn(column, F.lit(0.5))
    return frames.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.col(column) >= minimum))


def threshold_table(spark: SparkSession, thresholds: Mapping[str, Thresholds], key: str = "priority") -> DataFrame:
    """One row per class: a table of the configuration's size."""
    return spark.createDataFrame([(k, t.min_luminance, t.min_sharpness, t.max_uniformity, t.min_texture, t.min_closeup) for k, t in thresholds.items()], f"{key} string, min_luminance double, min_sharpness double, max_uniformity double, min_texture double, min_closeup double")


def with_thresholds(frames: DataFrame, thresholds: Mapping[str, Thresholds], key: str, default: str) -> DataFrame:
    """Adds each row's limits; unknown classes get those of `default`. The configuration is broadcast."""
    table = threshold_table(frames.sparkSession, thresholds, key)
    base = thresholds[default]
    joined = frames.join(F.broadcast(table), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(getattr(base, c))) for c in ("min_luminance", "min_sharpness", "max_uniformity", "min_texture", "min_closeup")})


def reject_reason(unreadable: bool = True) -> Column:
    """The first limit a row fails, in the order of COUNTERS; null if none. Unreadable rows (null metrics) are 'unreadable';
    without `unreadable` a null metric fails no limit and the others decide."""
    null = F.col("luminance").isNull() | F.col("sharpness").isNull() | F.col("uniformity").isNull() | F.col("texture").isNull()
    return (
        F.when(null if unreadable else F.lit(False), "unreadable")
        .when(F.col("luminance") < F.col("min_luminance"), "luminance").when(F.col("sharpness") < F.col("min_sharpness"), "sharpness")
        .when(F.col("uniformity") > F.col("max_uniformity"), "uniformity").when(F.col("texture") < F.col("min_texture"), "texture")
    )


def cascade(frames: DataFrame, thresholds: Mapping[str, Thresholds], key: str = "priority", default: str = "P1_player_referee", unreadable: bool = True) -> DataFrame:
    """All rows with reject_reason; those that pass have null."""
    return with_thresholds(frames, thresholds, key, default).withColumn("reject_reason", reject_reason(unreadable))


def passed(cascaded: DataFrame) -> DataFrame:
    return cascaded.where(F.col("reject_reason").isNull())


def reasons(cascaded: DataFrame, *by: str) -> DataFrame:
    """Rows per reason; those that pass count as 'kept'."""
    return cascaded.groupBy(*by, F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def relaxed_floor(thresholds: Mapping[str, Thresholds]) -> Thresholds:
    """The loosest limit of any class: what fails it fails everywhere."""
    t = list(thresholds.values())
    return Thresholds(min(x.min_luminance for x in t), min(x.min_sharpness for x in t), max(x.max_uniformity for x in t), min(x.min_texture for x in t), min(x.min_closeup for x in t))


def above_floor(frames: DataFrame, thresholds: Mapping[str, Thresholds]) -> DataFrame:
    """Rows that some class could keep."""
    t = relaxed_floor(thresholds)
    return frames.where((F.col("luminance") >= t.min_luminance) & (F.col("sharpness") >= t.min_sharpness) & (F.col("uniformity") <= t.max_uniformity) & (F.col("texture") >= t.min_texture))


def quality_filter(frames: DataFrame, min_luminance: float = 60.0, min_sharpness: float = 150.0, max_uniformity: float = 0.8) -> DataFrame:
    """The stand-alone filter of fixed limits, with its reject_reason."""
    return frames.withColumn(
        "reject_reason", F.when(F.col("luminance") < min_luminance, "luminance").when(F.col("sharpness") < min_sharpness, "sharpness").when(F.col("uniformity") > max_uniformity, "uniformity"),
    )


def without_logo(frames: DataFrame, threshold: float = 0.50, p: str = "logo_p") -> DataFrame:
    """Rows whose logo probability is below the threshold; an unknown one counts as 0."""
    return frames.where(F.coalesce(p, F.lit(0.0)) < threshold)


def close_enough(frames: DataFrame) -> DataFrame:
    """Rows whose close-up ratio is not below their class's limit (column min_closeup)."""
    return frames.where(F.col("closeup") >= F.col("min_closeup"))


def eligible(frames: DataFrame, min_confidence: float, floor: float) -> DataFrame:
    return frames.where((F.coalesce("model_confidence", F.lit(0.0)) >= min_confidence) & (F.coalesce("final_score", F.lit(0.0)) >= floor))


def sharp_or_middle(samples: DataFrame, shots: DataFrame, key: Sequence[str], threshold: float = 200.0, blur: str = "blur") -> DataFrame:
    """Samples that are not blurred, and for each shot left without any its middle frame (column middle of `shots`).
    Result: key, frame_idx, fallback."""
    kept = samples.where(F.col(blur) >= threshold).select(*key, "frame_idx", F.lit(False).alias("fallback"))
    empty = shots.join(kept.select(*key).distinct(), list(key), "left_anti").select(*key, F.col("middle").alias("frame_idx"), F.lit(True).alias("fallback"))
    return kept.unionByName(empty)


def team_action(events: DataFrame, team: str, action: str) -> DataFrame:
    """Events with a video whose home or visiting team contains `team` and whose action contains `action`, in any case."""
    has = lambda c, s: F.lower(F.coalesce(c, F.lit(""))).contains(s.lower())
    game = F.col("playlist.game")
    return events.where((F.coalesce("playlist.video_url", F.lit("")) != "") & (has(game["home_team"]["name"], team) | has(game["visiting_team"]["name"], team)) & has(F.col("tag.action"), action))


def instances(scored: Column | str, threshold: float) -> Column:
    """Elements of an array of structs with score of at least the threshold."""
    return F.filter(F.col(scored) if isinstance(scored, str) else scored, lambda m: m["score"] >= threshold)
