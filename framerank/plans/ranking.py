"""From a prediction log to ranked keyframes: one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framerank.config import CLASS_OF_LABEL, IGNORED_LABELS, RankConfig
from framerank.functions import scalars as S
from framerank.operators import filters, redundancy, scoring, segments, select


def extract_segments(frames: DataFrame, clip: Sequence[str], order: Sequence[str], classes: dict[str, str] = CLASS_OF_LABEL, ignored: Sequence[str] = IGNORED_LABELS, min_length: int = 5) -> DataFrame:
    """Numbered close-up segments: clip, pred_label, priority, num_frames, start_index, end_index, segment_id."""
    kept = segments.drop_ignored(frames, ignored)
    found = segments.runs(kept, clip, order, min_length=min_length)
    pairs = [F.lit(x) for kv in classes.items() for x in kv]
    found = found.withColumn("priority", F.try_element_at(F.create_map(*pairs), F.col("pred_label"))).where("priority is not null")
    return segments.number(found, ["priority", *clip], ["start_index"])


def candidates(frames: DataFrame, found: DataFrame, cfg: RankConfig, clip: Sequence[str]) -> DataFrame:
    """Frames in segments that pass the confidence gate, their class's cascade and the logo gate. Cheap gates come
    first; signal columns that are UDFs stay above them."""
    rows = filters.confident(frames.withColumnRenamed("pred_label", "frame_label"), cfg.min_confidence)
    scoped = list(clip) if cfg.clip_scoped else []
    side = found.select(*scoped, "segment_id", F.col("priority").alias("segment_priority"), "pred_label", "start_index", "end_index")
    inside = segments.frames_by_segment(rows, side, scoped).where(F.col("frame_label") == F.col("pred_label")).drop("pred_label", "start_index", "end_index")
    default = next(iter(cfg.thresholds))
    return filters.passed(filters.cascade(inside, cfg.thresholds, "segment_priority", default))


def rank_keyframes(frames: DataFrame, cfg: RankConfig = RankConfig(), *, clip: Sequence[str] = ("game_name", "clip_name"), order: Sequence[str] = ("frame_idx", "frame_path"), video: str = "video_id", path: str = "frame_path", classes: dict[str, str] = CLASS_OF_LABEL, ignored: Sequence[str] = IGNORED_LABELS, factors: dict[str, float] | None = None, ties: Sequence[str] = ("segment_id", "keyframe_priority", "minus_rank_value")) -> DataFrame:
    """frames: clip columns, video, frame_idx, path, pred_label, confidence, metrics (schemas.METRICS), signals
    (schemas.SIGNALS), embedding and aesthetic_score. Equal final scores go by `ties`, then by path. The result has the
    columns of schemas.KEYFRAMES."""
    found = extract_segments(frames, clip, order, classes, ignored, cfg.min_length)
    rows = candidates(frames, found, cfg, clip)
    if cfg.redundancy:
        rows = redundancy.hybrid(rows, "segment_id", "frame_idx", path, "embedding", "aesthetic_score", cfg.temporal_window, cfg.visual_threshold, "clip", cfg.top_per_cluster)
    rows = filters.close_enough(filters.without_logo(rows, cfg.logo_threshold))
    scored = scoring.score(scoring.with_tier(rows), cfg.weights, "segment_priority", factors or scoring.MULTIPLIER)
    scored = scored.withColumnRenamed("confidence", "model_confidence").withColumn("minus_rank_value", -F.col("rank_value"))
    chosen = select.select_final(scored, video, "frame_idx", [*ties, path], cfg.score_floor, cfg.fallback_floor, cfg.min_confidence, cfg.temporal_window, cfg.top_n)
    full = scored.join(chosen.select(video, path, "segment_id", "rank"), [video, path, "segment_id"])
    names = S.keyframe_name(F.col(video).cast("string"), F.col("rank"), F.col("segment_priority"), F.col("model_confidence"), F.col("final_score"))
    three = ("final_score", "score_pre_mult", "w_content", "w_iqa", "iqa_signal", "w_emotion", "emotion_signal", "w_face", "face_signal", "face_visibility", "w_pose", "pose_signal")
    return full.select(
        F.col(video).cast("string").alias("video_id"), "rank", F.col("segment_id").cast("int").alias("segment_id"), "segment_priority", "segment_multiplier", "keyframe_priority", "content_source",
        *(F.round(c, 4).alias(c) for c in three[:5]), F.round("model_confidence", 4).alias("model_confidence"), "num_faces", *(F.round(c, 4).alias(c) for c in three[5:7]), "emotion_label",
        *(F.round(c, 4).alias(c) for c in three[7:]), F.col(path).cast("string").alias("input_path"), names.alias("saved_path"),
    )


def analytics(frames: DataFrame, cfg: RankConfig, cascaded: DataFrame) -> DataFrame:
    """Counters per stage as rows (stage, n), each from one pass."""
    gate = frames.agg(F.count("*").alias("frames"), F.count_if(F.col("confidence") >= cfg.min_confidence).alias("confident"))
    stages = gate.select(F.explode(F.array(F.struct(F.lit("frames").alias("stage"), F.col("frames").alias("n")), F.struct(F.lit("confident").alias("stage"), F.col("confident").alias("n")))).alias("s")).select("s.*")
    return stages.unionByName(filters.reasons(cascaded).select(F.concat(F.lit("cascade:"), "reason").alias("stage"), "n"))
