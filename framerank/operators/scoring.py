"""Tiers, validity gates and the weighted score, all as expressions of one projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framerank.config import MULTIPLIER, SIGNAL_WEIGHTS, TIER_WEIGHTS, normalise_weights
from framerank.functions.scalars import clip01

# What makes a signal good.
FACE_QUALITY, FACE_AREA_MIN, FACE_AREA_MAX, EMOTION, POSE = 0.40, 0.02, 0.40, 0.20, 0.15
VALID_FACE, VALID_POSE, VALID_EMOTION = 0.60, 0.01, 0.01


def _mix(tier: int, face: Column, emotion: Column, pose: Column) -> Column:
    w = TIER_WEIGHTS[tier]
    parts = [w[name] * signal for name, signal in (("face", face), ("emotion", emotion), ("pose", pose)) if name in w]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def by_tier(tier: Column, face: Column, emotion: Column, pose: Column) -> Column:
    return F.when(tier == 1, _mix(1, face, emotion, pose)).when(tier == 2, _mix(2, face, emotion, pose)).when(tier == 3, _mix(3, face, emotion, pose)).otherwise(_mix(4, face, emotion, pose))


def tier() -> Column:
    """1 face, emotion and pose; 2 face and emotion; 3 a pose (also without a good face); 4 the rest."""
    face = (F.col("num_faces") > 0) & (F.col("face_quality") >= FACE_QUALITY) & F.col("face_area").between(FACE_AREA_MIN, FACE_AREA_MAX)
    emotion, pose = F.col("emotion_intensity") > EMOTION, F.col("pose_score") > POSE
    return F.when(face & emotion & pose, 1).when(face & emotion, 2).when(pose, 3).otherwise(4)


def with_tier(frames: DataFrame) -> DataFrame:
    """Adds keyframe_priority and rank_value, from raw signals."""
    ranked = frames.withColumn("keyframe_priority", tier())
    return ranked.withColumn("rank_value", by_tier(F.col("keyframe_priority"), F.col("face_quality"), F.col("emotion_intensity"), F.col("pose_score")))


def gated() -> dict[str, Column]:
    """Signals that are 0 unless their detection can be trusted."""
    face = (F.col("num_faces") > 0) & (F.col("face_det_score") > VALID_FACE)
    return {
        "face_signal": F.when(face, F.col("face_quality")).otherwise(0.0),
        "pose_signal": F.when(F.col("pose_score") > VALID_POSE, F.col("pose_score")).otherwise(0.0),
        "emotion_signal": F.when(face & (F.col("emotion_intensity") > VALID_EMOTION), F.col("emotion_intensity")).otherwise(0.0),
        "iqa_signal": clip01(F.coalesce("iqa_norm", F.lit(0.0))),
    }


def multiplier(priority: Column | str, table: Mapping[str, float] = MULTIPLIER) -> Column:
    """A class's factor, 1 for any other class."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    key = F.col(priority) if isinstance(priority, str) else priority
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(1.0))


def score(frames: DataFrame, weights: Mapping[str, float] = SIGNAL_WEIGHTS, priority: str = "segment_priority", factors: Mapping[str, float] = MULTIPLIER) -> DataFrame:
    """Adds the gated signals, their weighted parts, score_pre_mult, final_score and what the content is. The tier
    (column keyframe_priority) tells the content but is no part of the score."""
    w = normalise_weights(dict(weights))
    out = frames.withColumns(gated())
    out = out.withColumns({f"w_{k}": F.lit(w[k]) * F.col(f"{k}_signal") for k in ("iqa", "face", "emotion", "pose")})
    out = out.withColumn("score_pre_mult", F.col("w_iqa") + F.col("w_face") + F.col("w_emotion") + F.col("w_pose"))
    t = F.col("keyframe_priority")
    pose, emotion = (F.coalesce(c, F.lit("none")) for c in ("pose_label", "emotion_label"))
    source = F.when(t == 1, F.concat(F.lit("celebration:"), pose)).when(t == 2, F.concat(F.lit("expressive:"), emotion)).when(t == 3, F.concat(F.lit("pose:"), pose)).otherwise("face_only")
    content = clip01(by_tier(t, F.col("face_signal"), F.col("emotion_signal"), F.col("pose_signal")))
    return out.withColumns({
        "segment_multiplier": multiplier(priority, factors), "final_score": F.col("score_pre_mult") * multiplier(priority, factors),
        "content_source": source, "content_signal": content, "w_content": F.lit(0.0),
    })
