"""Settings of the ranking pipeline. The constants are fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add

# Fixed values ---------------------------------------------------------------------------------

LABELS = (
    "Close-up_behind_the_goal", "Close-up_corner", "Close-up_player_or_field_referee", "Close-up_side_staff",
    "Main_camera_center", "Main_camera_left", "Main_camera_right", "Public",
)
IGNORED_LABELS = ("Main_camera_center", "Main_camera_left", "Main_camera_right", "Public")
CLASS_OF_LABEL = {
    "Close-up_player_or_field_referee": "P1_player_referee",
    "Close-up_corner": "P2_corner",
    "Close-up_side_staff": "P3_side_staff",
    "Close-up_behind_the_goal": "P4_behind_goal",
}
MULTIPLIER = {"P1_player_referee": 1.20, "P2_corner": 1.075, "P3_side_staff": 1.05, "P4_behind_goal": 1.00}
SIGNAL_WEIGHTS = {"iqa": 0.35, "face": 0.25, "emotion": 0.15, "pose": 0.15}
TIER_WEIGHTS = {1: {"face": 0.35, "emotion": 0.35, "pose": 0.30}, 2: {"face": 0.60, "emotion": 0.40}, 3: {"face": 0.50, "pose": 0.50}, 4: {"face": 1.0}}
SAMPLE_FACTOR = {
    "Main camera center": 0.2, "Close-up player or field referee": 0.1, "Close-up side staff": 3.0, "Close-up behind the goal": 5.0,
    "Main camera left": 5.0, "Main camera right": 5.0, "Close-up corner": 12.0, "Public": 15.0, "Main behind the goal": 4.0,
    "Goal line technology camera": 25.0, "Spider camera": 8.0, "Other": 10.0,
}
JOINTS = {
    "Head": 0, "Left Shoulder": 5, "Right Shoulder": 6, "Left Elbow": 7, "Right Elbow": 8, "Left Wrist": 9, "Right Wrist": 10,
    "Left Hip": 11, "Right Hip": 12, "Left Knee": 13, "Right Knee": 14, "Left Ankle": 15, "Right Ankle": 16,
}
PDJ_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5)


@dataclass(frozen=True)
class Thresholds:
    """Limits of one segment class."""

    min_luminance: float = 50.0
    min_sharpness: float = 15.0
    max_uniformity: float = 0.70
    min_texture: float = 5.0
    min_closeup: float = 0.15


THRESHOLDS = {
    "P1_player_referee": Thresholds(),
    "P2_corner": Thresholds(min_closeup=0.10),
    "P3_side_staff": Thresholds(min_texture=4.0),
    "P4_behind_goal": Thresholds(min_texture=4.0, min_closeup=0.10),
}


def normalise_weights(weights: dict[str, float]) -> dict[str, float]:
    """Shares of the sum; negative weights count as 0. All zero is an error."""
    weights = {k: max(0.0, float(v)) for k, v in weights.items()}
    # Added one by one: from Python 3.12 on sum() compensates, which moves the shares by a last bit and parts equal scores.
    total = reduce(add, weights.values(), 0.0)
    if not total:
        raise ValueError("all signal weights are zero")
    return {k: v / total for k, v in weights.items()}


@dataclass(frozen=True)
class RankConfig:
    """What a ranking run can be told. clamped() applies the limits of an input form."""

    fps: int = 12
    min_length: int = 5
    min_segments_per_clip: int = 6
    min_confidence: float = 0.40
    score_floor: float = 0.30
    fallback_floor: float = 0.20
    temporal_window: int = 18
    visual_threshold: float = 0.90
    logo_threshold: float = 0.50
    top_n: int = 50
    top_per_cluster: int = 1
    redundancy: str | None = "hybrid"
    clip_scoped: bool = True
    weights: dict[str, float] = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))
    thresholds: dict[str, Thresholds] = field(default_factory=lambda: dict(THRESHOLDS))

    def clamped(self) -> RankConfig:
        """Frame rate 1 to 24, thresholds 0 to 1, weights not negative; all-zero weights become the defaults."""
        from dataclasses import replace

        weights = {k: max(0.0, float(v)) for k, v in self.weights.items()}
        return replace(
            self, fps=min(24, max(1, int(self.fps))), visual_threshold=min(1.0, max(0.0, self.visual_threshold)),
            logo_threshold=min(1.0, max(0.0, self.logo_threshold)), weights=weights if any(weights.values()) else dict(SIGNAL_WEIGHTS),
        )
