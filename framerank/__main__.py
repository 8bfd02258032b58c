"""python -m framerank: ranks the frames of a prediction log.

--predictions is a CSV of schemas.PREDICTIONS, --signals a Parquet table of frame_path, metrics, signals, embedding
and aesthetic_score. The ranked keyframes are written as CSV."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import functions as F

from framerank.config import SIGNAL_WEIGHTS, RankConfig
from framerank.functions import scalars as S
from framerank.plans.ranking import rank_keyframes
from framerank.session import session
from framerank.sources import files


def config(args: Sequence[str] | None) -> tuple[argparse.Namespace, RankConfig]:
    """Parsed arguments and their clamped settings; an unknown argument ends with status 2."""
    p = argparse.ArgumentParser(prog="framerank", description="Rank the frames of a prediction log.")
    for name in ("predictions", "signals", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--video_id", help="for frames whose path names no video")
    for name, kind, value in (("fps", int, 12), ("visual_threshold", float, 0.90), ("logo_p", float, 0.50), ("min_length", int, 5), ("top_n", int, 50)):
        p.add_argument(f"--{name}", type=kind, default=value)
    for name, value in SIGNAL_WEIGHTS.items():
        p.add_argument(f"--w_{name}", type=float, default=value)
    p.add_argument("--no_redundancy", action="store_true")
    a = p.parse_args(args)
    cfg = RankConfig(
        fps=a.fps, visual_threshold=a.visual_threshold, logo_threshold=a.logo_p, min_length=a.min_length, top_n=a.top_n,
        redundancy=None if a.no_redundancy else "hybrid", weights={k: getattr(a, f"w_{k}") for k in SIGNAL_WEIGHTS},
    )
    return a, cfg.clamped()


def main(args: Sequence[str] | None = None) -> None:
    a, cfg = config(args)
    spark = session()
    video = F.coalesce(S.video_id("frame_path"), F.lit(a.video_id or "unknown"))
    log = files.predictions(spark, a.predictions).withColumn("video_id", video)
    files.write_csv(rank_keyframes(log.join(spark.read.parquet(a.signals), "frame_path"), cfg), a.output)


if __name__ == "__main__":
    main()
