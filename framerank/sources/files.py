"""Scans with fixed schemas, listings of pictures and videos, and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framerank import schemas
from framerank.functions import scalars as S

PICTURES, VIDEOS = "*.{jpg,jpeg,png}", "*.{mkv,mp4}"


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; NaN becomes null."""
    rows = spark.read.schema(schema).csv(path, header=True)
    return rows.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double")) for f in rows.schema if f.dataType.simpleString() == "double"})


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction log, with the frame's place in its file name as frame_idx."""
    return csv(spark, path, schemas.PREDICTIONS).withColumn("frame_idx", S.frame_index("frame_path"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.SEGMENTS).withColumns({"start_index": S.frame_index("start_frame"), "end_index": S.frame_index("end_frame")})


def gallery(spark: SparkSession, path: str) -> DataFrame:
    """File name and scores of a result file for display; missing scores are 0."""
    rows = csv(spark, path, schemas.KEYFRAMES).where(F.coalesce("saved_path", F.lit("")) != "")
    return rows.select(S.basename("saved_path").alias("filename"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("final_score", "w_iqa", "w_face", "w_emotion", "w_pose")))


def result_of(spark: SparkSession, path: str, filename: str) -> DataFrame:
    """The first row of a result file whose saved picture has this name."""
    return csv(spark, path, schemas.KEYFRAMES).where(S.basename("saved_path") == filename).limit(1)


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; what is malformed comes as nulls."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE")


def events(spark: SparkSession, path: str) -> DataFrame:
    """Events of saved API pages {"events": [...]}."""
    return json(spark, path, f"events array<struct<{schemas.EVENT.replace(' array', ': array').replace(' struct', ': struct').replace(' string', ': string').replace(' long', ': long').replace('::', ':')}>>").select(F.explode("events").alias("e")).select("e.*")


def coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, box) of ground-truth boxes."""
    raw = json(spark, path, schemas.COCO)
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    boxes = raw.select(F.explode("annotations").alias("a")).select("a.image_id", S.corners("a.bbox").alias("box"))
    return images.join(boxes, "image_id")


def pose_truth(spark: SparkSession, path: str, joints: Sequence[str]) -> DataFrame:
    """(path, joint, x, y) of known joints."""
    raw = json(spark, path, schemas.POSE_TRUTH).withColumn("path", F.input_file_name())
    points = raw.select("path", F.explode(F.map_values("keypoint_2d")).alias("k"))
    return points.select("path", F.col("k.name").alias("joint"), "k.x", "k.y").where(F.col("joint").isin(*joints))


def listing(spark: SparkSession, folder: str, pattern: str = PICTURES) -> DataFrame:
    """Paths and sizes below a folder, without reading the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")


def every(frames: DataFrame, video_fps: str, target_fps: float, index: str = "frame_idx") -> DataFrame:
    """Every k-th frame, k being the ratio of the rates."""
    return frames.where(F.col(index) % S.stride(video_fps, target_fps) == 0)


# Sinks ----------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, in place of what was there; an empty result keeps its header."""
    df.write.mode("overwrite").csv(path, header=True)


def write_by_segment(df: DataFrame, path: str) -> None:
    """One folder per segment (column folder)."""
    df.withColumn("folder", S.segment_folder("segment_id", "priority")).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """Metadata, counts per label, and counts per label and game."""
    write_csv(df, f"{path}/metadata")
    write_csv(df.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label"), f"{path}/label_counts")
    write_csv(df.groupBy("label", "game").agg(F.count("*").alias("frame_count")).orderBy("label", F.desc("frame_count"), "game"), f"{path}/game_distribution")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_scores(df: DataFrame, path: str, image: str = "image", score: str = "score") -> None:
    """Image and score with four decimals."""
    write_csv(df.select(image, F.format_string("%.4f", F.col(score)).alias("score")), path)


def write_pictures(chosen: DataFrame, folder: str) -> None:
    """Copies the file at input_path to the name of saved_path under a folder that every executor reaches. Files are
    written as a whole and named by content, so a repeated task writes the same again."""

    def copy(rows) -> None:
        from pyarrow import fs

        for row in rows:
            source, path = fs.FileSystem.from_uri(row.input_path)
            target, root = fs.FileSystem.from_uri(folder)
            target.create_dir(root, recursive=True)
            with source.open_input_stream(path, compression=None) as a, target.open_output_stream(f"{root}/{row.saved_path}", compression=None) as b:
                b.write(a.read())

    chosen.select("input_path", "saved_path").foreachPartition(copy)


def zip_results(folder: str, archive: str) -> list[str]:
    """All files below a local folder of results in one ZIP; their names."""
    import zipfile
    from pathlib import Path

    names = sorted(p for p in Path(folder).rglob("*") if p.is_file())
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for p in names:
            out.write(p, p.relative_to(folder))
    return [str(p.relative_to(folder)) for p in names]
