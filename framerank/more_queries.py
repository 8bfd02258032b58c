"""Further registered queries with their SQL: sources and sinks (written to the shared folder and read back), names,
faces, colours, gates and metrics. The tables stand in for the library's inputs as in framerank.queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from framerank.functions import scalars as S
from framerank.functions import signals
from framerank.operators import dataset, filters, metrics, segments
from framerank.queries import FRAMES, ORDER, RUNS, _frames, _read, _runs, query
from framerank.session import shared_folder
from framerank.sources import files
from framerank.streaming import live

# Gates and metrics ------------------------------------------------------------------------------


@query(f"WITH {FRAMES} SELECT event_id, pred_label FROM frames WHERE pred_label IN ('P1', 'P2')")
def kept_labels(spark, sf_dir):
    return filters.keep_labels(_frames(spark, sf_dir), ["P1", "P2"]).select("event_id", "pred_label")


@query(f"WITH {FRAMES} SELECT event_id FROM frames WHERE coalesce(CASE WHEN event_id % 9 > 0 THEN confidence END, 0) >= 0.4e0 AND coalesce(CASE WHEN event_id % 13 > 0 THEN event_id % 100 / 100e0 END, 0) >= 0.25e0")
def eligible_frames(spark, sf_dir):
    rows = _frames(spark, sf_dir).withColumns({"model_confidence": F.when(F.col("event_id") % 9 > 0, F.col("confidence")), "final_score": F.when(F.col("event_id") % 13 > 0, F.col("event_id") % 100 / 100.0)})
    return filters.eligible(rows, 0.4, 0.25).select("event_id")


@query("""SELECT coalesce(CASE WHEN l_quantity * 3e0 < 60 THEN 'luminance' WHEN l_extendedprice / 100e0 < 150 THEN 'sharpness' WHEN l_discount * 10e0 > 0.8e0 THEN 'uniformity' END, 'kept') AS reason, count(*) AS n
FROM lineitem GROUP BY 1""")
def fixed_quality_filter(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 3.0).alias("luminance"), (F.col("l_extendedprice") / 100.0).alias("sharpness"), (F.col("l_discount") * 10.0).alias("uniformity"))
    return filters.reasons(filters.quality_filter(rows))


@query("""SELECT CASE WHEN l_linenumber = 4 THEN 'unreadable' WHEN l_quantity * 3e0 < 30 THEN 'luminance' WHEN l_extendedprice / 100e0 < 50 THEN 'sharpness' WHEN l_discount * 10e0 > 0.95e0 THEN 'uniformity'
WHEN l_tax * 100e0 < 1 THEN 'texture' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def unreadable_frames(spark, sf_dir):
    """Frames without metrics fail before any limit."""
    readable = F.col("l_linenumber") != 4
    rows = _read(spark, sf_dir, "lineitem").select(
        F.when(readable, F.col("l_quantity") * 3.0).alias("luminance"), (F.col("l_extendedprice") / 100.0).alias("sharpness"), (F.col("l_discount") * 10.0).alias("uniformity"), (F.col("l_tax") * 100.0).alias("texture"),
        F.lit(30.0).alias("min_luminance"), F.lit(50.0).alias("min_sharpness"), F.lit(0.95).alias("max_uniformity"), F.lit(1.0).alias("min_texture"),
    )
    return filters.reasons(rows.withColumn("reject_reason", filters.reject_reason()))


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_discount * 10e0 >= 0.5e0) AS n FROM lineitem GROUP BY 1")
def scored_instances(spark, sf_dir):
    """Masks of a picture from a score on. An order's lines are at most seven."""
    rows = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_discount") * 10.0).alias("score"))).alias("masks"))
    return rows.select("l_orderkey", F.size(filters.instances("masks", 0.5)).cast("bigint").alias("n"))


@query("SELECT round(1000e0 * sum(value / 1000e0) / sum(event_id % 8 + 1), 9) AS ms_per_image FROM events WHERE event_id >= 10")
def inference_latency(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), (F.col("value") / 1000.0).alias("seconds"), (F.col("event_id") % 8 + 1).alias("images"))
    return metrics.latency(rows).select(F.round("ms_per_image", 9).alias("ms_per_image"))


@query("SELECT event_type AS label, round(avg(value / (value + 30e0)), 9) AS mean_p, count(*) AS n FROM events GROUP BY 1")
def mean_probability(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("label"), (F.col("value") / (F.col("value") + 30.0)).alias("p"))
    return metrics.mean_probability(rows, "p", "label").select("label", F.round("mean_p", 9).alias("mean_p"), "n")


@query(f"WITH {FRAMES}, {RUNS} SELECT clip_id, pred_label, num_frames, start_index, end_index FROM runs WHERE pred_label IN ('P1', 'P2')")
def segments_of_two_classes(spark, sf_dir):
    """One list of segments from those of each class."""
    found = _runs(spark, sf_dir).select("clip_id", "pred_label", "num_frames", "start_index", "end_index")
    return filters.keep_labels(found, ["P1"]).unionByName(filters.keep_labels(found, ["P2"]))


@query(f"WITH {FRAMES} SELECT event_id FROM frames WHERE frame_idx % greatest(1, CAST(round_even((20 + event_id % 40) / 5e0, 0) AS INTEGER)) = 0")
def every_kth_frame(spark, sf_dir):
    return files.every(_frames(spark, sf_dir).withColumn("fps", 20.0 + F.col("event_id") % 40), "fps", 5.0).select("event_id")


@query("""SELECT event_id, CASE event_id % 7 WHEN 1 THEN '[STEP 1]' WHEN 2 THEN '[STEP 2]' WHEN 3 THEN '[STEP 3]' WHEN 4 THEN '[STEP 4]' WHEN 5 THEN 'Complete' END AS stage,
CASE event_id % 7 WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 75 WHEN 4 THEN 90 WHEN 5 THEN 100 END AS progress FROM events""")
def progress_of_lines(spark, sf_dir):
    mark = F.get(F.array(*map(F.lit, ("", "[STEP 1]", "[STEP 2]", "[STEP 3]", "[STEP 4]", "[DONE]", "done"))), (F.col("event_id") % 7).cast("int"))
    return _read(spark, sf_dir, "events").select("event_id", live.progress(F.concat(F.lit("12:00 "), mark, F.lit(" of a run"))).alias("p")).select("event_id", "p.*")


# Names and texts --------------------------------------------------------------------------------

NAMES = """names AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'plain.jpg' ELSE o_orderkey || '_team' || o_custkey || '_cup_' || o_orderkey % 7 || '_H' || (o_orderkey % 2 + 1) || '_x.jpg' END AS name FROM orders)"""


def _named(spark, sf_dir):
    k = F.col("o_orderkey")
    name = F.concat_ws("_", k, F.concat(F.lit("team"), F.col("o_custkey")), F.lit("cup"), k % 7, F.concat(F.lit("H"), k % 2 + 1), F.lit("x.jpg"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 5 == 0, F.lit("plain.jpg")).otherwise(name).alias("name"))


@query(rf"""WITH {NAMES}, r AS (SELECT *, regexp_extract(name, '^[^_]*_([^_]*_.*)$', 1) AS rest FROM names), g AS (SELECT *, regexp_replace(rest, '(^|_)\d+_H.*$', '') AS game FROM r)
SELECT o_orderkey, CASE WHEN rest <> '' AND game <> '' THEN game ELSE 'unknown' END AS game, TRY_CAST(regexp_replace(name, '\D', '', 'g') AS BIGINT) AS idx FROM g""")
def game_names(spark, sf_dir):
    return _named(spark, sf_dir).select("o_orderkey", S.game_of_file("name").alias("game"), S.concatenated_index("name").alias("idx"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey % 10 || CASE WHEN o_orderkey % 2 = 0 THEN ' - ' ELSE '–' END || o_orderkey % 4 AS score,
  CASE WHEN o_orderkey % 3 = 0 THEN right('000' || lower(hex(o_custkey % 4096)), 3) ELSE right('000000' || lower(hex(o_orderkey * 7919 % 16777216)), 6) END AS code FROM orders),
f AS (SELECT *, CASE WHEN length(code) = 3 THEN code[1] || code[1] || code[2] || code[2] || code[3] || code[3] ELSE code END AS full6 FROM c)
SELECT o_orderkey, trim(string_split_regex(score, '[-–]')[1]) AS home, trim(string_split_regex(score, '[-–]')[2]) AS visiting,
  CAST('0x' || substr(full6, 1, 2) AS INTEGER) AS r, CAST('0x' || substr(full6, 3, 2) AS INTEGER) AS g, CAST('0x' || substr(full6, 5, 2) AS INTEGER) AS b FROM f""")
def scores_and_colours(spark, sf_dir):
    k = F.col("o_orderkey")
    score = F.concat((F.col("o_custkey") % 10).cast("string"), F.when(k % 2 == 0, " - ").otherwise("–"), (k % 4).cast("string"))
    code = F.when(k % 3 == 0, F.lower(F.lpad(F.hex(F.col("o_custkey") % 4096), 3, "0"))).otherwise(F.lower(F.lpad(F.hex(k * 7919 % 16777216), 6, "0")))
    return _read(spark, sf_dir, "orders").select("o_orderkey", S.score_pair(score).alias("s"), S.colour(F.concat(F.lit("#"), code)).alias("c")).select("o_orderkey", "s.*", "c.*")


ANNOTATED = """SELECT l_orderkey, l_linenumber % 4 AS half, CASE WHEN l_partkey % 6 = 0 THEN (l_partkey || '.5') ELSE CAST(l_partkey AS VARCHAR) END AS position, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE ' ' || l_shipmode || ' ' END AS label FROM lineitem"""


@query(f"""WITH a AS ({ANNOTATED.replace("l_shipmode", "l_returnflag")}) SELECT l_orderkey, CAST(half AS INTEGER) AS half, CAST(position AS BIGINT) / 1000e0 AS seconds, CASE WHEN label = '' THEN 'unknown' ELSE trim(label) END AS label
FROM a WHERE half IN (1, 2) AND position NOT LIKE '%.%'""")
def well_formed_annotations(spark, sf_dir):
    """An order's lines are its annotations: at most seven."""
    p = F.col("l_partkey")
    one = F.struct(
        F.concat((F.col("l_linenumber") % 4).cast("string"), F.lit(" - 01:02")).alias("gameTime"), F.when(p % 4 == 0, "").otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.lit(" "))).alias("label"),
        F.when(p % 6 == 0, F.concat(p.cast("string"), F.lit(".5"))).otherwise(p.cast("string")).alias("position"),
    )
    raw = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("annotations"))
    return dataset.annotations(raw).select("l_orderkey", "half", "seconds", "label")


@query("SELECT o_orderkey, o_orderstatus AS game, o_orderpriority AS label, 'f' || o_orderkey || '.jpg' AS filename FROM orders")
def folder_scan(spark, sf_dir):
    path = F.concat_ws("/", F.lit("root"), "o_orderstatus", "o_orderpriority", F.concat(F.lit("f"), F.col("o_orderkey"), F.lit(".jpg")))
    rows = _read(spark, sf_dir, "orders").select(path.alias("path"))
    return dataset.folder_scan(rows).withColumn("o_orderkey", F.regexp_extract("filename", r"(\d+)", 1).cast("bigint"))


@query("SELECT 'o' || l_orderkey AS folder FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3")
def complete_folders(spark, sf_dir):
    path = F.concat(F.lit("o"), F.col("l_orderkey"), F.lit("/part"), F.col("l_linenumber"), F.lit(".csv"))
    return dataset.complete_folders(_read(spark, sf_dir, "lineitem").select(path.alias("path")), ["part1.csv", "part2.csv", "part3.csv"])


# Sources and sinks ------------------------------------------------------------------------------


@query("SELECT 'img_' || event_id || '.jpg' AS image, printf('%.4f', value / 7e0) AS score FROM events")
def score_file(spark, sf_dir):
    path = shared_folder(spark)
    rows = _read(spark, sf_dir, "events").select(F.concat(F.lit("img_"), F.col("event_id"), F.lit(".jpg")).alias("image"), (F.col("value") / 7.0).alias("score"))
    files.write_scores(rows, path)
    return files.csv(spark, path, "image string, score string")


@query(f"""WITH {FRAMES} SELECT 'g' || clip_id AS game_name, printf('a/frame_%06d.jpg', frame_idx) AS frame_path, pred_label, CASE WHEN event_id % 11 > 0 THEN confidence END AS confidence, frame_idx FROM frames""")
def prediction_file(spark, sf_dir):
    """A log with NaN written and read as CSV."""
    path = shared_folder(spark)
    rows = _frames(spark, sf_dir)
    files.write_csv(rows.select(F.concat(F.lit("g"), F.col("clip_id")).alias("game_name"), F.col("clip_id").cast("string").alias("clip_name"), F.format_string("a/frame_%06d.jpg", "frame_idx").alias("frame_path"), "pred_label", F.when(F.col("event_id") % 11 > 0, F.col("confidence")).otherwise(float("nan")).alias("confidence")), path)
    return files.predictions(spark, path).select("game_name", "frame_path", "pred_label", "confidence", "frame_idx")


@query(f"""WITH {FRAMES}, {RUNS} SELECT CAST(row_number() OVER (ORDER BY pred_label, clip_id, start_index) - 1 AS INTEGER) AS segment_id, CAST(clip_id AS VARCHAR) AS clip_name, pred_label AS priority, CAST(num_frames AS INTEGER) AS num_frames, start_index, end_index FROM runs""")
def segment_file(spark, sf_dir):
    """Numbered segments written and read as CSV."""
    path = shared_folder(spark)
    rows = segments.number(_runs(spark, sf_dir), ["pred_label", "clip_id"], ["start_index"])
    name = lambda c: F.format_string("f_%08d.jpg", c)
    files.write_csv(rows.select("segment_id", F.lit("g").alias("game_name"), F.col("clip_id").alias("clip_name"), F.col("pred_label").alias("priority"), "num_frames", name("start_index").alias("start_frame"), name("end_index").alias("end_frame")), path)
    return files.segments(spark, path).select("segment_id", "clip_name", "priority", "num_frames", "start_index", "end_index")


def _keyframe_file(spark, sf_dir) -> str:
    from framerank import schemas

    path = shared_folder(spark)
    events = _read(spark, sf_dir, "events")
    saved = F.when(F.col("event_id") % 10 > 0, F.concat(F.lit("out/k_"), F.col("event_id"), F.lit(".jpg")))
    given = {"video_id": F.col("user_id").cast("string"), "rank": (F.col("event_id") % 5).cast("int"), "final_score": F.col("value"), "w_iqa": F.when(F.col("event_id") % 3 > 0, F.col("value") / 2), "saved_path": saved}
    columns = [c.strip().split(" ") for c in schemas.KEYFRAMES.split(",")]
    files.write_csv(events.select(*(given.get(n, F.lit(None).cast(t)).alias(n) for n, t in columns)), path)
    return path


@query("SELECT 'k_' || event_id || '.jpg' AS filename, value AS final_score, CASE WHEN event_id % 3 > 0 THEN value / 2 ELSE 0e0 END AS w_iqa, 0e0 AS w_face, 0e0 AS w_emotion, 0e0 AS w_pose FROM events WHERE event_id % 10 > 0")
def gallery_of_results(spark, sf_dir):
    return files.gallery(spark, _keyframe_file(spark, sf_dir))


@query("SELECT CAST(user_id AS VARCHAR) AS video_id, CAST(event_id % 5 AS INTEGER) AS rank, value AS final_score FROM events WHERE event_id = 123")
def result_by_name(spark, sf_dir):
    return files.result_of(spark, _keyframe_file(spark, sf_dir), "k_123.jpg").select("video_id", "rank", "final_score")


@query(f"WITH {FRAMES} SELECT printf('segment_%03d_%s', ascii(pred_label[2]) - 48, pred_label) AS folder, count(*) AS n FROM frames WHERE pred_label <> 'IGNORED' GROUP BY 1")
def segment_folders(spark, sf_dir):
    path = shared_folder(spark)
    rows = _frames(spark, sf_dir).where("pred_label <> 'IGNORED'").select("event_id", F.col("pred_label").alias("priority"), F.substring("pred_label", 2, 1).cast("int").alias("segment_id"))
    files.write_by_segment(rows, path)
    return spark.read.parquet(path).groupBy("folder").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS label, o_orderpriority AS game, count(*) AS frame_count FROM orders GROUP BY 1, 2")
def game_distribution_file(spark, sf_dir):
    path = shared_folder(spark)
    files.write_dataset(_read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label"), F.col("o_orderpriority").alias("game"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("filename")), path)
    return files.csv(spark, f"{path}/game_distribution", "label string, game string, frame_count bigint")


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def metrics_file(spark, sf_dir):
    path = shared_folder(spark)
    files.write_json(dataset.label_counts(_read(spark, sf_dir, "events").select(F.col("event_type").alias("label"))), path)
    return spark.read.schema("label string, n bigint").json(path)


def _documents(spark, sf_dir, content) -> str:
    """One JSON file per region with what its nations make."""
    path = shared_folder(spark)
    _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(*content).coalesce(1).write.partitionBy("n_regionkey").json(path)
    return path


@query("SELECT n_nationkey AS image_id, 'p_' || n_nationkey || '.jpg' AS file_name, n_nationkey + 1e0 AS x1, n_nationkey * 2e0 AS y1, n_nationkey + 11.5e0 AS x2, n_nationkey * 2 + 7e0 AS y2 FROM nation")
def coco_boxes(spark, sf_dir):
    k = F.col("n_nationkey").cast("bigint")
    images = F.collect_list(F.struct(k.alias("id"), F.concat(F.lit("p_"), k, F.lit(".jpg")).alias("file_name"))).alias("images")
    boxes = F.collect_list(F.struct(k.alias("image_id"), F.array(k + 1.0, k * 2.0, F.lit(10.5), F.lit(7.0)).alias("bbox"))).alias("annotations")
    return files.coco(spark, _documents(spark, sf_dir, [images, boxes])).select("image_id", "file_name", "box.*")


@query("SELECT n_name AS joint, n_nationkey * 1.5e0 AS x, n_regionkey + 0.25e0 AS y FROM nation WHERE n_nationkey < 12")
def pose_joints(spark, sf_dir):
    point = F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") * 1.5).alias("x"), (F.col("n_regionkey") + 0.25).alias("y"))
    path = _documents(spark, sf_dir, [F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("n_nationkey")), point))).alias("keypoint_2d")])
    names = [r.n_name for r in _read(spark, sf_dir, "nation").where("n_nationkey < 12").select("n_name").collect()]  # a dozen
    return files.pose_truth(spark, path, names).select("joint", "x", "y")


@query("SELECT n_nationkey, n_regionkey AS kept FROM nation WHERE n_nationkey % 3 > 0")
def annotation_documents(spark, sf_dir):
    """JSON documents, one a file, with an array exploded."""
    path = _documents(spark, sf_dir, [F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("kept"))).alias("items")])
    rows = files.json(spark, path, "items array<struct<id: bigint, kept: bigint>>").select(F.inline("items"))
    return rows.where("id % 3 > 0").select(F.col("id").alias("n_nationkey"), "kept")


@query("SELECT printf('video_%s_rank%02d_%s_conf%.2f_score%.3f.jpg', n_name, n_nationkey, CASE WHEN n_regionkey = 0 THEN 'NA' ELSE 'P' || n_regionkey END, n_nationkey / 7e0, n_nationkey / 13e0) AS name FROM nation")
def picture_files(spark, sf_dir):
    """Files copied under the names of chosen frames, and listed."""
    folder = shared_folder(spark)
    nation = _read(spark, sf_dir, "nation")
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    name = S.keyframe_name(F.col("n_name"), k, F.when(region > 0, F.concat(F.lit("P"), region)), k / 7.0, k / 13.0)
    source = _read(spark, sf_dir, "region").inputFiles()[0]
    files.write_pictures(nation.select(F.lit(source).alias("input_path"), name.alias("saved_path")), folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    # A listing gives paths as addresses: blanks are written %20.
    return files.listing(spark, folder).select(F.regexp_replace(S.basename("path"), "%20", " ").alias("name"))


# Faces and colours -------------------------------------------------------------------------------

W, H = 160, 80


def _face_sql(k: int) -> str:
    e = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
    marks = ", ".join(f"x1 + (x2 - x1) * ({x}e0 + {e(24 + 10 * k + 2 * j)}) AS m{j}x, y1 + (y2 - y1) * ({y}e0 + {e(25 + 10 * k + 2 * j)}) AS m{j}y" for j, (x, y) in enumerate(MARKS))
    return f"""SELECT *, {marks} FROM (SELECT vec_id, embedding, {k} AS i, 50e0 + 150e0 * {e(5 * k)} AS x1, 20e0 + 100e0 * {e(5 * k + 1)} AS y1, 75e0 + 150e0 * {e(5 * k)} + 300e0 * abs({e(5 * k + 2)}) AS x2,
      40e0 + 100e0 * {e(5 * k + 1)} + 200e0 * abs({e(5 * k + 3)}) AS y2, least(1e0, 0.3e0 + 4e0 * abs({e(5 * k + 4)})) AS det, 3000e0 * abs({e(5 * k + 3)}) AS sharp, 3e0 * abs({e(5 * k)}) AS hap, 3e0 * abs({e(5 * k + 1)}) AS ang FROM embeddings)"""


#: Where the eyes, the nose and the corners of the mouth lie in a face, by default.
MARKS = ((0.3, 0.35), (0.7, 0.35), (0.5, 0.55), (0.35, 0.8), (0.65, 0.8))


def _deviation_sql(axis: str, low: str, size: str) -> str:
    v = [f"((m{j}{axis} - {low}) / {size})" for j in range(5)]
    mean = f"(({' + '.join(v)}) / 5)"
    return f"sqrt(({' + '.join(f'power({x} - {mean}, 2)' for x in v)}) / 5)"


FACES = f"""f AS ({" UNION ALL ".join(_face_sql(k) for k in range(4))}),
v AS (SELECT *, greatest(0e0, x2 - x1) * greatest(0e0, y2 - y1) AS raw, greatest(0e0, x1) AS ax1, greatest(0e0, y1) AS ay1, least({W}e0, x2) AS ax2, least({H}e0, y2) AS ay2, least({W - 1}e0, x2) AS cx2, least({H - 1}e0, y2) AS cy2,
  greatest(0e0, trunc(x1)) AS bx1, greatest(0e0, trunc(y1)) AS by1, least({W - 1}e0, trunc(x2)) AS bx2, least({H - 1}e0, trunc(y2)) AS by2 FROM f)"""
QUALITY = f"""u AS (SELECT *, greatest(ax2 - ax1, 1e0) AS fw, greatest(ay2 - ay1, 1e0) AS fh, greatest(0e0, bx2 - bx1) * greatest(0e0, by2 - by1) AS px FROM v),
t AS (SELECT *, px / {W * H}e0 AS share, ({" + ".join(f"CASE WHEN m{j}x BETWEEN ax1 AND ax2 AND m{j}y BETWEEN ay1 AND ay2 THEN 1 ELSE 0 END" for j in range(5))}) / 5e0 AS inside, sqrt(power(m1x - m0x, 2) + power(m1y - m0y, 2)) / fw AS eyes,
  (m0y + m1y) / 2 AS top, m2y AS nose, (m3y + m4y) / 2 AS mouth, ({_deviation_sql("x", "ax1", "fw")} + {_deviation_sql("y", "ay1", "fh")}) / 2 AS spread FROM u),
s AS (SELECT *, least(1e0, greatest(0e0, 0.35e0 * inside + 0.30e0 * CASE WHEN eyes < 0.15e0 THEN eyes / 0.15e0 WHEN eyes <= 0.60e0 THEN 1e0 ELSE greatest(0e0, 1e0 - (eyes - 0.60e0) / 0.40e0) END
  + 0.20e0 * CASE WHEN top < nose AND nose < mouth THEN 1e0 WHEN nose > top OR nose < mouth THEN 0.5e0 ELSE 0e0 END + 0.15e0 * least(1e0, spread / 0.25e0))) AS seen,
  CASE WHEN share BETWEEN 0.15e0 AND 0.50e0 THEN 1e0 WHEN share < 0.15e0 THEN least(share / 0.15e0, 1e0) ELSE greatest(1e0 - (share - 0.50e0) / 0.30e0, 0.5e0) END AS size,
  sqrt(power((bx1 + bx2) / 2 - {W // 2}, 2) + power((by1 + by2) / 2 - {H // 2}, 2)) / sqrt({(W // 2) ** 2 + (H // 2) ** 2}e0) AS off FROM t),
q AS (SELECT *, 0.20e0 * size + 0.15e0 * (1e0 - 0.5e0 * off) + 0.25e0 * det + 0.25e0 * least(sharp / 400e0, 1e0) + 0.15e0 * seen AS quality FROM s)"""


def _faces(spark, sf_dir):
    def one(k: int):
        e = lambda i: F.col("embedding")[i].cast("double")
        x1, y1 = 50.0 + 150.0 * e(5 * k), 20.0 + 100.0 * e(5 * k + 1)
        x2, y2 = 75.0 + 150.0 * e(5 * k) + 300.0 * F.abs(e(5 * k + 2)), 40.0 + 100.0 * e(5 * k + 1) + 200.0 * F.abs(e(5 * k + 3))
        box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
        marks = F.array(*(F.struct((x1 + (x2 - x1) * (x + e(24 + 10 * k + 2 * j))).alias("x"), (y1 + (y2 - y1) * (y + e(25 + 10 * k + 2 * j))).alias("y")) for j, (x, y) in enumerate(MARKS)))
        hap, ang = 3.0 * F.abs(e(5 * k)), 3.0 * F.abs(e(5 * k + 1))
        scores = F.create_map(F.lit("Happiness"), hap, F.lit("Anger"), ang, F.lit("Neutral"), F.lit(5.0))
        return F.struct(
            box.alias("bbox"), F.least(F.lit(1.0), 0.3 + 4.0 * F.abs(e(5 * k + 4))).alias("det_score"), (3000.0 * F.abs(e(5 * k + 3))).alias("sharpness"), marks.alias("kps"),
            F.when(hap >= ang, "Happiness").otherwise("Anger").alias("emotion"), scores.alias("scores"),
        )

    return _read(spark, sf_dir, "embeddings").select("vec_id", F.array(*map(one, range(4))).alias("faces"))


@query(f"WITH {FACES}, {QUALITY} SELECT vec_id, i, round(share, 9) AS coverage, round(quality, 9) AS quality, round(det, 9) AS det_score, round(seen, 9) AS visibility, round(px, 9) AS area FROM q")
def face_qualities(spark, sf_dir):
    w, h = F.lit(W), F.lit(H)
    rows = _faces(spark, sf_dir).select("vec_id", F.posexplode(F.transform("faces", lambda f: S.face_quality(f, w, h))).alias("i", "q")).select("vec_id", "i", "q.*")
    return rows.select("vec_id", "i", *(F.round(c, 9).alias(c) for c in ("coverage", "quality", "det_score", "visibility", "area")))


@query(f"""WITH {FACES}, {QUALITY}, g AS (SELECT vec_id, count(*) AS n, sum(share) AS share, CASE WHEN sum(px) = 0 THEN 1e0 ELSE sum(px) END AS w, sum(quality * px) AS qw, sum(seen * px) AS sw, min(det) AS det FROM q GROUP BY 1)
SELECT vec_id, CAST(n AS INTEGER) AS num_faces, round(least(share, 1e0), 9) AS face_area, round(qw / w, 9) AS face_quality, round(det, 9) AS face_det_score, round(sw / w, 9) AS face_visibility FROM g""")
def face_summaries(spark, sf_dir):
    w, h = F.lit(W), F.lit(H)
    rows = _faces(spark, sf_dir).select("vec_id", S.face_summary(F.transform("faces", lambda f: S.face_quality(f, w, h))).alias("s")).select("vec_id", "s.*")
    return rows.select("vec_id", "num_faces", *(F.round(c, 9).alias(c) for c in ("face_area", "face_quality", "face_det_score", "face_visibility")))


@query(f"""WITH {FACES}, d AS (SELECT *, greatest(0e0, cx2 - ax1) * greatest(0e0, cy2 - ay1) AS px,
  sqrt(power(abs((ax1 + cx2) / 2 - {W // 2}) / {W // 2}, 2) + power(abs((ay1 + cy2) / 2 - {H // 2}) / {H // 2}, 2)) AS off FROM v),
o AS (SELECT *, 0.60e0 * least(px / {W * H}e0 / 0.25e0, 1e0) + 0.40e0 * greatest(0e0, 1e0 - off) AS value, px / {W * H}e0 >= 0.01e0 AS large FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY large DESC, CASE WHEN large THEN value END DESC, i) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY raw DESC, i) AS rr FROM o),
m AS (SELECT *, first_value(px) OVER (PARTITION BY vec_id ORDER BY r) AS first_px, bool_or(large) OVER (PARTITION BY vec_id) AS any_large FROM b),
k AS (SELECT * FROM m WHERE CASE WHEN any_large THEN large AND px >= first_px * 0.35e0 ELSE rr = 1 END)
SELECT vec_id, count(*) AS n, round(arg_min(x1, r), 6) AS x1 FROM k GROUP BY vec_id""")
def dominant_faces(spark, sf_dir):
    rows = _faces(spark, sf_dir).select("vec_id", S.dominant_faces("faces", F.lit(W), F.lit(H)).alias("d"))
    return rows.select("vec_id", F.size("d").cast("bigint").alias("n"), F.round(F.get("d", F.lit(0))["bbox"]["x1"], 6).alias("x1"))


@query(f"""WITH {FACES}, e AS (SELECT *, CASE WHEN bx2 > bx1 AND by2 > by1 THEN greatest(hap, ang) * least((bx2 - bx1) * (by2 - by1) / {W * H}e0 / 0.25e0, 1e0) ELSE 0e0 END AS intensity, row_number() OVER (PARTITION BY vec_id ORDER BY raw DESC, i) AS r FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY intensity DESC, r) AS best FROM e WHERE r <= 3)
SELECT vec_id, CASE WHEN intensity > 0 THEN round(least(1e0, intensity), 6) ELSE 0e0 END AS intensity, CASE WHEN intensity > 0 THEN CASE WHEN hap >= ang THEN 'Happiness' ELSE 'Anger' END ELSE 'none' END AS label FROM b WHERE best = 1""")
def strongest_emotions(spark, sf_dir):
    rows = _faces(spark, sf_dir).select("vec_id", S.strongest_emotion("faces", F.lit(W), F.lit(H), 3).alias("e")).select("vec_id", "e.*")
    return rows.select("vec_id", F.round("intensity", 6).alias("intensity"), "label")


_CHANNEL = lambda c: f"right('0' || lower(hex(CAST(floor(floor(sum({c}) FILTER (WHERE k <= greatest(10, floor(n * 0.3e0))) / greatest(1, least(n, greatest(10, floor(n * 0.3e0)))) + 0.5e0) * 0.6e0 + 0.5e0) AS BIGINT))), 2)"


@query(f"""WITH p AS (SELECT vec_id, i, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 4000) AS BIGINT) % 256 AS r, CAST(floor(abs(CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE)) * 3000) AS BIGINT) % 256 AS g,
  CAST(floor(abs(CAST(embedding[(i + 19) % 64 + 1] AS DOUBLE)) * 2000) AS BIGINT) % 256 AS b, CASE WHEN (vec_id + i) % 5 = 0 THEN 50 ELSE 255 END AS a FROM embeddings, range(64) t(i) WHERE vec_id % 7 > 0 OR i < 9),
h AS (SELECT *, greatest(r, g, b) / 255e0 AS top, least(r, g, b) / 255e0 AS low FROM p),
s AS (SELECT *, (top + low) / 2 AS light, CASE WHEN top = low THEN 0e0 ELSE (top - low) / (1e0 - abs(2 * ((top + low) / 2) - 1)) END AS sat FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sat DESC, i) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM s WHERE a >= 100 AND light BETWEEN 0.12e0 AND 0.85e0 AND sat >= 0.25e0),
d AS (SELECT vec_id, CASE WHEN n < 10 THEN '#0a1628' ELSE '#' || {_CHANNEL("r")} || {_CHANNEL("g")} || {_CHANNEL("b")} END AS colour FROM c GROUP BY vec_id, n)
SELECT vec_id, coalesce(colour, '#0a1628') AS colour FROM embeddings LEFT JOIN d USING (vec_id)""")
def dominant_colours(spark, sf_dir):
    at = lambda i: F.abs(F.get("embedding", i).cast("double"))

    def pixel(i):
        value = lambda shift, scale: (F.floor(at((i + shift) % 64) * scale) % 256).cast("int")
        return F.struct(value(0, 4000).alias("r"), value(7, 3000).alias("g"), value(19, 2000).alias("b"), F.when((F.col("vec_id") + i) % 5 == 0, 50).otherwise(255).alias("a"))

    last = F.when(F.col("vec_id") % 7 > 0, 63).otherwise(8)
    pixels = F.transform(F.sequence(F.lit(0), last), pixel)
    return _read(spark, sf_dir, "embeddings").select("vec_id", S.dominant_colour(pixels).alias("colour"))


# Model slots ------------------------------------------------------------------------------------

_CLASSES = 4


def _stand_in():
    """A classifier with fixed weights in place of a trained one: class, and the probability of it."""
    import numpy as np
    import pyarrow as pa

    place, k = np.arange(64)[:, None], np.arange(_CLASSES)[None]
    weights = ((place * 7 + k * 13) % 11 - 5) / 2.0

    def run(vectors: pa.Array) -> pa.Array:
        z = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), 64) @ weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return pa.StructArray.from_arrays([pa.array(z.argmax(axis=1).astype(np.int32)), pa.array(e.max(axis=1) / e.sum(axis=1))], names=["label", "p"])

    return run


@query(f"""WITH z AS (SELECT vec_id, k, sum(CAST(embedding[i + 1] AS DOUBLE) * ((i * 7 + k * 13) % 11 - 5) / 2e0) AS z FROM embeddings, range(64) a(i), range({_CLASSES}) b(k) GROUP BY vec_id, k)
SELECT vec_id, CAST(arg_max(k, z) AS INTEGER) AS label, round(1e0 / sum(exp(z - top)), 9) AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM z) GROUP BY vec_id""")
def slot_classifier(spark, sf_dir):
    """A model behind a slot, loaded once a worker."""
    slot = signals.SignalProvider("class", ("embedding",), T.StructType([T.StructField("label", T.IntegerType()), T.StructField("p", T.DoubleType())]), _stand_in, version="stand_in")
    found = signals.with_signals(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), slot)
    return found.select("vec_id", "class.label", F.round("class.p", 9).alias("p"))


@query("""SELECT event_id, round(CASE WHEN event_id % 7 = 0 THEN 0.5e0 ELSE least(1e0, greatest(0e0, value / 50e0 - 0.5e0)) END, 9) AS iqa,
round(CASE WHEN event_id % 7 = 0 THEN 0.5e0 ELSE least(1e0, greatest(0e0, 0.5e0 - value / 50e0)) END, 9) AS inverse FROM events""")
def quality_signals(spark, sf_dir):
    raw = F.when(F.col("event_id") % 7 > 0, F.col("value") / 50.0 - 0.5)
    return _read(spark, sf_dir, "events").select("event_id", F.round(signals.quality(raw), 9).alias("iqa"), F.round(signals.quality(raw, lower_is_better=True), 9).alias("inverse"))


@query("""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 400) AS BIGINT) % 256 AS r, CAST(floor(abs(CAST(embedding[(i + 7) % 64 + 1] AS DOUBLE)) * 300) AS BIGINT) % 256 AS g,
  CAST(floor(abs(CAST(embedding[(i + 19) % 64 + 1] AS DOUBLE)) * 200) AS BIGINT) % 256 AS b FROM embeddings, range(64) t(i)),
q AS MATERIALIZED (SELECT vec_id, y, x, r * 0.2126e0 + g * 0.7152e0 + b * 0.0722e0 AS light, CAST(floor(r * 0.299e0 + g * 0.587e0 + b * 0.114e0 + 0.5e0) AS BIGINT) AS v FROM p),
s AS (SELECT c.vec_id, c.y, c.x, sum(dx * (2 - abs(dy)) * o.v) AS gx, sum(dy * (2 - abs(dx)) * o.v) AS gy FROM q c, range(-1, 2) a(dy), range(-1, 2) d(dx), q o
  WHERE o.vec_id = c.vec_id AND o.y = CASE c.y + dy WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE c.y + dy END AND o.x = CASE c.x + dx WHEN -1 THEN 1 WHEN 8 THEN 6 ELSE c.x + dx END GROUP BY 1, 2, 3),
u AS (SELECT vec_id, sum(n) / (64 + 1e-6) AS uniformity FROM (SELECT vec_id, count(*) AS n, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC) AS k FROM q GROUP BY vec_id, v) WHERE k <= 12 GROUP BY vec_id)
SELECT vec_id, round(light, 10) AS luminance, round(sharp, 6) AS sharpness, round(uniformity, 6) AS uniformity FROM (SELECT vec_id, avg(light) AS light FROM q GROUP BY vec_id)
JOIN (SELECT vec_id, avg(sqrt(gx * gx + gy * gy)) AS sharp FROM s GROUP BY vec_id) USING (vec_id) JOIN u USING (vec_id)""")
def picture_metrics(spark, sf_dir):
    """Metrics of pictures of 8 x 8 pixels by the pixel slot."""
    value = lambda i, scale: F.floor(F.abs(F.get("embedding", i % 64).cast("double")) * scale) % 256
    pixel = lambda i: F.concat(*(F.lpad(F.hex(value(i + shift, scale)), 2, "0") for shift, scale in ((0, 400), (7, 300), (19, 200))))
    rgb = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel), ""))
    pictures = _read(spark, sf_dir, "embeddings").select("vec_id", rgb.alias("rgb"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    found = signals.with_signals(pictures, signals.PIXEL_METRICS)
    # Luminances are multiples of 1 / 640000: fewer digits would end in ties.
    return found.select("vec_id", *(F.round(f"metrics.{m}", n).alias(m) for m, n in (("luminance", 10), ("sharpness", 6), ("uniformity", 6))))
