"""Queries against their SQL on rows that the fixtures lack."""

import duckdb
import numpy as np

from framerank import queries
from framerank.config import SIGNAL_WEIGHTS, normalise_weights
from framerank.operators import metrics, segments


def same_as_sql(spark, name, folder, **tables):
    """Writes the tables (rows, DDL), runs the query and its SQL on them, and returns the rows of both, sorted."""
    con = duckdb.connect()
    for table, (rows, kinds) in tables.items():
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(folder))
    found = con.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    return sorted((tuple(r[c] for c in names) for r in got.collect()), key=str), sorted(found.fetchall(), key=str)


LONG = "the seven elephants. " * 30
DOCUMENTS = [
    (1, "", "en", 0), (2, None, "fr", 0), (3, None, "en", 400), (4, None, None, None), (5, LONG, None, len(LONG)), (6, LONG, "de", None), (7, "", "xx", 300), (8, "x", "en", 1),
    (9, "ab cd. " * 60, "en", 420), (10, "a\0 e\u0301. \U0001f44d\U0001f3fd\r\n" * 60, "fr", 720),
]
DOCUMENT = "doc_id bigint, text string, lang string, n_chars bigint"


def test_cascade_of_empty_and_missing_texts(spark, tmp_path):
    got, want = same_as_sql(spark, "filter_cascade", tmp_path, documents=(DOCUMENTS, DOCUMENT))
    assert got == want
    reasons = {r[0]: r[2] for r in got}
    assert reasons[1] == reasons[2] == "luminance" and reasons[3] is None and reasons[7] == "sharpness"


def test_stage_analytics_of_missing_values(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, 1, "click", None if i % 3 == 0 else float(i)) for i in range(60)]
    got, want = same_as_sql(spark, "stage_analytics", tmp_path, events=(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"))
    assert got == want


def test_cascade_reasons_of_empty_and_missing_texts(spark, tmp_path):
    got, want = same_as_sql(spark, "filter_cascade_reasons", tmp_path, documents=(DOCUMENTS, DOCUMENT))
    assert got == want
    assert not any(r[1] == "unreadable" for r in got)


def test_ranked_keyframes_with_equal_scores(spark, tmp_path):
    import datetime

    at = lambda hours: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)
    click = lambda i, hours, user: (i, at(hours), user, "click", 90.0)
    # 113 and 396 have one final score and tier, not one rank value; 259279 and 285620 have one score if the weights are exact.
    rows = [click(113, 0, 1), click(396, 20, 1), click(2, 40, 1)]
    rows += [click(259279, 0, 2), click(7, 20, 2), click(11, 40, 2), (12, at(60), 2, "error", 90.0), click(285620, 80, 2), click(13, 100, 2), click(14, 120, 2)]
    vectors = [(i, [float(i == k) for k in range(60)], i % 3) for i in range(60)]
    got, want = same_as_sql(
        spark, "ranked_keyframes", tmp_path, events=(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"),
        embeddings=(vectors, "vec_id bigint, embedding array<float>, label int"),
    )
    assert got == want
    ranks = {r[6]: r[1] for r in got}
    assert ranks["113"] < ranks["396"] and ranks["259279"] < ranks["285620"]


def test_weights_are_the_sqls():
    assert normalise_weights(dict(SIGNAL_WEIGHTS)) == {"iqa": 0.35 / 0.9, "face": 0.25 / 0.9, "emotion": 0.15 / 0.9, "pose": 0.15 / 0.9}


def test_frames_per_label_are_counted_without_pairs(spark, small):
    at = [-3000, -1025, -1024, -1, 0, 0, 5, 5, 5, 1023, 1024, 5000, None]
    frames = spark.createDataFrame([(i,) for i in at], "frame_idx bigint")
    spans = [("a", -1024, 5), ("a", 0, 0), ("a", 5, 1024), (None, -9000, 9000), ("b", 6, 1022), ("c", None, 7), ("c", 6, 5), ("d", 0, 0), ("d", 0, 0)]
    found = segments.count_by_label(frames, spark.createDataFrame(spans, "pred_label string, start_index bigint, end_index bigint"))
    want: dict = {}
    for label, a, b in spans:
        n = sum(a is not None and i is not None and a <= i <= b for i in at)
        if n:
            want[label] = want.get(label, 0) + n
    assert {r.pred_label: r.frames for r in found.collect()} == want
    # Segments are not spread over bins to meet the frames there.
    plan = queries.QUERIES["frames_segment_range_unscoped"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_taken_truths_are_packed_away(monkeypatch):
    monkeypatch.setattr(metrics, "PACK", 5)
    draw = np.random.default_rng(3)
    corner = draw.uniform(0, 60, (2, 400))
    boxes = np.concatenate([corner, corner + draw.uniform(20, 40, (2, 400))])
    ids = np.sort(draw.integers(0, 350, 400))
    truths = metrics._Truths(ids, boxes, 0.5)
    taken: set[int] = set()
    for k in range(400):
        own = boxes[:, (k * 7) % 400] + 1.0
        near = [int(g) for g, t in zip(ids, boxes.T) if g not in taken and _iou(own, t) >= 0.5]
        assert truths.take([tuple(own)]) == (near[0] if near else None)
        taken.update(near[:1])
    assert len(taken) > 50 and len(truths.ids) < 400


def _iou(a, b):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + 1e-6)


def odd_vectors():
    """Repeated ids, missing and NaN components, labels with one kind of box only, and some of a plain kind."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.normal(0, 0.125, 4).astype("float32")], i // 90) for i in range(270)]
    rows += [(i, [float(x) for x in draw.normal(0, 0.125, 4).astype("float32")], 0) for i in (1, 1, 6, 8, 8, 9)]
    nan = float("nan")
    rows += [(400, None, 0), (401, None, 0), (402, [0.1, None, 0.1, 0.1], 1), (403, [None, 0.1, 0.1, 0.1], 1), (405, [0.0, nan, 0.1, 0.1], 2), (406, [0.1, 0.1, nan, 0.1], 2)]
    return rows + [(501, [0.0] * 4, 7), (503, [0.0] * 4, 7), (504, [0.0] * 4, 8)], "vec_id bigint, embedding array<float>, label int"


def test_boxes_are_matched_without_candidate_lists(spark, small, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got, want = same_as_sql(spark, "iou_match", tmp_path, embeddings=odd_vectors())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)
    plan = queries.QUERIES["iou_match"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_detection_scores_without_candidate_lists(spark, small, tmp_path):
    got, want = same_as_sql(spark, "detection_scores", tmp_path, embeddings=odd_vectors())
    assert got == want and got[0][0] > 0
    plan = queries.QUERIES["detection_scores"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
