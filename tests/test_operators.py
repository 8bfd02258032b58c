"""Hand-built edge cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framerank.config import RankConfig, Thresholds, normalise_weights
from framerank.operators import dataset, events, filters, metrics, redundancy, scoring, segments, select
from framerank.plans import ranking


def frames(spark, labels, clip="c", start=0):
    return spark.createDataFrame([(clip, start + i, label) for i, label in enumerate(labels)], "clip string, frame_idx long, pred_label string")


def found(df, least):
    rows = segments.runs(df, ["clip"], ["frame_idx"], min_length=least).collect()
    return sorted((r.clip, r.pred_label, r.num_frames, r.start_index, r.end_index) for r in rows)


def test_runs(spark):
    mixed = frames(spark, ["P1", "P1", "Main", "P1"])
    assert found(segments.drop_ignored(mixed, ["Main"]), 3) == [("c", "P1", 3, 0, 3)]
    assert found(mixed, 3) == []
    assert found(frames(spark, ["P1", "P1", "P2", "P1"]), 2) == [("c", "P1", 2, 0, 1)]
    two = frames(spark, ["P1"] * 3, "a").unionByName(frames(spark, ["P1"] * 3, "b", 3))
    assert found(two, 3) == [("a", "P1", 3, 0, 2), ("b", "P1", 3, 3, 5)]
    none = segments.number(segments.runs(frames(spark, ["Main"]).where("pred_label = 'x'"), ["clip"], ["frame_idx"]), ["pred_label", "clip"], ["start_index"])
    assert none.count() == 0 and "segment_id" in none.columns


def test_runs_are_disjoint_and_cover(spark):
    rng = np.random.default_rng(0)
    labels = [str(x) for x in rng.integers(0, 3, 500)]
    rows = found(frames(spark, labels), 1)
    assert sum(r[2] for r in rows) == 500
    spans = sorted((r[3], r[4]) for r in rows)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_numbering_is_global(spark):
    rows = spark.createDataFrame([("P2", "a", 5), ("P1", "b", 9), ("P1", "a", 7), ("P1", "a", 1), (None, "a", 0)], "p string, clip string, s long")
    got = segments.number(rows, ["p", "clip"], ["s"]).orderBy("segment_id").collect()
    assert [(r.p, r.clip, r.s, r.segment_id) for r in got] == [(None, "a", 0, 0), ("P1", "a", 1, 1), ("P1", "a", 7, 2), ("P1", "b", 9, 3), ("P2", "a", 5, 4)]


def test_numbering_spreads_a_hot_group_and_places_nulls_first(spark):
    rows = [("a" if i % 3 else (None, "b", "c")[i % 9 // 3], None if i % 7 == 0 else i % 5, i) for i in range(600)]
    got = segments.number(spark.createDataFrame(rows, "p string, clip int, s int"), ["p", "clip"], ["s"]).orderBy("segment_id").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    assert [tuple(r) for r in got] == [(*r, n) for n, r in enumerate(want)]
    labels = spark.createDataFrame([(x,) for x in ("b", "a", None, "b")], "label string")
    assert sorted(map(tuple, dataset.dense_ids(labels).collect())) == [("a", 0), ("b", 1), ("b", 1)]


def test_range_join_over_bins(spark):
    f = spark.createDataFrame([("c", i) for i in (0, 1, 1023, 1024, 2047, 2048, 5000)], "clip string, frame_idx long")
    s = spark.createDataFrame([("c", 1, 2047), ("c", 2048, 2048), ("d", 0, 9999)], "clip string, start_index long, end_index long")
    got = sorted((r.frame_idx, r.start_index) for r in segments.frames_by_segment(f, s, ["clip"]).collect())
    assert got == [(1, 1), (1023, 1), (1024, 1), (2047, 1), (2048, 2048)]
    assert segments.frames_in_segments(f, s, ["clip"]).count() == 5
    assert segments.frames_in_segments(f, s).count() == 7


def test_confidence_gate(spark):
    rows = spark.createDataFrame([(0.40,), (0.39,), (None,), (float("nan"),)], "confidence double")
    assert [r.confidence for r in filters.confident(rows).collect()] == [0.40]
    assert filters.confident(rows.drop("confidence").withColumn("x", F.lit(1))).count() == 4


def test_cascade_counts_the_first_reason(spark):
    rows = spark.createDataFrame([("A", 10.0, 1.0, 0.9, 0.0), ("A", 60.0, 1.0, 0.9, 0.0), ("A", 60.0, 20.0, 0.9, 0.0), ("A", 60.0, 20.0, 0.7, 0.0), ("A", 50.0, 15.0, 0.7, 5.0), ("Z", 50.0, 15.0, 0.7, 5.0), ("A", None, 1.0, 1.0, 1.0)], "priority string, luminance double, sharpness double, uniformity double, texture double")
    got = {r.reason: r.n for r in filters.reasons(filters.cascade(rows, {"A": Thresholds()}, default="A")).collect()}
    assert got == {"luminance": 1, "sharpness": 1, "uniformity": 1, "texture": 1, "kept": 2, "unreadable": 1}


def test_gates(spark):
    rows = spark.createDataFrame([(0.5, 0.1), (0.49, 0.15), (None, 0.2)], "logo_p double, closeup double")
    assert filters.without_logo(rows).count() == 2
    assert filters.close_enough(rows.withColumn("min_closeup", F.lit(0.15))).count() == 2
    masks = spark.createDataFrame([([(0.2,), (0.5,)],)], "m array<struct<score: double>>")
    assert [m.score for m in masks.select(filters.instances("m", 0.5).alias("m")).first().m] == [0.5]


def test_temporal_clusters(spark):
    def clusters(indices, gap):
        rows = spark.createDataFrame([("v", i) for i in indices], "v string, i long")
        got = {}
        for r in redundancy.temporal_clusters(rows, ["v"], "i", gap).collect():
            got.setdefault(r.cluster, []).append(r.i)
        return sorted(map(sorted, got.values()))

    assert clusters([0, 18, 35, 60], 18) == [[0], [18, 35], [60]]
    assert clusters([0, 10, 20, 30], 18) == [[0, 10, 20, 30]]


def test_best_of_cluster(spark):
    rows = spark.createDataFrame([(1, 5, 0.3), (1, 2, 0.3), (1, 1, None), (1, 9, 0.1)], "k int, o int, s double")
    chosen = lambda k: sorted(r.o for r in redundancy.best_of(rows, ["k"], "s", ["o"], k).where("selected").collect())
    assert chosen(1) == [2] and chosen(2) == [2, 5] and chosen(0) == [2]


def test_leaders_are_not_transitive():
    turn = lambda d: [np.cos(np.radians(d)), np.sin(np.radians(d))]
    assert redundancy.leaders_cosine(np.array([turn(0), turn(20), turn(40)]), np.cos(np.radians(25))).tolist() == [0, 0, 2]
    assert redundancy.leaders_cosine(np.zeros((2, 3)), 0.9).tolist() == [0, 1]
    assert redundancy.leaders_hamming(np.array([[0], [1], [3]], np.uint64), 1).tolist() == [0, 0, 2]


def test_leaders_in_blocks(monkeypatch):
    x = np.random.default_rng(3).normal(size=(200, 4))
    whole = redundancy.leaders_cosine(x, 0.8)
    monkeypatch.setattr(redundancy, "BLOCK", 7)
    assert (redundancy.leaders_cosine(x, 0.8) == whole).all()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(unit[i] @ unit[j] >= 0.8 - 1e-6 for i, j in enumerate(whole) if i != j)


def test_methods(spark):
    rows = spark.createDataFrame([("s", i, i * 10, [1.0, 0.0], float(i)) for i in range(4)], "g string, o int, idx int, f array<double>, score double")
    left = lambda m, **k: sorted(r.o for r in redundancy.reduce_redundancy(m, rows, group="g", order="o", score="score", **k).collect())
    assert left("visual", feature="f", threshold=0.9, kind="histogram") == [0]
    assert left("visual", feature="f", threshold=0.9, kind="clip") == [3]
    assert left("temporal", index="idx", gap=10) == [0, 1, 2, 3]
    assert left("hybrid", index="idx", feature="f") == [3]
    with pytest.raises(ValueError):
        redundancy.reduce_redundancy("other", rows)
    with pytest.raises(ValueError):
        redundancy.leader_clusters(rows, "g", "o", "f", 0.9, "other")


def test_suppression(spark):
    pool = spark.createDataFrame([("v", 0, 0.9), ("v", 17, 0.8), ("v", 18, 0.7), ("v", 18, 0.75)], "v string, i long, s double")
    got = select.suppress(pool, "v", "i", "s", []).orderBy("rank").collect()
    assert [(r.i, r.s, r["rank"]) for r in got] == [(0, 0.9, 1), (18, 0.75, 2)]


def test_fallback_equals_relaxed_choice():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        score = np.sort(rng.random(n))[::-1]
        index = rng.choice(500, n, replace=False)
        strict = select.greedy(index[score >= 0.5], 18, 10)
        relaxed = select.greedy(index[score >= 0.2], 18, 10)
        two_step = strict if len(strict) >= 10 else relaxed
        assert two_step.tolist() == relaxed.tolist()
        taken = index[relaxed]
        assert all(abs(a - b) >= 18 for k, a in enumerate(taken) for b in taken[:k])
        short = select.greedy(index[:10 * 35], 18, 10)
        assert short.tolist() == select.greedy(index, 18, 10).tolist()


def test_tiers_and_signals(spark):
    kinds = "num_faces int, face_quality double, face_area double, face_det_score double, emotion_intensity double, pose_score double, iqa_norm double, pose_label string, emotion_label string, segment_priority string"
    rows = [(1, 0.5, 0.1, 0.9, 0.1, 0.1, 2.0, "jump", "Fear", "x"), (0, 0.5, 0.1, 0.9, 0.5, 0.5, 0.5, "jump", "Fear", "P2_corner"), (1, 0.5, 0.1, 0.60, 0.5, 0.5, 0.5, "jump", "Fear", "P1_player_referee"), (2, 0.4, 0.02, 0.61, 0.21, 0.0, 0.0, None, "Fear", None)]
    got = scoring.score(scoring.with_tier(spark.createDataFrame(rows, kinds))).collect()
    assert [r.keyframe_priority for r in got] == [4, 3, 1, 2]
    assert [r.face_signal for r in got] == [0.5, 0.0, 0.0, 0.4]
    assert [r.segment_multiplier for r in got] == [1.0, 1.075, 1.2, 1.0]
    assert [r.content_source for r in got] == ["face_only", "pose:jump", "celebration:jump", "expressive:Fear"]
    assert got[0].iqa_signal == 1.0 and got[2].emotion_signal == 0.0


def test_weights():
    assert abs(sum(normalise_weights({"a": 0.35, "b": 0.55}).values()) - 1) < 1e-12
    with pytest.raises(ValueError):
        normalise_weights({"a": 0, "b": -1})
    form = RankConfig(fps=99, visual_threshold=-1, weights={"iqa": 0.0}).clamped()
    assert (form.fps, form.visual_threshold, form.weights["iqa"]) == (24, 0.0, 0.35)


def test_shots(spark):
    def shots(times):
        rows = spark.createDataFrame([("g", float(t), f"l{i}", i) for i, t in enumerate(times)], "g string, t double, label string, n int")
        return sorted((r.start, r.end, r.label) for r in dataset.shots(rows, ["g"], "t", "label", ["n"]).collect())

    assert shots([5]) == [(0.0, 5.0, "l0"), (5.0, 65.0, "l0")]
    assert shots([0, 4, 4]) == [(0.0, 4.0, "l1"), (4.0, 64.0, "l2")]


def test_annotations(spark):
    rows = [("1 - 01:02", " Public ", "62000"), ("3 - 00:00", "x", "1"), (None, "x", "1"), ("2 - 00:01", None, "12.5"), ("2 - 00:01", "", "1000"), ("x", "x", "1")]
    raw = spark.createDataFrame([("g", rows)], "game string, annotations array<struct<gameTime: string, label: string, position: string>>")
    assert sorted((r.half, r.seconds, r.label) for r in dataset.annotations(raw).collect()) == [(1, 62.0, "Public"), (2, 1.0, "unknown")]


def test_sampled_frames(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.9), ("b", 0.0, 9.0), ("c", 95.0, 130.0)], "label string, start double, end double")
    got = dataset.sample_frames(rows.withColumns({"fps": F.lit(25.0), "seconds": F.lit(100.0)}), "fps", "seconds").collect()
    assert sorted((r.label, r.frame_idx, r.middle) for r in got) == [("a", 36, 36), ("b", 75, 112), ("b", 150, 112), ("c", 2416, 2437), ("c", 2458, 2437)]


def test_hash_dedup_stops_at_target(spark):
    rows = spark.createDataFrame([("l", i, [v]) for i, v in enumerate([0, 1, 255, 3, 1 << 20, 0xFFFF])], "l string, k int, bits array<long>")
    kept = lambda target: [r.k for r in dataset.hamming_dedup(rows, "l", ["k"], "k", "bits", 5, target).orderBy("kept_rank").collect()]
    assert kept(None) == [0, 2, 5] and kept(2) == [0, 2]


def test_hash_dedup_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 12)
    bits = [int(b) ^ (1 << int(rng.integers(0, 60))) for b in rng.choice(base, 300)] + [int(b) for b in rng.integers(0, 1 << 62, 40)]
    rows = spark.createDataFrame([("ab"[i % 2], i, [v, 7]) for i, v in enumerate(bits)], "l string, k int, bits array<long>")
    kept = lambda: sorted(map(tuple, dataset.hamming_dedup(rows, "l", ["k % 7", "k"], "k", "bits", 5, 25).collect()))
    whole = kept()
    monkeypatch.setattr(dataset, "ROUND", 6)
    assert kept() == whole and len(whole) > 20
    free = sorted(map(tuple, dataset.hamming_dedup(rows, "l", ["k % 7", "k"], "k", "bits", 5, None).where("kept_rank <= 25").collect()))
    assert free == whole
    assert dataset.hamming_dedup(rows.limit(0), "l", ["k"], "k", "bits").count() == 0


def test_folders(spark):
    files = spark.createDataFrame([("d/a/x.json",), ("d/a/y.mkv",), ("d/b/x.json",), ("d\\c\\p.jpg",)], "path string")
    assert [r.folder for r in dataset.complete_folders(files, ["x.json", "y.mkv"]).collect()] == ["d/a"]
    assert tuple(dataset.folder_scan(files).collect()[-1]) == ("d", "c", "p.jpg")


def test_report_of_unpredicted_class(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "truth int, pred int")
    got = {r["class"]: r for r in metrics.report(rows, [0, 1, 2]).collect()}
    assert (got["1"].precision, got["1"].recall, got["2"].support) == (0.0, 0.0, 0)
    assert abs(got["0"].precision - 2 / 3) < 1e-12 and got["0"].recall == 1.0
    assert abs(got["accuracy"].f1 - 2 / 3) < 1e-12
    assert sum(r.n for r in metrics.confusion(rows, [0, 1, 2]).collect()) == 3


def test_two_predictions_on_one_truth(spark):
    kinds = "image string, {} long, box struct<x1: double, y1: double, x2: double, y2: double>"
    box = (0.0, 0.0, 10.0, 10.0)
    truths = spark.createDataFrame([("i", 1, box)], kinds.format("gt"))
    preds = spark.createDataFrame([("i", 1, box), ("i", 2, box), ("j", 1, box)], kinds.format("pred"))
    row = metrics.detection_scores(metrics.match_boxes(truths, preds, "image"), truths).first()
    assert (row.tp, row.fp, row.fn) == (1, 2, 0)


def test_joint_errors_skip_missing(spark):
    t = spark.createDataFrame([("i", "Head", 1.0, 1.0, 2.0), ("i", "Left Hip", 0.0, 0.0, 2.0), ("k", "Head", 1.0, 1.0, None)], "image string, joint string, x double, y double, norm double")
    p = spark.createDataFrame([("i", "Head", 1.0, 2.0), ("i", "Left Hip", 0.0, 0.0), ("k", "Head", 1.0, 1.0)], "image string, joint string, x double, y double")
    assert [(r.joint, r.error) for r in metrics.joint_errors(t, p, "image").collect()] == [("Head", 0.5)]


def test_first_match(spark):
    from framerank import schemas

    playlist = lambda *v: ("u", None, None, None, None, None, [(x,) for x in v], None)
    rows = [(1, "2-1", 0, None, ("goal", "", "S"), playlist("7", "7", "")), (2, None, 61, None, (None, None, None), playlist("7", "8", "0"))]
    tree = spark.createDataFrame(rows, "n int, " + schemas.EVENT)
    lists = {r.video_id: r.events for r in events.index_lists(tree, "n").collect()}
    assert lists == {"7": [1, 1, 2], "8": [2]}
    keys = spark.createDataFrame([("7",), ("8",), ("9",)], "video_id string")
    got = {r.video_id: r for r in events.first_match(keys, tree, "n").select("video_id", "matched", *events.metadata()).collect()}
    assert (got["7"].score, got["7"].scorer, got["7"].game_time) == ("2-1", "S", "00:00")
    assert (got["8"].score, got["8"].event_type, got["8"].game_time, got["8"].home_team) == ("0-0", "highlight", "01:01", "")
    assert not got["9"].matched


def test_ranking_end_to_end(spark):
    kinds = (
        "game_name string, clip_name string, video_id string, frame_idx long, frame_path string, pred_label string, confidence double, luminance double, sharpness double, uniformity double, texture double, "
        "num_faces int, face_area double, face_quality double, face_det_score double, face_visibility double, emotion_intensity double, emotion_label string, pose_score double, pose_label string, closeup double, "
        "iqa_norm double, logo_p double, embedding array<double>, aesthetic_score double"
    )
    label = "Close-up_player_or_field_referee"
    rows = []
    for i in range(12):
        e = [1.0, 0.0] if i < 6 else [0.0, 1.0]
        rows.append(("g", "c", "v1", i * 10, f"video_v1_frame_{i:05d}.jpg", label, 0.9, 80.0, 20.0, 0.5, 6.0, 1, 0.1, 0.8, 0.9, 0.9, 0.5, "Happiness", 0.4, "jump", 0.3, 0.5 + i / 100, 0.0, e, i / 20))
    got = ranking.rank_keyframes(spark.createDataFrame(rows, kinds)).orderBy("rank").collect()
    assert [(r["rank"], r.input_path) for r in got] == [(1, "video_v1_frame_00011.jpg"), (2, "video_v1_frame_00005.jpg")]
    best = got[0]
    assert abs(best.final_score - 1.2 * (0.35 * 0.61 + 0.25 * 0.8 + 0.15 * 0.5 + 0.15 * 0.4) / 0.9) < 1e-4
    assert best.saved_path == f"video_v1_rank01_P1_player_referee_conf0.90_score{best.final_score:.3f}.jpg"
    assert len(got[0]) == 24
    none = ranking.rank_keyframes(spark.createDataFrame(rows, kinds).where("frame_idx < 0"))
    assert none.count() == 0 and len(none.columns) == 24


@pytest.mark.parametrize("kind", ["clip", "phash"])
def test_long_segments_are_clustered_in_rounds(spark, kind):
    draw = np.random.default_rng(5)
    if kind == "clip":
        rows = [(g, i, [float(v) for v in draw.normal(size=4)]) for g, n in ((None, 9), (1, 1), (2, 150), (3, 40)) for i in range(n)]
        items, threshold = spark.createDataFrame(rows, "g int, i int, x array<double>"), 0.8
    else:
        rows = [(g, i, [int(draw.integers(0, 1 << 12)), 0]) for g, n in ((None, 9), (1, 1), (2, 150), (3, 40)) for i in range(n)]
        items, threshold = spark.createDataFrame(rows, "g int, i int, x array<bigint>"), 1 - 3 / 128
    want = sorted(map(tuple, redundancy.leader_clusters(items, "g", "i", "x", threshold, kind).collect()), key=str)
    assert len({(g, lead) for g, _, lead in want if g == 2}) > 20
    for batch in (7, 64, 1000):
        got = redundancy.long_leader_clusters(items, "g", "i", "x", threshold, kind, batch).collect()
        assert sorted(map(tuple, got), key=str) == want
    assert redundancy.long_leader_clusters(items.limit(0), "g", "i", "x", threshold, kind).count() == 0
