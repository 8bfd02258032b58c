"""Sources, sinks and streaming."""

import datetime
import json
import time

import pytest

from framerank import schemas
from framerank.sources import files, rest
from framerank.streaming import live


def test_csv_sources(spark, tmp_path):
    (tmp_path / "p.csv").write_text("game_name,clip_name,frame_path,pred_label,confidence\ng,c,d/video_7_frame_00012.jpg,Public,0.5\ng,c,x.jpg,Public,NaN\n")
    rows = files.predictions(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.frame_idx, r.confidence) for r in rows] == [(12, 0.5), (None, None)]
    (tmp_path / "s.csv").write_text("segment_id,game_name,clip_name,priority,num_frames,start_frame,end_frame\n0,g,c,P1,3,f_1.jpg,f_9.jpg\n")
    assert [(r.start_index, r.end_index) for r in files.segments(spark, str(tmp_path / "s.csv")).collect()] == [(1, 9)]


def test_results(spark, tmp_path):
    names = [c.rsplit(" ", 1)[0].strip() for c in schemas.KEYFRAMES.split(",")]
    kinds = spark.createDataFrame([], schemas.KEYFRAMES).schema
    row = {n: None for n in names} | {"rank": 1, "final_score": 0.5, "saved_path": "out/a.jpg"}
    files.write_csv(spark.createDataFrame([tuple(row[n] for n in names)], kinds), str(tmp_path / "k"))
    shown = files.gallery(spark, str(tmp_path / "k")).collect()
    assert [(r.filename, r.final_score, r.w_iqa) for r in shown] == [("a.jpg", 0.5, 0.0)]
    assert files.result_of(spark, str(tmp_path / "k"), "a.jpg").count() == 1
    files.write_csv(spark.createDataFrame([], kinds), str(tmp_path / "none"))
    assert next((tmp_path / "none").glob("part*")).read_text().startswith("video_id,rank,")


def test_json_sources(spark, tmp_path):
    (tmp_path / "coco.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a"}], "annotations": [{"image_id": 1, "bbox": [1, 2, 3, 4]}]}))
    row = files.coco(spark, str(tmp_path / "coco.json")).first()
    assert (row.file_name, tuple(row.box)) == ("a", (1.0, 2.0, 4.0, 6.0))
    (tmp_path / "pose.json").write_text(json.dumps({"keypoint_2d": {"0": {"name": "Head", "x": 1, "y": 2}, "1": {"name": "Tail", "x": 1, "y": 2}}}))
    assert [(r.joint, r.x) for r in files.pose_truth(spark, str(tmp_path / "pose.json"), ["Head"]).collect()] == [("Head", 1.0)]
    (tmp_path / "bad.json").write_text("{")
    assert files.json(spark, str(tmp_path / "bad.json"), schemas.ANNOTATIONS).first().annotations is None
    (tmp_path / "ev.json").write_text(json.dumps({"events": [{"score": "1-0", "playlist": {"events": [{"video_asset_id": "7"}], "game": {"home_team": {"name": "A"}}}}]}))
    got = files.events(spark, str(tmp_path / "ev.json")).first()
    assert (got.score, got.playlist.events[0].video_asset_id, got.playlist.game.home_team.name) == ("1-0", "7", "A")


def test_listing_and_sinks(spark, tmp_path):
    for n in ("g/l/a.jpg", "g/l/b.png", "g/l/c.txt"):
        (tmp_path / "pics" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "pics" / n).write_bytes(b"x")
    assert files.listing(spark, str(tmp_path / "pics")).count() == 2
    rows = spark.createDataFrame([("l", "g", "f"), ("l", "h", "f"), ("m", "g", "f")], "label string, game string, filename string")
    files.write_dataset(rows, str(tmp_path / "data"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "data/label_counts"), header=True).collect()] == [("l", "2"), ("m", "1")]
    files.write_by_segment(spark.createDataFrame([(3, "P1", 5)], "segment_id int, priority string, i int"), str(tmp_path / "seg"))
    assert (tmp_path / "seg/folder=segment_003_P1").is_dir()
    frames = spark.createDataFrame([(i, 25.0) for i in range(6)], "frame_idx long, fps double")
    assert [r.frame_idx for r in files.every(frames, "fps", 12).collect()] == [0, 2, 4]


def test_pictures_and_zip(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"abc")
    rows = spark.createDataFrame([(f"file://{tmp_path}/a.jpg", "r1.jpg")], "input_path string, saved_path string")
    files.write_pictures(rows, f"file://{tmp_path}/out")
    assert (tmp_path / "out/r1.jpg").read_bytes() == b"abc"
    assert files.zip_results(str(tmp_path / "out"), str(tmp_path / "all.zip")) == ["r1.jpg"]


def test_command_line(spark, tmp_path):
    from framerank.__main__ import config, main

    cfg = config(["--predictions", "p", "--signals", "s", "--output", "o", "--fps", "99", "--w_iqa", "0", "--no_redundancy", "--top_n", "3"])[1]
    assert (cfg.fps, cfg.redundancy, cfg.top_n, cfg.weights["iqa"]) == (24, None, 3, 0.0)
    with __import__("pytest").raises(SystemExit):
        config(["--unknown"])
    (tmp_path / "p.csv").write_text("game_name,clip_name,frame_path,pred_label,confidence\n" + "".join(f"g,c,video_7_frame_{i:05d}.jpg,Close-up_corner,0.9\n" for i in range(6)))
    rows = [(f"video_7_frame_{i:05d}.jpg", 80.0, 20.0, 0.5, 6.0, 1, 0.1, 0.8, 0.9, 0.9, 0.5, "Fear", 0.4, "jump", 0.3, 0.5, 0.0, [1.0, float(i % 2)], 0.5) for i in range(6)]
    spark.createDataFrame(rows, f"frame_path string, {schemas.METRICS}, {schemas.SIGNALS}, embedding array<double>, aesthetic_score double").write.parquet(str(tmp_path / "s"))
    main(["--predictions", str(tmp_path / "p.csv"), "--signals", str(tmp_path / "s"), "--output", str(tmp_path / "k"), "--top_n", "3"])
    got = spark.read.schema(schemas.KEYFRAMES).csv(str(tmp_path / "k"), header=True).collect()
    assert [(r.video_id, r["rank"], r.segment_priority) for r in got] == [("7", 1, "P2_corner")]


def test_paged_source(spark, tmp_path):
    asked = []

    def fetch(address):
        asked.append(address)
        at = int(address.rsplit("from=", 1)[1])
        if at > 2:
            raise OSError
        return {"events": [{"i": at}, {"i": at + 1}]}

    assert [e["i"] for e in rest.pages(fetch, "u", {"a": "b"}, 2)] == [0, 1, 2, 3] and asked[0] == "u?a=b&count=2&from=0"
    with pytest.raises(OSError):
        list(rest.pages(fetch, "u", {"a": "b"}, 2, strict=True))
    (tmp_path / "page.json").write_text(json.dumps({"events": [{"score": "1-0"}]}))
    spark.dataSource.register(rest.PagedEvents)
    rows = spark.read.format("paged_events").options(url=f"file://{tmp_path}/page.json", ranges="2024..2025,2025..2026", page="5").load().collect()
    assert sorted(r.range_start for r in rows) == ["2024", "2025"] and json.loads(rows[0].event) == {"score": "1-0"}
    gone = spark.read.format("paged_events").options(url=f"file://{tmp_path}/none.json", ranges="2024..2025")
    assert gone.load().count() == 0
    with pytest.raises(Exception, match="none.json"):
        gone.option("strict", "true").load().collect()


def test_resources_of_a_clock(spark, tmp_path):
    batch = live.with_resources(spark.sql("SELECT timestamp '2024-01-01' AS timestamp, id AS value FROM range(3)")).collect()
    assert len(batch) == 3 and all(r.host and 0 <= r.cpu_pct <= 100 and r.used_mib > 0 and r.gpu_pct >= 0 and r.gpu_mib >= 0 for r in batch)
    q = live.with_resources(live.samples(spark)).writeStream.format("memory").queryName("used").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for _ in range(60):
            if spark.table("used").count():
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert spark.table("used").where("used_mib > 0").count()


def test_progress(spark):
    lines = spark.createDataFrame([("x [STEP 2] y",), ("[DONE]",), ("other",)], "line string")
    assert [tuple(r[0]) for r in lines.select(live.progress("line")).collect()] == [("[STEP 2]", 50), ("Complete", 100), (None, None)]
    now = [0.0]
    made = []
    value = live.Expiring(lambda: made.append(1) or len(made), 300, lambda: now[0])
    assert value.get() == 1 and value.get() == 1
    now[0] = 301
    assert value.get() == 2


def test_live_segments_match_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    labels = ["a", "a", "a", "b", "b", "a", "a", "a", "a", "c"]
    rows = [("k", i, label, base + datetime.timedelta(seconds=i)) for i, label in enumerate(labels)]
    rows.append(("z", 0, "x", base + datetime.timedelta(hours=1)))
    kinds = "clip_id string, frame_idx long, pred_label string, ts timestamp"
    for n, part in enumerate((rows[:4], rows[4:10], rows[10:], [("z", 1, "x", base + datetime.timedelta(hours=2))])):
        spark.createDataFrame(part, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    told = []
    listener = live.ProgressListener(told.append)
    spark.streams.addListener(listener)
    q = live.live_segments(stream, 3).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.start_index, r.end_index, r.pred_label, r.num_frames) for r in spark.table("live").collect() if r.clip_id == "k")
    assert got == [(0, 2, "a", 3), (5, 8, "a", 4)]
    spark.streams.removeListener(listener)
    assert any(t["stage"] == "Running" for t in told)
