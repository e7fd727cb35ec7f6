import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from trapline.config import machine_from
from trapline.plans import evaluate
from trapline.sources import annotations, manifest, tables

CASES = {
    "events": ({"events": [{"start_sec": 0.11, "end_sec": 0.5}, {"start_sec": 1.0, "end_sec": 1.0}]}, {(1, 4)}),
    "empty events win": ({"events": [{"start_sec": 1.0, "end_sec": 1.0}], "pos_frames": [4]}, set()),
    "pairs": ({"events": [], "intervals": [[7, 9], [3, 2], [0, 1]]}, {(0, 1), (7, 9)}),
    "objects": ({"gt_intervals": [{"start": 2, "end": 5}]}, {(2, 5)}),
    "frames": ({"gt_frames": [5, 3, 4, 4, 9]}, {(3, 5), (9, 9)}),
    "object": ({"frames": {"1": 0, "2": False, "3": "", "4": None, "5": [], "6": {}, "x": 1, "7": [0]}}, {(1, 3), (7, 7)}),
    "list": ({"frames": [{"frame_id": 3}, {"frame_id": None, "frame_idx": 9}, {"frame_idx": 4}, {"frame": 6}, 5, {"frame_id": "x"}]}, {(3, 4), (6, 6)}),
    "nothing": ({"other": 1}, set()),
    "broken": ("{", set()),
}


def test_annotations(spark):
    docs = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, (d, _) in enumerate(CASES.values())], "video_id long, doc string")
    got = annotations.extract(docs, F.lit(10.0)).collect()
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert {(r.s, r.e) for r in got if r.video_id == i} == want, name


def test_invalid_intervals_fall_through(spark):
    docs = spark.createDataFrame([(1, json.dumps({"intervals": [[5, 2]], "pos_frames": [7]}))], "video_id long, doc string")
    assert annotations.extract(docs, F.lit(10.0)).count() == 0
    assert [(r.s, r.e) for r in annotations.extract(docs, F.lit(10.0), True).collect()] == [(7, 7)]


def test_manifest_and_configs(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"items": [{"id": "a", "video_path": "a.mp4", "annotation_path": "a.json"}, {"id": "b", "video_path": "b.mp4", "annotation_path": "b.json", "fps": 25.0}]}, indent=1))
    assert manifest.items(spark, str(tmp_path / "m.json")).count() == 2
    assert [r.fps for r in manifest.items(spark, str(tmp_path / "m.json"), ["b"]).collect()] == [25.0]
    for n in ("zeta", "vibe_AT", "vibe", "alpha"):
        (tmp_path / f"{n}.yaml").write_text(yaml.safe_dump({"gate": {}}))
    assert [p.rsplit("/", 1)[1] for p in manifest.discover(str(tmp_path))] == ["vibe.yaml", "vibe_AT.yaml", "alpha.yaml", "zeta.yaml"]
    (tmp_path / "bad.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        manifest.load_config(str(tmp_path / "bad.yaml"))
    assert manifest.resolved("m.json", ["/nowhere", str(tmp_path)]) == str(tmp_path / "m.json") and manifest.resolved("no", []) == "no"
    assert manifest.output_paths({"output_csv": "r/x.csv"}) == ("r/x.csv", "r/x_detection_log.csv")


def test_frame_range(spark):
    f = spark.range(100).withColumnRenamed("id", "i")
    ends = lambda *a: [r.i for r in tables.frame_range(f, F.lit(10.0), *a).orderBy("i").collect()]
    assert ends(0.25, 0.45, F.lit(100)) == [2, 3, 4] and ends(9.5, None, F.lit(100)) == [95, 96, 97, 98, 99]
    assert ends(0.5, None, None) == [5]


def test_evaluate_and_sweep(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for v in (1, 2):
        base = rng.integers(90, 110, (24, 32))
        for i in range(30):
            g = base + rng.integers(-3, 4, base.shape)
            if 10 <= i < 20:
                g[6:16, i - 8 : i + 4] = 230
            rows.append((v, i, 24, 32, bytearray(g.astype(np.uint8).tobytes())))
    frames = spark.createDataFrame(rows, "video_id long, i long, height int, width int, gray binary")
    truth = spark.createDataFrame([(1, 10, 19), (2, 10, 19)], "video_id long, s long, e long")
    config = {"postprocess": {"median_blur_ksize": 3, "erode_iters": 1, "dilate_iters": 2}, "components": {"min_blob_area": 20, "max_blobs": 3}, "gate": {"start_threshold": 60.0, "stay_metric": "vibe_fg_pixels", "stay_threshold": 60.0, "post_roll_sec": 0.2}, "mhi": {"enabled": True}, "cnn": {"enabled": True, "stride_recording": 2}}
    log, summary = evaluate.evaluate(frames, truth, config, 10.0)
    assert log.count() == 60
    for r in summary.collect():
        assert r.Recall > 0.8 and r.Event_Recall == 1 and r.TP + r.FN == 10 and r.frames_processed > 0
    merged = evaluate.sweep(frames, truth, {"vibe": config, "mog2": {**config, "mog2": {}}}, 10.0)
    assert merged.count() == 4 and merged.columns[:2] == ["variant", "config_file"]
    tables.write_log(log, str(tmp_path / "log"))
    tables.write_summary(summary, str(tmp_path / "summary"))
    tables.write_merged(merged, str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 60
    assert tables.read_summary(spark, str(tmp_path / "summary")).where("total_frames = 30").count() == 2


def test_configuration_reaches_the_pixels(spark):
    """Colour, width, range, boxes and the mixture's own settings change what is evaluated."""
    rng = np.random.default_rng(0)
    shots = rng.integers(0, 40, (30, 8, 8, 3)).astype(np.uint8)
    shots[12:20, 2:7, 2:7] = (10, 200, 250)
    frames = spark.createDataFrame([(1, k, 8, 8, x.tobytes()) for k, x in enumerate(shots)], "video_id long, i long, height int, width int, bgr binary")
    truth = spark.createDataFrame([(1, 12, 19)], "video_id long, s long, e long")
    base = {"vibe": {"radius": 60}, "postprocess": {"median_blur_ksize": 1, "erode_iters": 0, "dilate_iters": 0, "min_blob_area": 2}, "mhi": {"enabled": False}, "gate": {"start_metric": "vibe_fg_pixels", "start_threshold": 3, "stay_metric": "vibe_fg_pixels", "stay_threshold": 3, "post_roll_sec": 0.0}}
    log, summary = evaluate.evaluate(frames, truth, base, 10.0)
    assert summary.first().TP == 8 and summary.first().FP == 0
    part = base | {"eval": {"start_sec": 0.5, "end_sec": 1.5}, "preprocess": {"resize_width": 4}, "motion_ema_alpha": 0.7}
    log, summary = evaluate.evaluate(frames, truth, part, 10.0)
    assert sorted(r.frame_id for r in log.collect()) == list(range(5, 16))
    assert summary.first().total_frames == 30 and machine_from(part, 10.0).motion_alpha == 0.7
    mixed = {k: v for k, v in base.items() if k != "vibe"} | {"mog2": {"history": 5, "detect_shadows": False, "threshold": 127}, "gate": {"start_metric": "mog2_fg_pixels", "start_threshold": 3, "stay_metric": "mog2_fg_pixels", "stay_threshold": 3, "post_roll_sec": 0.0}}
    assert evaluate.evaluate(frames, truth, mixed, 10.0, "mog2")[1].first().TP > 0
