"""The guard's feedback into the background model, and scores of whole frames."""

from dataclasses import replace

import numpy as np

from trapline.config import Crops, Scorer, frames
from trapline.operators import feedback, pixels, scan, scorer
from trapline.operators.kernels import images
from trapline.operators.kernels.background import SampleBank
from trapline.operators.kernels.masks import cleaned, filtered
from trapline.plans import evaluate, queries

SF = "/root/testdata/sf0.001"


def by_video(df):
    out = {}
    for r in df.orderBy("video_id", "i").collect():
        out.setdefault(r.video_id, []).append(r)
    return out


def test_guard_hardens_the_frames_after_it_fires(spark):
    m, b = queries.HARDENED, queries.HARDENED_BANK
    g = m.adaptive.fp_guard
    hold = frames(g.hold_sec, m.fps, 1)
    shots = by_video(queries._gray_frames(spark, SF))
    seen = by_video(queries.guard_feedback(spark, SF))
    assert seen.keys() == shots.keys()
    hard_frames = 0
    for v, rows in seen.items():
        bank, k = SampleBank(b, 0, v), -1
        for r, shot in zip(rows, shots[v], strict=True):
            k = k + 1 if r.guard_active else -1
            hard = r.guard_active and k % (hold + 1) != 0
            hard_frames += hard
            assert (r.min_matches, r.update_period) == ((b.min_matches + g.min_matches_boost, round(b.subsampling_factor / g.update_sf_div)) if hard else (b.min_matches, b.subsampling_factor))
            bank.boost, bank.divide = (g.min_matches_boost, g.update_sf_div) if hard else (0, 1.0)
            kept = filtered(cleaned(bank.apply(images.frame(shot.gray, 8, 8)), queries.SMALL), queries.SMALL.min_blob_area, queries.SMALL.max_blobs)
            assert r.fg_pixels == kept.sum()
    assert hard_frames


def test_without_effect_on_the_model_it_equals_the_separate_steps(spark):
    m, b, c = queries.HARDENED, queries.HARDENED_BANK, queries.HARDENED_CROPS
    m = replace(m, adaptive=replace(m.adaptive, fp_guard=replace(m.adaptive.fp_guard, min_matches_boost=0, update_sf_div=1.0)))
    assert feedback.needed(queries.HARDENED) and not feedback.needed(m)
    shots = queries._gray_frames(spark, SF)
    one = feedback.run(shots, m, b, queries.SMALL, c).select(*scan_columns())
    px = pixels.vibe(shots, b, queries.SMALL, grow=c.expand_ratio, pad=c.pad_px, min_crop=c.min_crop_area, max_crops=c.max_crops).withColumnRenamed("mean_luma", "luma")
    two = scan.run(evaluate.with_scores(shots, px, m, c, scorer.contrast_scorer, None), m).select(*scan_columns())
    a, b = sorted(map(tuple, one.collect()), key=lambda r: r[:2]), sorted(map(tuple, two.collect()), key=lambda r: r[:2])
    assert a == b and any(r[-1] for r in a)


def scan_columns():
    return [c.split()[0] for c in scan.OUT.split(", ")]


def test_idle_frames_are_scored_whole(spark):
    """Where nothing moves the scorer sees the whole frame, elsewhere the boxes."""
    still = np.tile(np.uint8([[0, 255], [255, 0]]), (5, 5))
    rows = []
    for i in range(20):
        g = still.copy()
        if i >= 12:
            g[2:8, 2:8] = 128
        rows.append((1, i, 10, 10, bytearray(g.tobytes())))
    shots = spark.createDataFrame(rows, "video_id long, i long, height int, width int, gray binary")
    m = replace(queries.HYBRID, scorer=Scorer(enabled=True, stride_recording=2, stride_idle_motion=2, idle_fullframe_stride_sec=0.4))
    px = pixels.vibe(shots, queries.HARDENED_BANK, queries.SMALL, min_crop=1, grow=1.0, pad=0).withColumnRenamed("mean_luma", "luma")
    c = Crops(input_size=10, output="sigmoid", full_frame_if_no_crops=False)
    got = {r.i: r for r in scan.run(evaluate.with_scores(shots, px, m, c, scorer.contrast_scorer, None), m).collect()}
    run = scorer.contrast_scorer()
    whole = float(scorer.probability(run(np.stack(scorer.crops(still, None, 10, scorer.MEAN, scorer.STD))), "sigmoid")[0])
    for i in range(12):
        assert got[i].ran_cnn == (i % 4 == 0) and (i % 4 or abs(got[i].p_frame - whole) < 1e-9)
    assert got[12].motion_present and got[12].ran_cnn and abs(got[12].p_frame - whole) > 0.01


def test_masks_count_their_own_pixels(spark):
    """A mask whose size isn't a multiple of eight has no pixels beyond its own."""
    df = spark.createDataFrame([(1, 0, 9.0, 1.0, 0.0, 0.0, bytearray(np.packbits(np.ones(9, bool)).tobytes()), 3, 3)], "video_id long, i long, fg_pixels double, fg_ratio double, cnn_p double, luma double, mask binary, height int, width int")
    assert scan.run(df, queries.HYBRID).first().mhi_active_ratio == 1.0


def test_evaluate_takes_the_guard_from_a_configuration(spark):
    rng = np.random.default_rng(5)
    shots = rng.integers(0, 60, (40, 8, 8)).astype(np.uint8)
    frames = spark.createDataFrame([(1, k, 8, 8, bytearray(x.tobytes())) for k, x in enumerate(shots)], "video_id long, i long, height int, width int, gray binary")
    truth = spark.createDataFrame([(1, 5, 9)], "video_id long, s long, e long")
    config = {"vibe": {"radius": 20}, "postprocess": {"median_blur_ksize": 1, "erode_iters": 0, "dilate_iters": 0, "min_blob_area": 1}, "gate": {"start_metric": "vibe_fg_pixels", "start_threshold": 1}, "cnn": {"enabled": True, "input_size": 8}, "adaptive": {"enabled": True, "cnn_motion_high_fg_ratio": 0.9, "stride_rec_weak": 1, "stride_idle_weak": 1}}
    guard = {"enabled": True, "night_luma_threshold": 256.0, "negative_p": 1.1, "negative_streak_to_activate": 1, "hold_sec": 0.5}
    ratios = []
    for g in ({"enabled": False}, {**guard, "min_matches_boost": 6, "update_sf_div": 0.0}):
        log, _ = evaluate.evaluate(frames, truth, config | {"adaptive": config["adaptive"] | {"fp_guard": g}}, 10.0)
        ratios.append([r.vibe_mask_ratio for r in log.orderBy("frame_id").collect()])
    assert len(ratios[0]) == len(ratios[1]) == 40 and sum(ratios[1]) > sum(ratios[0])
