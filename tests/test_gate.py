from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trapline.config import Gate, Machine, Memory, frames, machine_from
from trapline.operators import gate, intervals, metrics, scan, temporal

OFF = Memory(enabled=False)


def trace(values, m):
    s = scan.State(m)
    return [s.step(i, float(v), v / 1000, 0.0, 0.0, np.array([v > 0]))[0] for i, v in enumerate(values)]


def plain(values, start, stay, k, post):
    """The gate by its description."""
    out, rec, hits, left = [], False, 0, 0
    for v in values:
        if rec:
            if v >= stay:
                left = post
            elif left > 0:
                left -= 1
            else:
                rec = False
        else:
            hits = hits + 1 if v >= start else 0
            if hits >= k:
                rec, hits, left = True, 0, post
        out.append(rec)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.integers(1, 4), st.integers(1, 4), st.integers(1, 3), st.integers(0, 4))
def test_scan_is_the_gate(values, start, stay, k, post):
    m = Machine(gate=Gate(start_threshold=start, start_consecutive=k, stay_metric="fg_pixels", stay_threshold=stay, post_roll_sec=post / 10, cnn_start_enabled=False), memory=OFF)
    assert trace(values, m) == plain(values, start, stay, k, post)


@pytest.mark.parametrize("start,stay,k,post,how", [(3, 3, 1, 3, "window"), (3, 3, 1, 0, "window"), (3, 2, 2, 2, "islands"), (3, 2, 3, 0, "islands"), (2, 3, 1, 2, "scan")])
def test_window_forms(spark, start, stay, k, post, how):
    rng = np.random.default_rng(start * 100 + stay * 10 + k)
    rows = [(v, i, float(x)) for v in range(40) for i, x in enumerate(rng.integers(0, 5, 60))]
    m = Machine(gate=Gate(start_threshold=start, start_consecutive=k, stay_metric="fg_pixels", stay_threshold=stay, post_roll_sec=post / 10, pre_roll_sec=0.2, cnn_start_enabled=False), memory=OFF)
    assert gate.plan_gate(m) == how
    df = spark.createDataFrame(rows, "video_id long, i long, fg_pixels double").withColumns({"fg_ratio": F.col("fg_pixels") / 1000, "cnn_p": F.lit(0.0), "luma": F.lit(0.0), "moved": F.lit(True)})
    got = {(r.video_id, r.i): (r.recording, r.decision) for r in gate.gate(df, m).collect()}
    for v in range(40):
        want = plain([x for w, _, x in rows if w == v], start, stay, k, post)
        begun = [r and not p for r, p in zip(want, [False, *want])]
        for i, r in enumerate(want):
            assert got[v, i] == (r, r or any(begun[i + 1 : i + 3]))


def test_stop_frame_is_dropped():
    m = Machine(gate=Gate(start_threshold=3, stay_metric="fg_ratio", stay_threshold=0.5, post_roll_sec=0, cnn_start_enabled=False), memory=OFF)
    assert trace([5, 5, 5, 5], m) == [True, False, True, False]


def test_disabled_keeps_all():
    assert trace([0, 0], Machine(gate=Gate(enabled=False), memory=OFF)) == [True, True]


def test_unknown_names():
    with pytest.raises(KeyError):
        Machine(gate=Gate(stay_metric="nothing"))
    with pytest.raises(TypeError):
        machine_from({"gate": {"nothing": 1}}, 30.0)
    m = machine_from({"gate": {"start_metric": "vibe_fg_pixels"}, "cnn": {"enabled": True, "model_path": "x"}, "adaptive": {"fp_guard": {"enabled": True}}}, 30.0)
    assert m.gate.start_metric == "fg_pixels" and m.scorer.enabled and m.adaptive.fp_guard.enabled
    assert replace(m, fps=10.0).fps == 10.0


def test_half_even():
    assert [frames(x / 10, 10, 0) for x in (5, 15, 25)] == [5, 15, 25]
    assert [frames(x, 1, 0) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_one_scorer_run_meets_two_hits():
    m = machine_from({"gate": {"start_threshold": 99, "cnn_start_requires_motion": False}, "cnn": {"enabled": True, "stride_idle_motion": 5, "start_requires_motion": False, "motion_min_fg_ratio": 0.0}}, 10.0)
    s = scan.State(m)
    out = [s.step(i, 0.0, 0.0, 0.9, 0.0, np.array([False]))[:2] for i in range(3)]
    assert [x[1] for x in out] == ["no_start", "start_cnn", "stay"]


def test_overlap_ties_and_fragments(spark):
    truth = spark.createDataFrame([(1, 10, 19), (1, 40, 49), (2, 0, 3)], "video_id long, gs long, ge long")
    found = spark.createDataFrame([(1, 8, 12), (1, 17, 21), (1, 45, 60)], "video_id long, s long, e long")
    got = sorted(map(tuple, intervals.best_overlap(truth, found).collect()))
    assert got == [(1, 10, 19, 8, 12, 3), (1, 40, 49, 45, 60, 5), (2, 0, 3, None, None, 0)]
    m = {r.video_id: r for r in metrics.event_metrics(truth.selectExpr("video_id", "gs s", "ge e"), found, spark.createDataFrame([(1,), (2,), (3,)], "video_id long"), F.lit(10.0)).collect()}
    # two fragments cover six frames of the first event; the best one counts
    assert m[1].Event_Recall == 1 and m[1].Animal_Coverage == pytest.approx((0.3 + 0.5) / 2)
    assert m[1].Mean_Trigger_Delay_Sec == pytest.approx(0.25) and m[1].Mean_Extra_Tail_Sec == pytest.approx(0.55)
    assert m[2].Event_Recall == 0 and m[3].Animal_Coverage == 0


def test_membership_over_bins(spark):
    f = spark.range(2000).selectExpr("1L video_id", "id i")
    iv = spark.createDataFrame([(1, 100, 900), (1, 800, 1000), (1, 1500, 1500)], "video_id long, s long, e long")
    got = {r.i for r in intervals.member(f, iv).where("gt").collect()}
    assert got == {*range(100, 1001), 1500}


def test_islands(spark):
    df = spark.createDataFrame([(1, i, i in (0, 1, 3, 5, 6)) for i in range(7)], "video_id long, i long, hit boolean")
    assert sorted(map(tuple, temporal.islands(df, F.col("hit")).collect())) == [(1, 0, 1), (1, 3, 3), (1, 5, 6)]


def test_packed_masks_follow_the_pixels(spark):
    m = Machine(gate=Gate(start_threshold=1, stay_metric="mhi_active_ratio", stay_threshold=0.01, post_roll_sec=0, cnn_start_enabled=False), memory=Memory(tau_sec=0.2))
    masks = [[1, 0, 0, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0], [0] * 8, [0] * 8]
    rows = [(1, i, float(sum(x)), sum(x) / 8, 0.0, 0.0, bytearray(np.packbits(x).tobytes())) for i, x in enumerate(masks)]
    df = spark.createDataFrame(rows, "video_id long, i long, fg_pixels double, fg_ratio double, cnn_p double, luma double, mask binary")
    assert [r.mhi_active_ratio for r in scan.run(df, m).orderBy("i").collect()] == [0.125, 0.25, 0.125, 0.0]
