"""One configuration over frame tables: pixels, scorer, gate, log and summary; and sweeps of many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Crops, Machine, background_from, crops_from, machine_from, mixed_from, range_from
from ..config import frames as frames_of
from ..functions import labels
from ..operators import feedback, intervals, metrics, pixels, scan, scorer, temporal
from ..sources import tables


def candidates(m: Machine) -> Column:
    """Frames on which the schedule can ask for a score, whatever the gate does: a superset, so scores are computed in
    parallel before the ordered pass."""
    i, a, s = F.col("i"), m.adaptive, m.scorer
    out = F.lit(False)
    for n in [a.stride_rec_weak, a.stride_rec_nomotion, a.stride_idle_weak] if a.enabled else [s.stride_recording, s.stride_idle_motion]:
        out = out | (i % max(1, n) == 0)
    return out


def whole_candidates(m: Machine) -> Column:
    """Frames of which the schedule can ask for the score of the whole frame."""
    s = m.scorer
    if m.adaptive.enabled or s.idle_fullframe_stride_sec <= 0:
        return F.lit(False)
    return (F.col("i") % frames_of(s.idle_fullframe_stride_sec, m.fps, 1) == 0) & (F.col("fg_ratio") < s.motion_min_fg_ratio)


def with_scores(frames: DataFrame, px: DataFrame, m: Machine, crops: Crops, make: Callable, width: int | None) -> DataFrame:
    """px with cnn_p and, if the schedule can ask for whole frames, cnn_p_frame; both ahead of the gate."""
    see = {"size": crops.input_size, "head": crops.output, "positive": crops.positive_index, "width": width}
    asked = frames.join(px.where(candidates(m)).select("video_id", "i", "boxes"), ["video_id", "i"])
    out = px.join(scorer.score(asked, make, full_frame_if_no_crops=crops.full_frame_if_no_crops, **see), ["video_id", "i"], "left")
    if m.adaptive.enabled or m.scorer.idle_fullframe_stride_sec <= 0:
        return out
    whole = frames.join(px.where(whole_candidates(m)).select("video_id", "i", F.slice("boxes", 1, 0).alias("boxes")), ["video_id", "i"])
    return out.join(scorer.score(whole, make, **see).withColumnRenamed("cnn_p", "cnn_p_frame"), ["video_id", "i"], "left")


def evaluate(frames: DataFrame, truth: DataFrame, config: dict, fps: float, flavour: str = "vibe", make: Callable = scorer.contrast_scorer, warmup_sec: float | None = None) -> tuple[DataFrame, DataFrame]:
    """frames (video_id, i, height, width, gray or bgr) and truth (video_id, s, e) to the detection log and the summary.
    Storage saved is taken over all frames of a video, of which the configuration may name a range. Masks and scores are
    computed ahead of the gate, unless its guard changes the background model: then all three go in one pass."""
    m = machine_from(config, fps, flavour)
    background, post = background_from(config)
    part, crops = range_from(config), crops_from(config)
    total = frames.groupBy("video_id").agg((F.max("i") + 1).alias("total"))
    if part.start_sec or part.end_sec is not None:
        frames = tables.frame_range(frames, F.lit(fps), part.start_sec, part.end_sec, F.lit(1 << 40))
    see = {"grow": crops.expand_ratio, "pad": crops.pad_px, "min_crop": crops.min_crop_area, "max_crops": crops.max_crops, "width": part.resize_width}
    seed = int(config.get("rng_seed") or 0)
    if feedback.needed(m):
        px = None
    elif flavour == "vibe":
        px = pixels.vibe(frames, background, post, seed, **see)
    else:
        x = mixed_from(config)
        px = pixels.mog2(frames, post, x.history, x.var_threshold, x.detect_shadows, x.keep_shadows_as_fg, x.learning_rate, x.threshold, **see)
    if px is None:
        out = feedback.run(frames, m, background, post, crops, make, seed, part.resize_width)
    else:
        px = px.withColumnRenamed("mean_luma", "luma")
        px = with_scores(frames, px, m, crops, make, part.resize_width) if m.scorer.enabled else px.withColumn("cnn_p", F.lit(0.0))
        out = scan.run(px, m, ("fg_ratio",))
    out = scan.backfilled(out, m).join(total, "video_id")
    out = intervals.member(out, truth)
    warm = round((part.warmup_sec if warmup_sec is None else warmup_sec) * fps)
    runs = out.groupBy("video_id").agg(F.count_if("ran_cnn").alias("frames_processed"))
    scored = intervals.clipped(truth, F.lit(warm).cast("long"), F.lit(1 << 40))
    events = metrics.event_metrics(scored, temporal.islands(out, F.col("decision")), out, F.lit(fps))
    summary = metrics.frame_summary(out, warm, F.col("total")).join(runs, "video_id").join(events, "video_id")
    log = out.select("video_id", F.col("i").alias("frame_id"), F.col("gt").cast("int").alias("ground_truth"), F.col("fg_ratio").alias("vibe_mask_ratio"), F.col("mhi_energy" if flavour == "vibe" else "stay_score").alias("mhi_energy"), F.col("p_frame").alias("cnn_confidence"), F.col("decision").cast("int").alias("final_decision"), F.lit(0.0).alias("inference_time_ms"), labels.trigger_source(flavour, m.scorer.p_set, F.col("backfill")).alias("trigger_source"))
    return log, summary.withColumn("Avg_FPS", F.lit(None).cast("double"))


def sweep(frames: DataFrame, truth: DataFrame, configs: dict[str, dict], fps: float, flavour: Callable[[dict], str] = lambda c: "mog2" if "mog2" in c else "vibe") -> DataFrame:
    """Summaries of all configurations with variant and config_file first, missing columns empty."""
    out = None
    for name, config in configs.items():
        one = evaluate(frames, truth, config, fps, flavour(config))[1]
        one = one.select(F.lit(name).alias("variant"), F.lit(f"{name}.yaml").alias("config_file"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
