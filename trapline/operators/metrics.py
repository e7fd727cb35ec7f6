"""Scores of gate decisions against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import frames_to_sec, ratio
from .intervals import best_overlap


def confusion(truth: Column, kept: Column, scored: Column | None = None) -> list[Column]:
    ok = F.lit(True) if scored is None else scored
    count = lambda c, name: F.count_if(c & ok).alias(name)
    return [count(truth & kept, "TP"), count(~truth & kept, "FP"), count(truth & ~kept, "FN"), count(~truth & ~kept, "TN")]


def rates(df: DataFrame) -> DataFrame:
    """Adds Precision, Recall and F1_Score from TP, FP and FN; 0 where undefined."""
    out = df.withColumn("Precision", ratio(F.col("TP"), F.col("TP") + F.col("FP"))).withColumn("Recall", ratio(F.col("TP"), F.col("TP") + F.col("FN")))
    return out.withColumn("F1_Score", ratio(2.0 * F.col("Precision") * F.col("Recall"), F.col("Precision") + F.col("Recall")))


def frame_summary(df: DataFrame, warmup: int = 0, total: Column | None = None) -> DataFrame:
    """Per video: counts on the frames after warm-up, rates, and storage saved over all frames of the file
    (`total` where the scanned range is a part of it). One pass, partial sums before the shuffle."""
    sums = df.withColumn("scored", F.col("i") >= warmup) if warmup else df.withColumn("scored", F.lit(True))
    out = sums.groupBy("video_id").agg(F.count("*").alias("processed"), F.max(total if total is not None else F.lit(None).cast("long")).alias("t"), F.count_if("decision").alias("kept"), *confusion(F.col("gt"), F.col("decision"), F.col("scored")))
    out = out.withColumn("total_frames", F.coalesce("t", "processed"))
    return rates(out).withColumn("Storage_Saved_Pct", F.when(F.col("total_frames") > 0, (1.0 - F.col("kept") / F.col("total_frames")) * 100.0).otherwise(0.0)).drop("t")


def event_metrics(truth: DataFrame, found: DataFrame, videos: DataFrame, fps: Column) -> DataFrame:
    """Per video of `videos`: Event_Recall, Animal_Coverage over all true events, Mean_Trigger_Delay_Sec and
    Mean_Extra_Tail_Sec over detected ones; 0 without events."""
    best = best_overlap(truth.select("video_id", F.col("s").alias("gs"), F.col("e").alias("ge")), found)
    hit = F.col("overlap") > 0
    per = best.groupBy("video_id").agg(
        F.avg(hit.cast("double")).alias("Event_Recall"),
        F.avg(F.col("overlap") / (F.col("ge") - F.col("gs") + 1)).alias("Animal_Coverage"),
        F.avg(F.when(hit, frames_to_sec(F.greatest(F.lit(0), F.col("ps") - F.col("gs")), fps))).alias("Mean_Trigger_Delay_Sec"),
        F.avg(F.when(hit, frames_to_sec(F.greatest(F.lit(0), F.col("pe") - F.col("ge")), fps))).alias("Mean_Extra_Tail_Sec"),
    )
    names = ["Event_Recall", "Animal_Coverage", "Mean_Trigger_Delay_Sec", "Mean_Extra_Tail_Sec"]
    return videos.select("video_id").distinct().join(per, "video_id", "left").select("video_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def legacy_summary(log: DataFrame) -> DataFrame:
    """The older summary with TN; log has video_id, ground_truth, final_decision, trigger_stage, time_ms."""
    out = log.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if(F.col("trigger_stage") != "none").alias("processed"), *confusion(F.col("ground_truth") == 1, F.col("final_decision") == 1), F.sum("time_ms").alias("ms"))
    out = rates(out)
    return out.select("video_id", "total", "processed", "TP", "FP", "FN", "TN", *[F.round(c, 4).alias(c) for c in ("Precision", "Recall", "F1_Score")], F.round(F.when(F.col("ms") > 0, F.col("total") / (F.col("ms") / 1000.0)).otherwise(0.0), 2).alias("Avg_FPS"), F.round((1.0 - (F.col("TP") + F.col("FP")) / F.col("total")) * 100.0, 2).alias("Storage_Saved_Pct"))


def leaderboard(summary: DataFrame) -> DataFrame:
    """Per variant: micro rates from summed counts; event means weighted by true frames, storage by all frames."""
    gt = F.col("TP") + F.col("FN")
    weighted = lambda c, w: ratio(F.sum(F.col(c) * w), F.sum(w)).alias(c)
    out = summary.groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN")], *[weighted(c, gt) for c in ("Animal_Coverage", "Mean_Trigger_Delay_Sec", "Mean_Extra_Tail_Sec")], weighted("Storage_Saved_Pct", F.col("total_frames")))
    return rates(out)
