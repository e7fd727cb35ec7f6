"""Interval algebra. Intervals are rows (video_id, s, e) with both ends included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clipped(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Intervals cut to [lo, hi]; what lies outside goes."""
    return df.withColumn("s", F.greatest("s", lo)).withColumn("e", F.least("e", hi)).where("s <= e")


def from_seconds(events: DataFrame, fps: Column) -> DataFrame:
    """(video_id, start_sec, end_sec) to frames: floor of the start, ceiling of the end less one, not below frame 0."""
    s, e = F.greatest(F.lit(0).cast("long"), F.floor(F.col("start_sec") * fps)), F.ceil(F.col("end_sec") * fps) - 1
    return events.select("video_id", s.cast("long").alias("s"), e.cast("long").alias("e")).where("e >= s")


def member(frames: DataFrame, intervals: DataFrame, into: str = "gt", bin_size: int = 256) -> DataFrame:
    """Whether some interval holds the frame. Frames and intervals meet in bins of the frame axis, so the
    join is an equi-join on (video, bin) that no long video makes one task's work."""
    bins = intervals.select("video_id", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / bin_size), F.floor(F.col("e") / bin_size))).alias("bin"))
    held = frames.select("video_id", "i", F.floor(F.col("i") / bin_size).alias("bin")).join(bins, ["video_id", "bin"]).where("i between s and e").select("video_id", "i").distinct()
    return frames.join(held.withColumn(into, F.lit(True)), ["video_id", "i"], "left").withColumn(into, F.coalesce(into, F.lit(False)))


def best_overlap(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Each true interval (video_id, gs, ge) with the one found interval (ps, pe) that overlaps it most, the earliest
    on a tie; nulls where none does. overlap counts frames."""
    p = found.select("video_id", F.col("s").alias("ps"), F.col("e").alias("pe"))
    overlap = F.least("ge", "pe") - F.greatest("gs", "ps") + 1
    pairs = truth.join(p, "video_id").withColumn("overlap", overlap).where("overlap > 0")
    best = pairs.groupBy("video_id", "gs", "ge").agg(F.max_by(F.struct("ps", "pe", "overlap"), F.struct("overlap", (-F.col("ps")).alias("early"))).alias("b"))
    return truth.join(best, ["video_id", "gs", "ge"], "left").select("video_id", "gs", "ge", "b.ps", "b.pe", F.coalesce("b.overlap", F.lit(0)).cast("long").alias("overlap"))


def ordered(df: DataFrame) -> DataFrame:
    """Interval numbers by start within a video."""
    return df.withColumn("seg_id", F.row_number().over(W.partitionBy("video_id").orderBy("s", "e")) - 1)
