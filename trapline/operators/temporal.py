"""Per-video temporal operators as window expressions (frames ordered by `i` in `video_id`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def video() -> W:
    """A video in the order of its frames."""
    return W.partitionBy("video_id").orderBy("i")


def so_far() -> W:
    return video().rowsBetween(W.unboundedPreceding, W.currentRow)


def countdown(hit: Column, tau: int) -> Column:
    """A memory that a hit sets to tau and every other frame lowers by one, to no less than zero."""
    last = F.max(F.when(hit, F.col("i"))).over(so_far())
    return F.greatest(F.lit(0), F.coalesce(tau - (F.col("i") - last), F.lit(0))).cast("int")


def since(hit: Column, start: int) -> Column:
    """Frames since the last hit; `start` + 1, + 2, ... before the first."""
    return F.coalesce(F.col("i") - F.max(F.when(hit, F.col("i"))).over(so_far()), start + F.row_number().over(video())).cast("long")


def sticky(value: Column, ran: Column, default: float = 0.0) -> Column:
    """The value of the last frame on which it was taken."""
    return F.coalesce(F.last(F.when(ran, value), ignorenulls=True).over(so_far()), F.lit(default))


def any_within(hit: Column, before: int) -> Column:
    """A hit on this frame or the `before` frames before it."""
    return F.coalesce(F.max(hit).over(video().rowsBetween(-before, 0)), F.lit(False))


def starts_ahead(start: Column, pre: int) -> Column:
    """A start on one of the next `pre` frames."""
    return F.coalesce(F.max(start).over(video().rowsBetween(1, pre)), F.lit(False))


def streak(hit: Column, k: int) -> Column:
    """k successive hits end here."""
    return (F.sum(hit.cast("int")).over(video().rowsBetween(1 - k, 0)) == k) & (F.count(F.lit(1)).over(video().rowsBetween(1 - k, 0)) == k)


def ema(df: DataFrame, value: str, alpha: float, out: str, seed: float | None = 0.0) -> DataFrame:
    """Exponential average; seed None starts with the first value. Weights decay, so the closed form over
    the frames of a video is a native fold of its ordered values."""
    seq = df.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v")))).alias("s"))
    first = F.col("s")[0]["v"] if seed is None else F.lit(float(seed))
    # (average so far, averages of all frames); a fold appends one number a frame
    fold = F.aggregate("s", F.struct(first.alias("e"), F.array().cast("array<double>").alias("all")), lambda acc, x: F.struct((F.lit(alpha) * x["v"] + F.lit(1.0 - alpha) * acc["e"]).alias("e"), F.array_append(acc["all"], F.lit(alpha) * x["v"] + F.lit(1.0 - alpha) * acc["e"]).alias("all")), lambda acc: acc["all"])
    return seq.select("video_id", F.explode(F.arrays_zip(F.col("s.i").alias("i"), fold.alias("e"))).alias("z")).select("video_id", F.col("z.i").alias("i"), F.col("z.e").alias(out))


def islands(df: DataFrame, hit: Column) -> DataFrame:
    """Runs of hits on successive frames as (video_id, s, e), both ends included."""
    hits = df.where(hit).select("video_id", "i")
    runs = hits.withColumn("g", F.col("i") - F.row_number().over(video()))
    return runs.groupBy("video_id", "g").agg(F.min("i").alias("s"), F.max("i").alias("e")).drop("g")
