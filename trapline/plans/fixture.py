"""The driver's tables seen as frames (events: per-frame metrics; embeddings: 8 x 8 gray frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FPS = 10.0
#: Pixels from which an event's frame, seen as one pixel, moves.
MOVES = 90.0


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("video_id"),
        (F.row_number().over(order) - 1).cast("long").alias("i"),
        F.col("value").alias("fg_pixels"),
        (F.col("value") / 1000.0).alias("fg_ratio"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("cnn_p"),
        ((F.col("event_id") * 37) % 140).cast("double").alias("luma"),
        F.col("event_type").isin("purchase", "signup").alias("gt"),
    ).withColumn("moved", F.col("fg_pixels") >= MOVES)


FRAMES_SQL = f"""f AS (SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS i, value AS fg_pixels, value / 1000.0 AS fg_ratio,
  json_extract_string(props, '$.k')::DOUBLE / 100.0 AS cnn_p, ((event_id * 37) % 140)::DOUBLE AS luma, event_type IN ('purchase', 'signup') AS gt, value >= {MOVES} AS moved FROM events)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, i, gt, gray array<int> of 64 pixels)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    gray = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint((x.cast("double") + 0.6) * 212.5))).cast("int"))
    return e.select(F.expr("vec_id div 50").alias("video_id"), (F.col("vec_id") % 50).alias("i"), (F.col("label") >= 5).alias("gt"), gray.alias("gray"))


PIXELS_SQL = """e AS (SELECT vec_id // 50 AS video_id, vec_id % 50 AS i, label >= 5 AS gt, [least(255, greatest(0, round_even((x::DOUBLE + 0.6) * 212.5, 0)))::INTEGER FOR x IN embedding] AS gray FROM embeddings)"""
