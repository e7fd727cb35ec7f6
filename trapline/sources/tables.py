"""Frame tables, logs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTION_LOG = "video_id string, frame_id long, ground_truth int, vibe_mask_ratio double, mhi_energy double, cnn_confidence double, final_decision int, inference_time_ms double, trigger_source string"
SUMMARY = "video_id string, total_frames long, frames_processed long, TP long, FP long, FN long, Precision double, Recall double, F1_Score double, Avg_FPS double, Storage_Saved_Pct double, Event_Recall double, Animal_Coverage double, Mean_Trigger_Delay_Sec double, Mean_Extra_Tail_Sec double"


def frame_range(df: DataFrame, fps: Column, start_sec: float = 0.0, end_sec: float | None = None, total: Column | None = None) -> DataFrame:
    """Frames of a time range, as a filter that reaches the scan. An unknown total keeps one frame at most."""
    first = F.greatest(F.lit(0).cast("long"), F.rint(F.lit(float(start_sec)) * fps).cast("long"))
    last = (F.lit(0) if total is None else F.coalesce(total, F.lit(0))).cast("long") - 1
    if end_sec is not None:
        last = F.least(last, F.rint(F.lit(float(end_sec)) * fps).cast("long"))
    return df.where((F.col("i") >= first) & (F.col("i") <= F.greatest(last, first)))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SUMMARY)


def write_log(df: DataFrame, path: str, form: str = "parquet") -> None:
    """The detection log in its nine columns, one folder per video; other columns are left out."""
    rows = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DETECTION_LOG.split(", ")])
    w = rows.write.mode("overwrite").partitionBy("video_id")
    w.option("header", True).csv(path) if form == "csv" else w.parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SUMMARY.split(", ")]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_merged(df: DataFrame, path: str) -> None:
    """A sweep's rows with the union of all columns; what a variant lacks stays empty."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def video_frames(spark: SparkSession, path: str, decode) -> DataFrame:
    """(path, i, height, width, gray) of video or image files. decode: bytes to an iterator of 2-D uint8 arrays; it
    stops at the first frame that it can't read. The library has no decoder of its own."""
    import pyarrow as pa

    def f(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                for i, g in enumerate(decode(content)):
                    yield pa.RecordBatch.from_pydict({"path": [name], "i": pa.array([i], pa.int64()), "height": pa.array([g.shape[0]], pa.int32()), "width": pa.array([g.shape[1]], pa.int32()), "gray": [g.tobytes()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(f, "path string, i long, height int, width int, gray binary")
