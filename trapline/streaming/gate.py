"""The ordered state machine as a stream.

State per video is the machine itself and, where frames may come late, the frames that still
wait. Without a delay a micro-batch is taken as complete and processed by time at once; with
one, a frame waits until the watermark has passed it. Frames older than the last one
processed are dropped and counted in `late`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Machine
from ..operators.scan import State
from ..session import scratch

COLUMNS = ["ts", "seq", "fg_pixels", "fg_ratio", "cnn_p", "luma", "moved"]
OUT = "video_id long, i long, recording boolean, reason string, started boolean, p_frame double, late long"


def gate_stream(frames: DataFrame, machine: Machine, delay: str | None = None) -> DataFrame:
    """frames: a stream (video_id, ts timestamp, seq, fg_pixels, fg_ratio, cnn_p, luma, moved); seq breaks ties of ts."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine_state, waiting, i, last, late = pickle.loads(state.get[0]) if state.exists else (State(machine), [], 0, None, 0)
        rows = waiting + [r for b in batches for r in b[COLUMNS].itertuples(index=False, name=None)]
        rows.sort(key=lambda r: (r[0], r[1]))
        until = None
        if delay:
            until = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        out, waiting = [], []
        for r in rows:
            if until is not None and r[0] > until:
                waiting.append(r)
            elif last is not None and (r[0], r[1]) <= last:
                late += 1
            else:
                keep, reason, started, p, *_ = machine_state.step(i, r[2], r[3], r[4] or 0.0, r[5] or 0.0, np.array([bool(r[6])]))
                out.append((key[0], i, keep, reason, started, p, late))
                i, last = i + 1, (r[0], r[1])
        state.update((pickle.dumps((machine_state, waiting, i, last, late)),))
        if waiting:
            state.setTimeoutTimestamp(int(waiting[-1][0].timestamp() * 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    if delay:
        frames = frames.withWatermark("ts", delay)
    kind = GroupStateTimeout.EventTimeTimeout if delay else GroupStateTimeout.NoTimeout
    return frames.groupBy("video_id").applyInPandasWithState(step, OUT, "state binary", "append", kind)


def streaming_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid gate over `events` as a stream, drained into a table."""
    from ..plans.fixture import MOVES
    from ..plans.queries import HYBRID

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    frames = e.select(F.col("user_id").alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("fg_pixels"), (F.col("value") / 1000.0).alias("fg_ratio"), (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("cnn_p"), ((F.col("event_id") * 37) % 140).cast("double").alias("luma"), (F.col("value") >= MOVES).alias("moved"))
    path = scratch(spark, "streaming-gate")
    q = gate_stream(frames, HYBRID).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("video_id", "i", "recording", "reason", "started")
