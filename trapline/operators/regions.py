"""Components of masks, and array forms of the per-frame kernels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import masks


def match_count(samples: Column, value: Column, radius: int) -> Column:
    """How many stored samples are nearer than radius."""
    return F.size(F.filter(samples, lambda s: F.abs(s - value) < radius))


TOP = "video_id long, i long, rank int, area long, x int, y int, w int, h int"


def largest(frames: DataFrame, least: int, most: int, width: int) -> DataFrame:
    """(video_id, i, rank, area, x, y, w, h) of the largest components (8 neighbours) of frames (video_id, i, mask
    array<boolean>): each frame is labelled where its row is, nothing is shuffled."""
    names = [c.split()[0] for c in TOP.split(", ")]

    def f(batches):
        for batch in batches:
            out = []
            for video, i, mask in zip(batch["video_id"].to_pylist(), batch["i"].to_pylist(), batch["mask"], strict=True):
                mask = mask.values.to_numpy(zero_copy_only=False).astype(bool).reshape(-1, width)
                _, stats = masks.components(mask)
                out += [(video, i, rank, *stats[k].tolist()) for rank, k in enumerate(masks.largest(stats, least, most), 1)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return frames.select("video_id", "i", "mask").mapInArrow(f, TOP)
