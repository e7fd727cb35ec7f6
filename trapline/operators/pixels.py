"""Frames to masks and scores: background model and clean-up, streamed per video.

Rows are hashed by video and sorted by frame; a task holds one video's model and one Arrow
batch. A long video is one task's work, as its model carries over from frame to frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Background, Postprocess
from .kernels import images, masks
from .kernels.background import Mixture, SampleBank, foreground

OUT = "video_id long, i long, height int, width int, mean_luma double, fg_pixels double, fg_ratio double, min_matches int, update_period int, mask binary, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>"


def measured(image: np.ndarray, model: Callable, post: Postprocess, grow: float, pad: int, min_crop: int, max_crops: int, unfiltered: bool) -> tuple:
    """A frame (gray or BGR) by a video's model: OUT without keys, with the mask as an array of pixels."""
    gray = images.gray(image)
    mask, matches, period = model(gray)
    clean = masks.cleaned(mask, post)
    kept = masks.filtered(clean, post.min_blob_area, post.max_blobs)
    found = [dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)) for b in masks.boxes(clean if unfiltered else kept, min_crop, max_crops, grow, pad)]
    n = int(kept.sum())
    return *gray.shape, float(gray.mean()) if gray.size else 0.0, float(n), n / max(1, gray.size), matches, period, kept, found


def _stream(frames: DataFrame, make: Callable, post: Postprocess, grow: float, pad: int, min_crop: int, max_crops: int, unfiltered: bool, width: int | None) -> DataFrame:
    names = [c.split()[0] for c in OUT.split(", ")]
    stored = "bgr" if "bgr" in frames.columns else "gray"

    def f(batches):
        video, model = object(), None
        for batch in batches:
            out = []
            for v, i, h, w, raw in zip(*(batch[c].to_pylist() for c in ("video_id", "i", "height", "width", stored)), strict=True):
                if v != video:
                    video, model = v, make(v)
                *measures, kept, found = measured(images.frame(raw, h, w, width), model, post, grow, pad, min_crop, max_crops, unfiltered)
                out.append((v, i, *measures, np.packbits(kept).tobytes(), found))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 3, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return frames.select("video_id", "i", "height", "width", stored).repartition("video_id").sortWithinPartitions("video_id", "i").mapInArrow(f, OUT)


def vibe(frames: DataFrame, background: Background, post: Postprocess, seed: int = 0, grow: float = 1.35, pad: int = 4, min_crop: int = 160, max_crops: int = 3, width: int | None = None) -> DataFrame:
    """frames (video_id, i, height, width, and gray or bgr binary) to scores and masks (OUT) at a width; boxes come
    from the mask before the component filter."""

    def make(video):
        bank = SampleBank(background, seed, video)

        def step(gray):
            mask = bank.apply(gray)
            return mask, bank.matches_needed(), bank.period()

        return step

    return _stream(frames, make, post, grow, pad, min_crop, max_crops, True, width)


def mog2(frames: DataFrame, post: Postprocess, history: int = 500, var_threshold: float = 16.0, shadows: bool = True, keep_shadows: bool = False, learning_rate: float = -1.0, threshold: int = 200, grow: float = 1.35, pad: int = 4, min_crop: int = 160, max_crops: int = 3, width: int | None = None) -> DataFrame:
    """The same by a Gaussian mixture; boxes come from the filtered mask."""

    def make(_):
        model = Mixture(history, var_threshold, shadows, learning_rate)
        return lambda gray: (foreground(model.apply(gray), shadows, keep_shadows, threshold), 0, 0)

    return _stream(frames, make, post, grow, pad, min_crop, max_crops, False, width)
