"""Pixels, scorer and gate in one ordered pass, where the gate's state changes the background model.

The night guard raises the matches that a background pixel needs and shortens the update period
while it holds, so masks of later frames depend on scores of earlier ones: nothing can be computed
ahead. Rows are hashed by video and sorted by frame; the scorer runs only on frames that the
schedule asks for. `pixels`, `scorer` and `scan` are used apart wherever there is no such feedback.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Background, Crops, Machine, Postprocess
from . import scan, scorer
from .kernels import images
from .kernels.background import SampleBank
from .pixels import measured

OUT = f"{scan.OUT}, fg_pixels double, fg_ratio double, min_matches int, update_period int"


def needed(m: Machine) -> bool:
    """Whether the guard can change the background model."""
    g = m.adaptive.fp_guard
    return m.flavour == "vibe" and m.scorer.enabled and m.adaptive.enabled and g.enabled and (g.min_matches_boost != 0 or g.update_sf_div != 1.0)


class Video:
    """A video's background model and gate; `step` takes its next frame."""

    def __init__(self, m: Machine, background: Background, post: Postprocess, crops: Crops, seed: int, video, run: scorer.Scorer):
        self.bank, self.state, self.guard = SampleBank(background, seed, video), scan.State(m), m.adaptive.fp_guard
        self.post, self.crops, self.run = post, crops, run

    def model(self, gray: np.ndarray) -> tuple:
        return self.bank.apply(gray), self.bank.matches_needed(), self.bank.period()

    def step(self, i: int, image: np.ndarray) -> tuple:
        c, g = self.crops, self.guard
        _, _, luma, n, ratio, matches, period, kept, boxes = measured(image, self.model, self.post, c.expand_ratio, c.pad_px, c.min_crop_area, c.max_crops, True)

        def p(sees: str) -> float:
            whole = sees == "frame"
            parts = scorer.crops(image, None if whole else boxes, c.input_size, scorer.MEAN, scorer.STD, whole or c.full_frame_if_no_crops)
            return float(scorer.probability(self.run(np.stack(parts)), c.output, c.positive_index).max()) if parts else 0.0

        out = self.state.step(i, n, ratio, p, luma, kept.ravel())
        hard = self.state.guard_left > 0
        self.bank.boost, self.bank.divide = (g.min_matches_boost, g.update_sf_div if g.update_sf_div > 0 else 1.0) if hard else (0, 1.0)
        return *out, n, ratio, matches, period


def run(frames: DataFrame, m: Machine, background: Background, post: Postprocess, crops: Crops = Crops(), make: Callable[[], scorer.Scorer] = scorer.contrast_scorer, seed: int = 0, width: int | None = None) -> DataFrame:
    """frames (video_id, i, height, width, gray or bgr binary) to the gate's columns and the masks' measures (OUT). min_matches
    and update_period are those that the frame was seen with."""
    names = [c.split()[0] for c in OUT.split(", ")]
    stored = "bgr" if "bgr" in frames.columns else "gray"

    def f(batches):
        key, video, model = object(), None, None
        for batch in batches:
            out = []
            for v, i, h, w, raw in zip(*(batch[c].to_pylist() for c in ("video_id", "i", "height", "width", stored)), strict=True):
                if v != key:
                    model = model or make()
                    key, video = v, Video(m, background, post, crops, seed, v, model)
                out.append((v, i, *video.step(i, images.frame(raw, h, w, width))))
            if out:
                columns = [pa.array(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[:-2], *(c.cast(pa.int32()) for c in columns[-2:])], names)

    return frames.select("video_id", "i", "height", "width", stored).repartition("video_id").sortWithinPartitions("video_id", "i").mapInArrow(f, OUT)
