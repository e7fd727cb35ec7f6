"""Frame scoring by a model: crops of a frame in one batch, the largest probability counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import images

#: A scorer turns a batch of normalised crops (n, 3, size, size) into n rows of logits.
Scorer = Callable[[np.ndarray], np.ndarray]
#: Colour means and deviations (RGB) of the training set that published models are fitted to: fixed values.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def contrast_scorer() -> Scorer:
    """Deterministic stand-in without a model file: the contrast of a crop as a logit."""
    return lambda x: (x.std((1, 2, 3)) * 4.0 - 2.0)[:, None]


def onnx_scorer(path: str) -> Callable[[], Scorer]:
    """A scorer from an ONNX file that every executor has (ship it with `addFile`)."""

    def make() -> Scorer:
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: np.asarray(session.run(None, {name: x.astype(np.float32)})[0]).reshape(len(x), -1)

    return make


def probability(logits: np.ndarray, head: str = "auto", positive: int = 1) -> np.ndarray:
    """`sigmoid` of the first logit, `softmax` share of the positive one, or by the number of logits."""
    if head == "sigmoid" or (head == "auto" and logits.shape[1] == 1):
        return 1.0 / (1.0 + np.exp(-logits[:, 0]))
    e = np.exp(logits - logits.max(1, keepdims=True))
    return (e / e.sum(1, keepdims=True))[:, positive]


def crops(bgr: np.ndarray, boxes: list[dict] | None, size: int, mean, std, full_frame_if_no_crops: bool = True) -> list[np.ndarray]:
    """Normalised crops of a frame (gray or BGR); without boxes in it the whole frame, or none."""
    bgr = bgr if bgr.ndim == 3 else np.repeat(bgr[..., None], 3, 2)
    h, w = bgr.shape[:2]
    at = [(max(0, b["x1"]), max(0, b["y1"]), min(w, b["x2"]), min(h, b["y2"])) for b in boxes or []]
    at = [b for b in at if b[2] > b[0] and b[3] > b[1]] or ([(0, 0, w, h)] if full_frame_if_no_crops else [])
    return [images.normalised(bgr[y1:y2, x1:x2], size, mean, std) for x1, y1, x2, y2 in at]


def score(frames: DataFrame, make: Callable[[], Scorer] = contrast_scorer, size: int = 32, mean=MEAN, std=STD, head: str = "sigmoid", positive: int = 1, full_frame_if_no_crops: bool = True, width: int | None = None) -> DataFrame:
    """frames (video_id, i, height, width, gray or bgr binary, boxes at a width) with cnn_p. The scorer is made once per task; the crops
    of an Arrow batch of frames go through it together. Without boxes the whole frame counts, or 0."""

    stored = "bgr" if "bgr" in frames.columns else "gray"

    def f(batches):
        run = make()
        for batch in batches:
            parts, owner = [], []
            for k, (h, w, raw, found) in enumerate(zip(*(batch[c].to_pylist() for c in ("height", "width", stored, "boxes")), strict=True)):
                some = crops(images.frame(raw, h, w, width), found, size, mean, std, full_frame_if_no_crops)
                parts += some
                owner += [k] * len(some)
            p = np.zeros(batch.num_rows)
            for a in range(0, len(parts), 256):
                np.maximum.at(p, owner[a : a + 256], probability(run(np.stack(parts[a : a + 256])), head, positive))
            yield pa.RecordBatch.from_arrays([batch["video_id"], batch["i"], pa.array(p)], ["video_id", "i", "cnn_p"])

    return frames.select("video_id", "i", "height", "width", stored, "boxes").mapInArrow(f, "video_id long, i long, cnn_p double")
