"""Frame preparation: area resize, gray, normalised crops."""

from __future__ import annotations

import numpy as np


def _weights(n: int, to: int) -> np.ndarray:
    """Share of each source pixel in each target pixel (rows)."""
    edge = np.linspace(0, n, to + 1)
    lo, hi = edge[:-1, None], edge[1:, None]
    k = np.arange(n)
    return np.clip(np.minimum(hi, k + 1) - np.maximum(lo, k), 0, None) / (hi - lo)


def resized(image: np.ndarray, width: int | None) -> np.ndarray:
    """Area averages at a width, the aspect kept; no width, or the same, leaves the image."""
    h, w = image.shape[:2]
    if not width or width <= 0 or width == w:
        return image
    return scaled(image, max(1, round(h * (width / w))), width)


def scaled(image: np.ndarray, h: int, w: int) -> np.ndarray:
    out = np.tensordot(_weights(image.shape[0], h), image.astype(np.float64), (1, 0))
    out = np.moveaxis(np.tensordot(_weights(image.shape[1], w), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma weights of ITU-R BT.601."""
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8) if bgr.ndim == 3 else bgr


def normalised(bgr: np.ndarray, size: int, mean, std) -> np.ndarray:
    """RGB planes of a crop at size x size, in units of the training set."""
    rgb = scaled(bgr[..., ::-1], size, size).astype(np.float32) / 255.0
    return np.moveaxis((rgb - np.float32(mean)) / np.float32(std), -1, 0)


def frame(raw: bytes, h: int, w: int, width: int | None = None) -> np.ndarray:
    """A stored frame (gray, or BGR if it has three bytes a pixel) at a width."""
    image = np.frombuffer(raw, np.uint8)
    return resized(image.reshape((h, w, 3) if image.size == 3 * h * w and image.size else (h, w)), width)
