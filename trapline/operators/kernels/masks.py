"""Mask clean-up: median, erosion, dilation, components, boxes.

Written from the definitions: a median of a binary mask is the majority of its k x k window
with replicated borders; the 3 x 3 ellipse is a plus sign; borders are neutral for erosion and
dilation; components touch by sides or corners and are numbered in the order of their first
pixel by rows.
"""

from __future__ import annotations

import numpy as np

from ...config import Postprocess


def median(mask: np.ndarray, k: int) -> np.ndarray:
    """Odd k of 3 or more; any other leaves the mask."""
    if k < 3 or k % 2 == 0:
        return mask
    r = k // 2
    padded = np.pad(mask.astype(np.int32), r, mode="edge")
    total = np.cumsum(np.cumsum(np.pad(padded, ((1, 0), (1, 0))), 0), 1)
    return (total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) * 2 > k * k


def _plus(mask: np.ndarray, outside: bool, fold) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=outside)
    return fold.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])


def erode(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _plus(mask, True, np.logical_and)
    return mask


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _plus(mask, False, np.logical_or)
    return mask


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Component numbers from 1 (0: background) and how many there are."""
    h, w = mask.shape
    padded = np.pad(mask, 1)
    # pixel numbers; a component ends up with the least of its own
    at = np.where(padded, np.arange(padded.size).reshape(padded.shape), padded.size)
    while True:
        best = at.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                np.minimum(best[1:-1, 1:-1], at[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], out=best[1:-1, 1:-1])
        best = np.where(padded, best, padded.size)
        flat = np.append(best.ravel(), padded.size)
        best = np.where(padded, flat[best], padded.size)
        if np.array_equal(best, at):
            break
        at = best
    roots, number = np.unique(at[1:-1, 1:-1][mask], return_inverse=True)
    out = np.zeros((h, w), np.int32)
    out[mask] = number + 1
    return out, len(roots)


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels, and (area, x, y, w, h) of each component in the order of labels."""
    labels, n = label(mask)
    stats = np.zeros((n, 5), np.int64)
    y, x = np.nonzero(labels)
    k = labels[y, x] - 1
    stats[:, 0] = np.bincount(k, minlength=n)
    for col, v in ((1, x), (2, y)):
        lo, hi = np.full(n, 1 << 40), np.full(n, -1)
        np.minimum.at(lo, k, v)
        np.maximum.at(hi, k, v)
        stats[:, col], stats[:, col + 2] = lo, hi - lo + 1
    return labels, stats


def largest(stats: np.ndarray, least: int, most: int) -> np.ndarray:
    """Components of `least` pixels or more, the `most` largest (the lower label first on a tie)."""
    own = np.flatnonzero(stats[:, 0] >= least) if least > 0 else np.arange(len(stats))
    own = own[np.argsort(-stats[own, 0], kind="stable")]
    return own[:most] if most > 0 else own


def filtered(mask: np.ndarray, least: int, most: int) -> np.ndarray:
    if least <= 0 and most <= 0:
        return mask
    labels, stats = components(mask)
    return np.isin(labels, largest(stats, least, most) + 1) & mask


def boxes(mask: np.ndarray, least: int, most: int, grow: float, pad: int) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2) of the largest components, scaled about their centres, padded and clipped."""
    h, w = mask.shape
    _, stats = components(mask)
    out = []
    for _, x, y, bw, bh in stats[largest(stats, least, most)].tolist():
        cx, cy, dx, dy = x + 0.5 * bw, y + 0.5 * bh, 0.5 * bw * grow, 0.5 * bh * grow
        a, b = min(w - 1, max(0, round(cx - dx) - pad)), min(h - 1, max(0, round(cy - dy) - pad))
        c, d = min(w, max(0, round(cx + dx) + pad)), min(h, max(0, round(cy + dy) + pad))
        if c > a and d > b:
            out.append((a, b, c, d))
    return out


def cleaned(mask: np.ndarray, p: Postprocess) -> np.ndarray:
    return dilate(erode(median(mask, p.median_blur_ksize), p.erode_iters), p.dilate_iters)
