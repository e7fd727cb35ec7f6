"""Background models with state: sample banks (ViBe) and Gaussian mixtures.

Random choices come from a hash of (seed, video, frame, purpose, pixel), so a video's masks
don't depend on partitioning, batches or retries.
"""

from __future__ import annotations

import zlib

import numpy as np

from ...config import Background

_AROUND = np.array([(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])
_NEXT = np.array([a for a in _AROUND.tolist() if a != [0, 0]])


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Draws:
    """Counter-based random numbers of one video."""

    def __init__(self, seed: int, video):
        self.key = np.uint64(zlib.crc32(f"{seed}/{video}".encode()))

    def below(self, n: int, frame: int, purpose: int, size: int) -> np.ndarray:
        """`size` whole numbers from 0 to n - 1."""
        with np.errstate(over="ignore"):
            base = _mixed(np.array([self.key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(frame * 64 + purpose)], np.uint64))[0]
            x = _mixed(np.arange(size, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + base)
        return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def on_line(x: float, a: float, b: float, lo: float, hi: float) -> int:
    return round(lo + max(0.0, min(1.0, (x - a) / (b - a))) * (hi - lo))


class SampleBank:
    """ViBe: a pixel is background if enough of its stored samples are near its value."""

    def __init__(self, cfg: Background, seed: int = 0, video=0):
        self.cfg, self.draws, self.bank, self.frame = cfg, Draws(seed, video), None, 0
        self.intensity, self.motion = None, 0.0
        self.boost, self.divide = 0, 1.0

    def matches_needed(self) -> int:
        c = self.cfg
        if not c.adaptive_min_matches or c.intensity_max <= c.intensity_min + 1e-9:
            return max(1, c.min_matches + self.boost)
        return max(1, min(on_line(self.intensity, c.intensity_min, c.intensity_max, c.min_matches_min, c.min_matches_max), c.num_samples))

    def period(self) -> int:
        c = self.cfg
        if not c.adaptive_update or c.motion_high <= c.motion_low + 1e-12:
            return c.subsampling_factor if self.divide == 1.0 else max(1, round(c.subsampling_factor / self.divide))
        least = max(1, c.update_sf_min)
        return max(1, on_line(self.motion, c.motion_low, c.motion_high, least, max(least, c.update_sf_max)))

    def apply(self, gray: np.ndarray) -> np.ndarray:
        """Foreground of the next frame (2-D uint8); the first frame fills the bank and is all background."""
        if gray.ndim != 2 or gray.dtype != np.uint8:
            raise ValueError("a frame must be a 2-D array of uint8")
        c, (h, w), at = self.cfg, gray.shape, self.frame
        self.frame += 1
        mean = float(gray.mean()) if gray.size else 0.0
        y, x = np.divmod(np.arange(h * w), w)
        if self.bank is None:
            near = [_AROUND[self.draws.below(9, at, n, h * w)] for n in range(c.num_samples)]
            self.bank = np.stack([gray[np.clip(y + d[:, 0], 0, h - 1), np.clip(x + d[:, 1], 0, w - 1)].reshape(h, w) for d in near])
            self.intensity = mean
            return np.zeros((h, w), bool)
        a = c.intensity_ema_alpha
        self.intensity = mean if a <= 0 else a * mean + (1 - a) * self.intensity
        matches = (np.abs(self.bank.astype(np.int16) - gray.astype(np.int16)) < c.radius).sum(0)
        fg = matches < self.matches_needed()
        share, a = float(fg.mean()) if fg.size else 0.0, c.motion_ema_alpha
        self.motion = share if a <= 0 else a * share + (1 - a) * self.motion
        self._update(gray, fg, at, y, x)
        return fg

    def _update(self, gray, fg, at, y, x) -> None:
        (h, w), n, every = gray.shape, self.cfg.num_samples, self.period()
        chosen = ~fg.ravel()
        if every > 0:
            chosen &= self.draws.below(every, at, 40, h * w) == 0
        own = np.flatnonzero(chosen)
        value = gray.ravel()[own]
        self.bank[self.draws.below(n, at, 41, h * w)[own], y[own], x[own]] = value
        d = _NEXT[self.draws.below(8, at, 42, h * w)[own]]
        self.bank[self.draws.below(n, at, 43, h * w)[own], np.clip(y[own] + d[:, 0], 0, h - 1), np.clip(x[own] + d[:, 1], 0, w - 1)] = value


class Mixture:
    """Adaptive Gaussian mixture per pixel (Zivkovic 2004, 2006) with shadow detection; levels 0, 127, 255."""

    def __init__(self, history: int = 500, var_threshold: float = 16.0, shadows: bool = True, learning_rate: float = -1.0, modes: int = 5):
        self.history, self.threshold, self.shadows, self.rate, self.modes = history, var_threshold, shadows, learning_rate, modes
        self.n, self.weight = 0, None

    def apply(self, gray: np.ndarray) -> np.ndarray:
        x, k = gray.astype(np.float64).ravel(), self.modes
        if self.weight is None:
            self.weight, self.mean, self.var = np.zeros((k, x.size)), np.zeros((k, x.size)), np.full((k, x.size), 15.0)
        self.n += 1
        a = self.rate if self.rate >= 0 and self.n > 1 else 1.0 / min(2 * self.n, self.history)
        d2 = (x - self.mean) ** 2
        used = self.weight > 0
        order_weight = np.cumsum(self.weight, 0) - self.weight
        background = used & (order_weight < 0.9) & (d2 < self.threshold * self.var)
        fg = ~background.any(0)
        shadow = np.zeros_like(fg)
        if self.shadows:
            with np.errstate(divide="ignore", invalid="ignore"):
                tone = np.where(self.mean > 0, x / self.mean, 0.0)
            dim = used & (order_weight < 0.9) & (tone >= 0.5) & (tone <= 1.0) & ((tone * self.mean - x) ** 2 < self.threshold * self.var * tone**2)
            shadow = fg & dim.any(0)
        near = used & (d2 < 9.0 * self.var)
        hit, some = near.argmax(0), near.any(0)
        cols = np.arange(x.size)
        self.weight = np.where(used, (1 - a) * self.weight - a * 0.05, 0.0)
        i, c = hit[some], cols[some]
        self.weight[i, c] += a
        step = a / np.maximum(self.weight[i, c], a)
        delta = x[c] - self.mean[i, c]
        self.mean[i, c] += step * delta
        self.var[i, c] = np.clip(self.var[i, c] + step * (delta**2 - self.var[i, c]), 4.0, 75.0)
        c = cols[~some]
        i = self.weight[:, c].argmin(0)
        self.weight[i, c], self.mean[i, c], self.var[i, c] = a if self.n > 1 else 1.0, x[c], 15.0
        self.weight = np.maximum(self.weight, 0)
        self.weight /= np.maximum(self.weight.sum(0), 1e-12)
        o = np.argsort(-self.weight, 0, kind="stable")
        self.weight, self.mean, self.var = (np.take_along_axis(z, o, 0) for z in (self.weight, self.mean, self.var))
        return np.where(shadow, 127, np.where(fg, 255, 0)).astype(np.uint8).reshape(gray.shape)


def foreground(levels: np.ndarray, shadows: bool = True, keep: bool = False, threshold: int = 200) -> np.ndarray:
    """Only full pixels count where shadows are found and dropped; else all from the threshold."""
    return levels == 255 if shadows and not keep else levels >= threshold
