"""Scalar expressions: rounding, guarded ratios, clamped lines, motion states, score heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rint(x: Column) -> Column:
    """Nearest whole number, half to even."""
    return F.rint(x).cast("long")


def sec_to_frames(sec: Column, fps: Column, least: int) -> Column:
    return F.greatest(F.lit(least).cast("long"), rint(sec * fps))


def frames_to_sec(n: Column, fps: Column) -> Column:
    return n / F.when(fps > 0, fps).otherwise(F.lit(30.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den isn't positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def clamped_lerp(x: Column, a: float, b: float, lo: float, hi: float, fixed: int, least: int = 1, most: int | None = None) -> Column:
    """Whole number on the line from (a, lo) to (b, hi), held at its ends; `fixed` where b <= a."""
    if b <= a:
        out = F.lit(fixed).cast("long")
    else:
        out = rint(F.lit(float(lo)) + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - F.lit(float(a))) / F.lit(float(b - a)))) * F.lit(float(hi - lo)))
    out = F.greatest(F.lit(least).cast("long"), out)
    return out if most is None else F.least(F.lit(most).cast("long"), out)


def motion_state(fg_ratio: Column, low: float, high: float) -> Column:
    return F.when(fg_ratio < low, "none").when(fg_ratio < high, "weak").otherwise("strong")


def night_decay(x: Column, since: Column, sec: float, fps: float) -> Column:
    return x * F.exp(-since / F.lit(max(1.0, sec * fps)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits; the largest is taken out first."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def positive_share(logits: Column, mode: str = "auto", positive: int = 1) -> Column:
    """Probability from a score head: `sigmoid` of one logit, `softmax` of several, or by their number."""
    one, many = sigmoid(F.element_at(logits, 1)), F.element_at(softmax(logits), positive + 1)
    return {"sigmoid": one, "softmax": many, "auto": F.when(F.size(logits) == 1, one).otherwise(F.when(F.size(logits) > 1, many))}[mode]


def resized(h: Column, w: Column, to: Column) -> tuple[Column, Column]:
    """Height and width at a target width with the aspect kept; no target leaves both."""
    same = to.isNull() | (to <= 0) | (to == w)
    return F.when(same, h).otherwise(F.greatest(F.lit(1).cast("long"), rint(h * (to / w)))), F.when(same, w).otherwise(to)


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma weights of ITU-R BT.601."""
    return F.rint(0.114 * b + 0.587 * g + 0.299 * r).cast("int")


def shadows_dropped(mask: Column, threshold: int, shadows: bool, keep: bool) -> Column:
    """Foreground of a mask with a shadow level: only full pixels, or all from the threshold where shadows count or aren't found."""
    return F.transform(mask, lambda x: (x == 255) if shadows and not keep else (x >= threshold))


def expanded_box(x: Column, y: Column, w: Column, h: Column, grow: float, pad: int, width: int, height: int) -> Column:
    """A box scaled by `grow` about its centre, padded and clipped to the frame; null where nothing is left."""
    cx, cy, dx, dy = x + w * 0.5, y + h * 0.5, w * (0.5 * grow), h * (0.5 * grow)
    edge = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v)).cast("int")
    a, b = edge(rint(cx - dx) - pad, width - 1), edge(rint(cy - dy) - pad, height - 1)
    c, d = edge(rint(cx + dx) + pad, width), edge(rint(cy + dy) + pad, height)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))
