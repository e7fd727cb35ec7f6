"""Clip gates: window forms where they are exact, the ordered scan elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Machine, frames
from . import scan
from .temporal import any_within, islands, starts_ahead, streak, video


def plan_gate(m: Machine, start_implies_stay: bool = False) -> str:
    """How a gate is computed: `window` if start and stay are one test, `islands` if a start always is a
    stay too, else `scan`. Only plain gates whose scores don't depend on the gate have window forms.
    start_implies_stay: what the caller knows of its metrics, such as a frame size that makes it so."""
    g = m.gate
    if not g.enabled or m.adaptive.enabled or (m.scorer.enabled and g.cnn_start_enabled) or g.stay_metric not in ("fg_pixels", "fg_ratio", "mhi_active_ratio"):
        return "scan"
    if g.start_metric == g.stay_metric and (g.start_threshold == g.stay_threshold) and g.start_consecutive <= 1:
        return "window"
    if (g.start_metric == g.stay_metric and g.start_threshold >= g.stay_threshold) or start_implies_stay:
        return "islands"
    return "scan"


def window_gate(df: DataFrame, m: Machine) -> DataFrame:
    """A frame is kept if one of the last post-roll frames, itself included, hits."""
    hit = F.col(m.gate.start_metric) >= m.gate.start_threshold
    return df.withColumn("recording", any_within(hit, frames(m.gate.post_roll_sec, m.fps, 0)))


def islands_gate(df: DataFrame, m: Machine) -> DataFrame:
    """Runs of frames with a stay at most post-roll frames back, kept from the first start in them."""
    g = m.gate
    alive = any_within(F.col(g.stay_metric) >= g.stay_threshold, frames(g.post_roll_sec, m.fps, 0))
    begins = streak(F.col(g.start_metric) >= g.start_threshold, max(1, g.start_consecutive))
    marked = df.withColumn("alive", alive).withColumn("begins", begins)
    run = marked.withColumn("run", F.sum((~F.col("alive")).cast("int")).over(video()))
    seen = F.max(F.col("alive") & F.col("begins")).over(W.partitionBy("video_id", "run").orderBy("i"))
    return run.withColumn("recording", F.col("alive") & seen).drop("alive", "begins", "run")


def gate(df: DataFrame, m: Machine, start_implies_stay: bool = False) -> DataFrame:
    """df with recording, started, backfill and decision, by the cheapest exact form. A window form takes the
    scores as columns; the scan computes those that depend on order."""
    how = plan_gate(m, start_implies_stay)
    if how == "scan":
        made = {c.split()[0] for c in scan.OUT.split(", ")}
        carry = tuple(c for c in df.columns if c not in made)
        out = scan.run(df, m, carry).select("video_id", "i", *carry, "recording", "started")
    else:
        out = (window_gate if how == "window" else islands_gate)(df, m)
        out = out.withColumn("started", F.col("recording") & ~F.coalesce(F.lag("recording").over(video()), F.lit(False)))
    pre = frames(m.gate.pre_roll_sec, m.fps, 0)
    out = out.withColumn("backfill", starts_ahead(F.col("started"), pre) if pre else F.lit(False))
    return out.withColumn("decision", F.col("recording") | F.col("backfill"))


def segments(df: DataFrame, decision: str = "decision") -> DataFrame:
    """Clips of a decision column as (video_id, s, e)."""
    return islands(df, F.col(decision))
