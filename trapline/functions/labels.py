"""Trigger labels of the detection log. The vocabularies are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vibe(recording: Column, reason: Column, motion: Column, ran: Column, p: Column, presence: Column, energy: Column, p_set: float) -> Column:
    kept = F.when(reason.isin("start_cnn", "start_motion_and_cnn"), "CNN_confirm").when(reason == "start_motion", "ViBe_only").when(reason == "stay", F.when((presence > 0) & (presence >= energy), "CNN_confirm").otherwise("MHI_stay")).when(reason == "post_roll", "post_roll").otherwise("recording")
    dropped = F.when(~motion, "ViBe_only").when(ran & (p < p_set), "CNN_reject").otherwise("MHI_reject")
    return F.when(recording, kept).otherwise(dropped)


def mog2(recording: Column, reason: Column, motion: Column, ran: Column, p: Column, p_set: float) -> Column:
    kept = F.when(reason == "cnn_start", "CNN_confirm").when(reason == "stay", "stay").when(reason == "post_roll", "post_roll").otherwise("recording")
    dropped = F.when(~motion, "idle").when(ran & (p < p_set), "CNN_reject").otherwise("reject")
    return F.when(recording, kept).otherwise(dropped)


def prefixed(label: Column, guard: Column, night: Column) -> Column:
    return F.when(guard, F.concat(F.lit("fp_guard:"), label)).when(night, F.concat(F.lit("night:"), label)).otherwise(label)


def trigger_source(flavour: str, p_set: float, backfill: Column | None = None) -> Column:
    """Label of a scanned frame (columns of `operators.scan`); backfilled frames lose theirs."""
    c = F.col
    if flavour == "vibe":
        label = prefixed(vibe(c("recording"), c("reason"), c("motion_present"), c("ran_cnn"), c("p_frame"), c("presence_score"), c("mhi_energy"), p_set), c("guard_active"), c("night"))
    else:
        label = mog2(c("recording"), c("reason"), c("motion_present"), c("ran_cnn"), c("p_frame"), p_set)
    return label if backfill is None else F.when(backfill, "pre_roll_backfill").otherwise(label)
