"""Ordered per-video state in one pass.

Videos are independent, frames of a video are not: rows are hashed by video, sorted by frame
and streamed through a state machine, so a task holds one video's state and one Arrow batch
at a time, whatever the length of a video. `plan_gate` uses this only where no window
expression gives the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Machine, frames
from .temporal import starts_ahead

FAR = 1_000_000

OUT = (
    "video_id long, i long, recording boolean, reason string, started boolean, p_frame double, ran_cnn boolean, motion_present boolean, motion_state string, "
    "motion_ema double, mhi_active_ratio double, mhi_energy double, presence_score double, stay_score double, armed boolean, since_confirmed long, night boolean, guard_active boolean"
)


class State:
    """A video's state and its step. mask: packed motion pixels of a frame, or None for a frame seen as one pixel."""

    def __init__(self, m: Machine):
        g, a, fps = m.gate, m.adaptive, m.fps
        self.m = m
        self.post, self.pre = frames(g.post_roll_sec, fps, 0), frames(g.pre_roll_sec, fps, 0)
        self.tau, self.latch = frames(m.memory.tau_sec, fps, 1), frames(m.scorer.presence_tau_sec, fps, 1)
        self.arm_hold, self.guard_hold = frames(a.mhi_arm_hold_sec, fps, 1), frames(a.fp_guard.hold_sec, fps, 1)
        self.full = frames(m.scorer.idle_fullframe_stride_sec, fps, 1) if m.scorer.idle_fullframe_stride_sec > 0 else 0
        self.recording = self.armed = False
        self.motion_hits = self.cnn_hits = self.post_left = self.mem = self.arm_left = self.guard_left = self.streak = 0
        self.since, self.p, self.ema, self.history = FAR, 0.0, 0.0, None

    def remember(self, moved: np.ndarray) -> float:
        """Motion history of one more frame; the share of pixels in it."""
        if self.history is None:
            self.history = np.zeros(len(moved), np.int32)
        np.maximum(self.history - 1, 0, out=self.history)
        self.history[moved] = self.tau
        return float(np.count_nonzero(self.history)) / max(1, len(moved))

    def wants_scorer(self, i: int, state: str, motion: bool) -> str:
        """What the scorer is to see of a frame: `crops`, the whole `frame`, or nothing."""
        s, a = self.m.scorer, self.m.adaptive
        if not s.enabled:
            return ""
        full = False
        if a.enabled:
            if self.recording:
                stride = {"weak": a.stride_rec_weak, "none": a.stride_rec_nomotion}.get(state, 0)
            else:
                stride = a.stride_idle_weak if state == "weak" else 0
            run = bool(stride) and i % max(1, stride) == 0
        elif self.recording:
            run = i % max(1, s.stride_recording) == 0
        elif motion:
            run = i % max(1, s.stride_idle_motion) == 0
        else:
            full = self.full > 0
            run = full and i % self.full == 0
        if not run or not (self.recording or motion or full or not s.start_requires_motion):
            return ""
        return "frame" if full else "crops"

    def gate(self, scores: dict[str, float]) -> str:
        g = self.m.gate
        vibe = self.m.flavour == "vibe"
        if not g.enabled:
            return "disabled" if vibe else "none"
        if not self.recording:
            self.motion_hits = self.motion_hits + 1 if scores[g.start_metric] >= g.start_threshold else 0
            allowed = g.cnn_start_enabled and (not g.cnn_start_requires_motion or scores[g.cnn_start_motion_metric] >= g.cnn_start_motion_threshold)
            self.cnn_hits = self.cnn_hits + 1 if allowed and scores["cnn_p"] >= g.cnn_start_threshold else 0
            motion, cnn = self.motion_hits >= max(1, g.start_consecutive), self.cnn_hits >= max(1, g.cnn_start_consecutive)
            if not (motion or cnn):
                return "no_start" if vibe else "none"
            self.recording, self.post_left, self.motion_hits, self.cnn_hits = True, self.post, 0, 0
            if vibe:
                return "start_motion_and_cnn" if motion and cnn else "start_cnn" if cnn else "start_motion"
            return "cnn_start" if cnn else "mog2_start"
        if scores[g.stay_metric] >= g.stay_threshold:
            self.post_left = self.post
            return "stay"
        if self.post_left > 0:
            self.post_left -= 1
            return "post_roll"
        self.recording = False
        return "stop" if vibe else "none"

    def step(self, i: int, pixels: float, ratio: float, p: float | Callable[[str], float], luma: float, mask: np.ndarray) -> tuple:
        """p: the frame's score, or what gives it for `crops` or `frame` where it is wanted."""
        m, a, guard = self.m, self.m.adaptive, self.m.adaptive.fp_guard
        was_recording = self.recording
        night = a.enabled and guard.enabled and luma < guard.night_luma_threshold
        state = "none" if ratio < a.cnn_motion_low_fg_ratio else "weak" if ratio < a.cnn_motion_high_fg_ratio else "strong"
        confirmed = ratio >= a.mhi_arm_fg_ratio
        if confirmed:
            self.armed, self.arm_left, self.since = True, self.arm_hold, 0
        else:
            self.since += 1
            self.arm_left = max(0, self.arm_left - 1)
            if self.arm_left <= 0 and not self.recording:
                self.armed = False
        needs_arm = a.enabled and m.memory.enabled and a.mhi_requires_arm
        idle = needs_arm and not (self.armed or confirmed)
        raw = self.remember(np.zeros_like(mask) if idle else mask) if m.memory.enabled else 0.0
        motion = ratio >= m.scorer.motion_min_fg_ratio
        guarded = self.guard_left > 0
        if guarded:
            self.guard_left -= 1
        sees = self.wants_scorer(i, state, motion)
        ran = bool(sees)
        if ran:
            self.p = p(sees) if callable(p) else p
        if night and ran and motion and state != "none":
            self.streak = self.streak + 1 if self.p < guard.negative_p else 0 if self.p >= m.scorer.p_set else max(0, self.streak - 1)
            if not guarded and self.streak >= guard.negative_streak_to_activate:
                self.guard_left, guarded, self.streak = self.guard_hold, True, 0
        presence = 0.0
        if m.scorer.enabled:
            self.mem = max(0, self.mem - 1)
            if self.p >= m.scorer.p_start_high or self.p >= m.scorer.p_set and ((motion and not guarded) or not m.scorer.refresh_requires_motion):
                self.mem = self.latch
            presence = self.mem / self.latch
        energy = 0.0 if idle else raw
        if a.enabled and night and a.mhi_extra_decay_night_sec > 0 and self.since > 0:
            energy *= math.exp(-self.since / max(1.0, a.mhi_extra_decay_night_sec * m.fps))
        if guarded:
            energy *= guard.mhi_scale_when_active
        self.ema = m.motion_alpha * ratio + (1.0 - m.motion_alpha) * self.ema
        stay = max(energy if m.flavour == "vibe" else self.ema, presence)
        soft = 0.6 if guarded else 1.0
        reason = self.gate({"fg_pixels": pixels * soft, "fg_ratio": ratio * soft, "mhi_active_ratio": raw, "motion_ema": self.ema, "cnn_p": self.p, "presence_score": presence, "stay_score": stay * (0.8 if guarded else 1.0)})
        keep = self.recording or not m.gate.enabled
        return keep, reason, keep and not was_recording and m.gate.enabled, self.p, ran, motion, state, self.ema, raw, energy, presence, stay, self.armed, self.since, night, guarded


def run(df: DataFrame, machine: Machine, carry: tuple[str, ...] = ()) -> DataFrame:
    """df (video_id, i, fg_pixels, fg_ratio, cnn_p, luma, moved boolean or mask binary) with the machine's columns (OUT),
    and the columns to carry along as they are. cnn_p_frame, where it is there, is the score of a whole frame; height and
    width are the size of a mask (without them, its bits to the last byte)."""
    masked = "mask" in df.columns
    cols = ["video_id", "i", "fg_pixels", "fg_ratio", "cnn_p", "luma", "mask" if masked else "moved"]
    whole = "cnn_p_frame" if "cnn_p_frame" in df.columns else "cnn_p"
    sized = masked and {"height", "width"} <= set(df.columns)
    read = [*cols, whole, *(("height", "width") if sized else ())]
    names = [c.split()[0] for c in OUT.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = object(), None
        for batch in batches:
            out = []
            for v, i, pixels, ratio, p, luma, moved, q, *hw in zip(*(batch[c].to_pylist() for c in read), strict=True):
                if v != video:
                    video, state = v, State(machine)
                mask = np.unpackbits(np.frombuffer(moved, np.uint8), count=hw[0] * hw[1] if hw else None).astype(bool) if masked else np.array([bool(moved)])
                score = {"crops": p or 0.0, "frame": q or 0.0}
                out.append((v, i, *state.step(i, pixels, ratio, score.__getitem__, luma or 0.0, mask)))
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*out, strict=True)), *(batch[c] for c in carry)], [*names, *carry])

    schema = ", ".join([OUT, *(f"{c} {df.schema[c].dataType.simpleString()}" for c in carry)])
    return df.select(*dict.fromkeys((*read, *carry))).repartition("video_id").sortWithinPartitions("video_id", "i").mapInArrow(scan, schema)


def backfilled(df: DataFrame, machine: Machine) -> DataFrame:
    """Adds decision and backfill: frames up to pre-roll before a start are kept too."""
    pre = frames(machine.gate.pre_roll_sec, machine.fps, 0)
    back = starts_ahead(F.col("started"), pre) if pre else F.lit(False)
    return df.withColumn("backfill", back).withColumn("decision", F.col("recording") | F.col("backfill"))
