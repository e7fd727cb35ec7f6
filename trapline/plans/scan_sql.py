"""The ordered state machine as DuckDB SQL: what `operators.scan` is checked against."""

from __future__ import annotations

from ..config import Machine, frames
from .fixture import FRAMES_SQL


def scan_sql(m: Machine) -> str:
    """`WITH RECURSIVE f, s, t`: t has a row per frame with the machine's columns, decision and backfill."""
    g, s, a, q = m.gate, m.scorer, m.adaptive, m.adaptive.fp_guard
    vibe = m.flavour == "vibe"
    tau, latch, post, pre = frames(m.memory.tau_sec, m.fps, 1), frames(s.presence_tau_sec, m.fps, 1), frames(g.post_roll_sec, m.fps, 0), frames(g.pre_roll_sec, m.fps, 0)
    full = frames(s.idle_fullframe_stride_sec, m.fps, 1) if s.idle_fullframe_stride_sec > 0 else 0
    needs_arm = a.enabled and m.memory.enabled and a.mhi_requires_arm
    if not s.enabled:
        ran = "false"
    elif a.enabled:
        ran = f"CASE WHEN rec THEN (state = 'weak' AND i % {a.stride_rec_weak} = 0) OR (state = 'none' AND i % {a.stride_rec_nomotion} = 0) ELSE state = 'weak' AND i % {a.stride_idle_weak} = 0 AND (motion OR NOT {s.start_requires_motion}) END"
    else:
        idle = f"i % {full} = 0" if full else "false"
        ran = f"CASE WHEN rec THEN i % {s.stride_recording} = 0 WHEN motion THEN i % {s.stride_idle_motion} = 0 ELSE {idle} END"
    decay = f"* CASE WHEN night AND since1 > 0 THEN exp(-since1 / {max(1.0, a.mhi_extra_decay_night_sec * m.fps)}) ELSE 1.0 END" if a.enabled and a.mhi_extra_decay_night_sec > 0 else ""
    soft = {"fg_pixels": "(fg_pixels * CASE WHEN guard THEN 0.6 ELSE 1.0 END)", "fg_ratio": "(fg_ratio * CASE WHEN guard THEN 0.6 ELSE 1.0 END)", "stay_score": "(stay * CASE WHEN guard THEN 0.8 ELSE 1.0 END)", "mhi_active_ratio": "raw", "presence_score": "presence", "motion_ema": "ema1", "cnn_p": "p1"}
    allowed = f"{soft[g.cnn_start_motion_metric]} >= {g.cnn_start_motion_threshold}" if g.cnn_start_requires_motion else "true"
    if vibe:
        names = "CASE WHEN m_ok AND c_ok THEN 'start_motion_and_cnn' WHEN c_ok THEN 'start_cnn' ELSE 'start_motion' END", "'no_start'", "'stop'"
    else:
        names = "CASE WHEN c_ok THEN 'cnn_start' ELSE 'mog2_start' END", "'none'", "'none'"
    return f"""WITH RECURSIVE {FRAMES_SQL},
s AS (
 SELECT DISTINCT video_id, -1::BIGINT AS i, false AS rec, 0 AS mh, 0 AS ch, 0 AS pl, 0.0::DOUBLE AS p, 0 AS mem, 0.0::DOUBLE AS ema, 0 AS mhi, false AS armed, 0 AS al, 1000000::BIGINT AS since, 0 AS gl, 0 AS streak,
  '' AS reason, false AS started, false AS ran, false AS motion, '' AS state, 0.0::DOUBLE AS raw, 0.0::DOUBLE AS energy, 0.0::DOUBLE AS presence, 0.0::DOUBLE AS stay, false AS night, false AS guard FROM f
 UNION ALL
 SELECT video_id, i, rec1, CASE WHEN rec OR starts THEN 0 ELSE mh1 END, CASE WHEN rec OR starts THEN 0 ELSE ch1 END,
  CASE WHEN starts OR (rec AND stays) THEN {post} WHEN rec AND pl > 0 THEN pl - 1 ELSE pl END, p1, mem2, ema1, mhi1, armed1, al1, since1, gl2, streak2,
  CASE WHEN starts THEN {names[0]} WHEN NOT rec THEN {names[1]} WHEN stays THEN 'stay' WHEN pl > 0 THEN 'post_roll' ELSE {names[2]} END,
  starts, ran, motion, state, raw, energy, presence, stay, night, guard
 FROM (SELECT *, CASE WHEN rec THEN stays OR pl > 0 ELSE starts END AS rec1
 FROM (SELECT *, NOT rec AND (m_ok OR c_ok) AS starts
 FROM (SELECT *, mh1 >= {max(1, g.start_consecutive)} AS m_ok, ch1 >= {max(1, g.cnn_start_consecutive)} AS c_ok
 FROM (SELECT *, CASE WHEN {soft[g.start_metric]} >= {g.start_threshold} THEN mh + 1 ELSE 0 END AS mh1,
   CASE WHEN {g.cnn_start_enabled} AND {allowed} AND p1 >= {g.cnn_start_threshold} THEN ch + 1 ELSE 0 END AS ch1, {soft[g.stay_metric]} >= {g.stay_threshold} AS stays
 FROM (SELECT *, greatest({"energy" if vibe else "ema1"}, presence) AS stay
 FROM (SELECT *, {f"mem2 / {latch}.0" if s.enabled else "0.0"} AS presence, (CASE WHEN idle THEN 0.0 ELSE raw END) {decay} * CASE WHEN guard THEN {q.mhi_scale_when_active} ELSE 1.0 END AS energy
 FROM (SELECT *, CASE WHEN NOT {s.enabled} THEN 0 WHEN p1 >= {s.p_start_high} OR (p1 >= {s.p_set} AND ((motion AND NOT guard) OR NOT {s.refresh_requires_motion})) THEN {latch} ELSE greatest(0, mem - 1) END AS mem2
 FROM (SELECT *, ga0 OR act AS guard, CASE WHEN act THEN {frames(q.hold_sec, m.fps, 1)} ELSE gl1 END AS gl2, CASE WHEN act THEN 0 ELSE st END AS streak2
 FROM (SELECT *, hears AND NOT ga0 AND st >= {q.negative_streak_to_activate} AS act
 FROM (SELECT *, CASE WHEN NOT hears THEN streak WHEN p1 < {q.negative_p} THEN streak + 1 WHEN p1 >= {s.p_set} THEN 0 ELSE greatest(0, streak - 1) END AS st
 FROM (SELECT *, night AND ran AND motion AND state <> 'none' AS hears, CASE WHEN ran THEN cnn_p ELSE p END AS p1, CASE WHEN mhi1 > 0 THEN 1.0 ELSE 0.0 END AS raw
 FROM (SELECT *, CASE WHEN NOT {m.memory.enabled} THEN 0 WHEN moved AND NOT idle THEN {tau} ELSE greatest(0, mhi - 1) END AS mhi1, {ran} AS ran
 FROM (SELECT *, {needs_arm} AND NOT (armed1 OR conf) AS idle
 FROM (SELECT *, CASE WHEN conf THEN true WHEN al1 <= 0 AND NOT rec THEN false ELSE armed END AS armed1
 FROM (SELECT s.* EXCLUDE (i, reason, started, ran, motion, state, raw, energy, presence, stay, night, guard), f.* EXCLUDE (video_id), fg_ratio >= {a.mhi_arm_fg_ratio} AS conf,
   CASE WHEN fg_ratio < {a.cnn_motion_low_fg_ratio} THEN 'none' WHEN fg_ratio < {a.cnn_motion_high_fg_ratio} THEN 'weak' ELSE 'strong' END AS state, fg_ratio >= {s.motion_min_fg_ratio} AS motion,
   {a.enabled and q.enabled} AND luma < {q.night_luma_threshold} AS night, gl > 0 AS ga0, greatest(0, gl - 1) AS gl1,
   CASE WHEN fg_ratio >= {a.mhi_arm_fg_ratio} THEN 0 ELSE since + 1 END AS since1, CASE WHEN fg_ratio >= {a.mhi_arm_fg_ratio} THEN {frames(a.mhi_arm_hold_sec, m.fps, 1)} ELSE greatest(0, al - 1) END AS al1,
   {m.motion_alpha}::DOUBLE * fg_ratio + (1.0 - {m.motion_alpha}::DOUBLE) * ema AS ema1
  FROM s JOIN f ON f.video_id = s.video_id AND f.i = s.i + 1)))))))))))))))
),
b AS (SELECT *, {f"coalesce(max(started::INTEGER) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND {pre} FOLLOWING), 0) = 1" if pre else "false"} AS backfill FROM s WHERE i >= 0),
t AS (SELECT b.*, f.gt, f.fg_pixels, f.fg_ratio, rec OR backfill AS decision FROM b JOIN f USING (video_id, i))
"""


def label_sql(m: Machine) -> str:
    p = m.scorer.p_set
    if m.flavour == "vibe":
        return f"""CASE WHEN backfill THEN 'pre_roll_backfill' ELSE (CASE WHEN guard THEN 'fp_guard:' WHEN night THEN 'night:' ELSE '' END) || (CASE WHEN rec THEN
 CASE WHEN reason IN ('start_cnn', 'start_motion_and_cnn') THEN 'CNN_confirm' WHEN reason = 'start_motion' THEN 'ViBe_only' WHEN reason = 'stay' THEN (CASE WHEN presence > 0 AND presence >= energy THEN 'CNN_confirm' ELSE 'MHI_stay' END) WHEN reason = 'post_roll' THEN 'post_roll' ELSE 'recording' END
 WHEN NOT motion THEN 'ViBe_only' WHEN ran AND p < {p} THEN 'CNN_reject' ELSE 'MHI_reject' END) END"""
    return f"""CASE WHEN backfill THEN 'pre_roll_backfill' WHEN rec THEN CASE reason WHEN 'cnn_start' THEN 'CNN_confirm' WHEN 'stay' THEN 'stay' WHEN 'post_roll' THEN 'post_roll' ELSE 'recording' END
 WHEN NOT motion THEN 'idle' WHEN ran AND p < {p} THEN 'CNN_reject' ELSE 'reject' END"""
