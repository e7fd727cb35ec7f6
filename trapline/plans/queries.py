"""Queries over the fixture tables, each with the DuckDB SQL that it is checked against."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Adaptive, Background, Crops, Gate, Guard, Machine, Memory, Postprocess, Scorer
from ..functions import labels, scalars
from ..operators import feedback, intervals, metrics, pixels, regions, scan, scorer, temporal
from ..operators import gate as gates
from ..sources import annotations, tables
from . import fixture
from .fixture import FPS, FRAMES_SQL, PIXELS_SQL
from .scan_sql import label_sql, scan_sql

OFF = Memory(enabled=False)
PLAIN = Gate(start_threshold=90.0, stay_metric="fg_pixels", stay_threshold=90.0, post_roll_sec=0.3, pre_roll_sec=0.2, cnn_start_enabled=False)
SYMMETRIC = Machine(gate=PLAIN, memory=OFF)
ISLANDS = Machine(gate=replace(PLAIN, start_threshold=100.0, stay_threshold=60.0, start_consecutive=2), memory=OFF)
SCANNED = Machine(gate=replace(PLAIN, start_threshold=60.0, start_consecutive=2, stay_threshold=100.0), memory=OFF)
SCORING = Scorer(enabled=True, motion_min_fg_ratio=0.01, stride_recording=2, stride_idle_motion=3, presence_tau_sec=0.5)
HYBRID = Machine(gate=Gate(start_threshold=100.0, stay_threshold=0.001, post_roll_sec=0.3, pre_roll_sec=0.2, cnn_start_motion_threshold=0.01), memory=Memory(tau_sec=0.5), scorer=SCORING)
MOG2 = Machine("mog2", gate=Gate(start_threshold=100.0, stay_threshold=0.06, post_roll_sec=0.3, pre_roll_sec=0.2, cnn_start_motion_threshold=0.01), memory=OFF, scorer=replace(SCORING, idle_fullframe_stride_sec=0.5))
GUARD = Guard(enabled=True, negative_streak_to_activate=2, hold_sec=0.6)
ADAPTIVE = replace(HYBRID, adaptive=Adaptive(True, 0.01, 0.05, 2, 3, 2, True, 0.06, 0.4, 0.5, GUARD))
WARMUP = 5

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 9):
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


# Frames, ranges, ground truth


@query(f"""WITH {FRAMES_SQL} SELECT video_id, i, fg_pixels, round(fg_ratio, 9) AS fg_ratio, CASE WHEN fg_ratio < 0.01 THEN 'none' WHEN fg_ratio < 0.05 THEN 'weak' ELSE 'strong' END AS state, fg_ratio >= 0.01 AS motion_present, luma < 70 AS night,
 round(fg_ratio * exp(-i / 5.0), 9) AS decayed, greatest(1, round_even(fg_ratio * 25.0, 0))::BIGINT AS n_frames, least(20, greatest(1, round_even(1 + least(1.0, greatest(0.0, (luma - 40.0) / 120.0)) * 3, 0)))::BIGINT AS line, round(1 / (1 + exp(-(cnn_p * 4 - 2))), 9) AS sigmoid FROM f WHERE i BETWEEN 2 AND 40""")
def frame_metrics(spark, sf_dir):
    """Scalar functions on a range of frames."""
    f = tables.frame_range(fixture.frames(spark, sf_dir), F.lit(FPS), 0.2, 4.0, F.lit(1000))
    r = F.col("fg_ratio")
    return f.select("video_id", "i", "fg_pixels", _r("fg_ratio"), scalars.motion_state(r, 0.01, 0.05).alias("state"), (r >= 0.01).alias("motion_present"), (F.col("luma") < 70).alias("night"), _r(scalars.night_decay(r, F.col("i"), 0.5, FPS)).alias("decayed"), scalars.sec_to_frames(r, F.lit(25.0), 1).alias("n_frames"), scalars.clamped_lerp(F.col("luma"), 40, 160, 1, 4, 2, 1, 20).alias("line"), _r(scalars.sigmoid(F.col("cnn_p") * 4 - 2)).alias("sigmoid"))


_RUNS = "g AS (SELECT video_id, i, i - row_number() OVER (PARTITION BY video_id ORDER BY i) AS k FROM {src} WHERE {hit}), {name} AS (SELECT video_id, min(i) AS s, max(i) AS e FROM g GROUP BY video_id, k)"
_GT_SQL = _RUNS.format(src="f", hit="gt", name="gt_runs")


def _truth(f: DataFrame) -> DataFrame:
    return temporal.islands(f, F.col("gt"))


@query(f"WITH {FRAMES_SQL}, {_GT_SQL} SELECT video_id, s, e FROM gt_runs")
def gt_runs(spark, sf_dir):
    return _truth(fixture.frames(spark, sf_dir)).select("video_id", "s", "e")


@query(f"WITH {FRAMES_SQL}, {_GT_SQL} SELECT f.video_id, f.i, EXISTS (SELECT 1 FROM gt_runs r WHERE r.video_id = f.video_id AND f.i BETWEEN r.s AND r.e) AS inside FROM f")
def gt_membership(spark, sf_dir):
    f = fixture.frames(spark, sf_dir)
    return intervals.member(f, _truth(f), "inside").select("video_id", "i", "inside")


@query(f"WITH {FRAMES_SQL}, {_GT_SQL} SELECT video_id, greatest(s, 5) AS s, least(e, 30) AS e FROM gt_runs WHERE greatest(s, 5) <= least(e, 30)")
def clip_intervals(spark, sf_dir):
    return intervals.clipped(_truth(fixture.frames(spark, sf_dir)), F.lit(5).cast("long"), F.lit(30).cast("long")).select("video_id", "s", "e")


def _annotation(spark, sf_dir, doc):
    """Annotation documents made of the fixture's true runs and frames."""
    f = fixture.frames(spark, sf_dir)
    runs = _truth(f).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))
    return runs.select("video_id", doc(F.col("runs")).alias("doc"))


@query(f"WITH {FRAMES_SQL}, {_GT_SQL} SELECT video_id, greatest(0, floor((s / 10.0 + 0.05) * 10.0))::BIGINT AS s, (ceil((e / 10.0 + 0.1) * 10.0) - 1)::BIGINT AS e FROM gt_runs WHERE ceil((e / 10.0 + 0.1) * 10.0) - 1 >= floor((s / 10.0 + 0.05) * 10.0)")
def gt_events(spark, sf_dir):
    """Ground truth in seconds."""
    doc = lambda runs: F.to_json(F.struct(F.transform(runs, lambda r: F.struct((r.s / 10.0 + 0.05).alias("start_sec"), (r.e / 10.0 + 0.1).alias("end_sec"))).alias("events"), F.lit("x").alias("positive_frames")))
    return annotations.extract(_annotation(spark, sf_dir, doc), F.lit(FPS)).select("video_id", "s", "e")


@query(f"WITH {FRAMES_SQL}, {_GT_SQL} SELECT video_id, s, e FROM gt_runs UNION ALL SELECT video_id + 1000000, s, e FROM gt_runs")
def gt_intervals(spark, sf_dir):
    """Frame intervals as pairs and as objects; invalid ones go."""
    pairs = lambda runs: F.to_json(F.struct(F.concat(F.transform(runs, lambda r: F.array(r.s, r.e)), F.array(F.array(F.lit(9).cast("long"), F.lit(3).cast("long")))).alias("intervals")))
    objects = lambda runs: F.to_json(F.struct(F.transform(runs, lambda r: F.struct(r.s.alias("start"), r.e.alias("end"))).alias("gt_intervals")))
    other = _annotation(spark, sf_dir, objects).withColumn("video_id", F.col("video_id") + 1_000_000)
    return annotations.extract(_annotation(spark, sf_dir, pairs).unionByName(other), F.lit(FPS)).select("video_id", "s", "e")


def _frame_list(runs, shape):
    flat = F.flatten(F.transform(runs, lambda r: F.sequence(r.s, r.e)))
    return shape(flat)


@query(f"WITH {FRAMES_SQL}, {_GT_SQL} SELECT video_id + k.k AS video_id, s, e FROM gt_runs, (VALUES (0), (1000000), (2000000)) AS k(k)")
def gt_frames(spark, sf_dir):
    """Positive frames as a list, an object of frames, and a list of frame objects."""
    shapes = [
        lambda x: F.to_json(F.struct(F.concat(x, F.slice(x, 1, 2)).alias("pos_frames"))),
        lambda x: F.to_json(F.struct(F.map_concat(F.map_from_arrays(F.transform(x, lambda i: i.cast("string")), F.transform(x, lambda i: F.array(i))), F.create_map(F.lit("77777"), F.array().cast("array<bigint>"), F.lit("no"), F.array(F.lit(1).cast("long")))).alias("frames"))),
        lambda x: F.to_json(F.struct(F.transform(x, lambda i: F.struct(i.alias("frame_idx"), F.lit("cat").alias("label"))).alias("frames"))),
    ]
    out = None
    for k, shape in enumerate(shapes):
        one = _annotation(spark, sf_dir, lambda runs, s=shape: _frame_list(runs, s)).withColumn("video_id", F.col("video_id") + 1_000_000 * k)
        out = one if out is None else out.unionByName(one)
    return annotations.extract(out, F.lit(FPS)).select("video_id", "s", "e")


# Gates


def _gate_sql(m: Machine) -> str:
    return scan_sql(m) + "SELECT video_id, i, rec AS recording, started, backfill, decision FROM t"


def _gated(spark, sf_dir, m: Machine) -> DataFrame:
    return gates.gate(fixture.frames(spark, sf_dir), m)


def _rows(df: DataFrame) -> DataFrame:
    return df.select("video_id", "i", "recording", "started", "backfill", "decision")


_SCORES = """count(*) AS processed, count(*) FILTER (WHERE decision) AS kept, count(*) FILTER (WHERE gt AND decision AND i >= 5) AS TP, count(*) FILTER (WHERE NOT gt AND decision AND i >= 5) AS FP, count(*) FILTER (WHERE gt AND NOT decision AND i >= 5) AS FN, count(*) FILTER (WHERE NOT gt AND NOT decision AND i >= 5) AS TN"""
_RATES = """CASE WHEN TP + FP > 0 THEN TP / (TP + FP)::DOUBLE ELSE 0 END AS pr, CASE WHEN TP + FN > 0 THEN TP / (TP + FN)::DOUBLE ELSE 0 END AS re"""
_F1 = "CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END"


def _summary_sql(group: str = "video_id", source: str = "t") -> str:
    return f"""SELECT {group}, processed, kept, TP, FP, FN, TN, round(pr, 9) AS "Precision", round(re, 9) AS "Recall", round({_F1}, 9) AS "F1_Score", round((1.0 - kept / processed::DOUBLE) * 100.0, 9) AS "Storage_Saved_Pct" FROM (SELECT *, {_RATES} FROM (SELECT {group}, {_SCORES} FROM {source} GROUP BY {group}))"""


def _summary(df: DataFrame) -> DataFrame:
    out = metrics.frame_summary(df, WARMUP)
    return out.select("video_id", "processed", "kept", "TP", "FP", "FN", "TN", *[_r(c) for c in ("Precision", "Recall", "F1_Score", "Storage_Saved_Pct")])


@query(scan_sql(SYMMETRIC) + _summary_sql())
def gate_symmetric(spark, sf_dir):
    """Per video: counts, rates and storage saved of the symmetric gate after warm-up."""
    return _summary(_gated(spark, sf_dir, SYMMETRIC))


@query(_gate_sql(ISLANDS))
def gate_islands(spark, sf_dir):
    return _rows(_gated(spark, sf_dir, ISLANDS))


@query(_gate_sql(SCANNED))
def gate_scan(spark, sf_dir):
    return _rows(_gated(spark, sf_dir, SCANNED))


@query(_gate_sql(SYMMETRIC))
def preroll_backfill(spark, sf_dir):
    return _rows(_gated(spark, sf_dir, SYMMETRIC))


@query(scan_sql(ISLANDS) + f", {_RUNS.format(src='t', hit='decision', name='p')} SELECT video_id, s, e FROM p")
def pred_segments(spark, sf_dir):
    return gates.segments(_gated(spark, sf_dir, ISLANDS)).select("video_id", "s", "e")


def _scanned(spark, sf_dir, m: Machine) -> DataFrame:
    f = fixture.frames(spark, sf_dir)
    return scan.backfilled(scan.run(f, m, ("gt", "fg_ratio")), m)


@query(scan_sql(HYBRID) + "SELECT video_id, i, rec AS recording, reason, backfill, decision FROM t")
def gate_hybrid(spark, sf_dir):
    return _scanned(spark, sf_dir, HYBRID).select("video_id", "i", "recording", "reason", "backfill", "decision")


@query(scan_sql(MOG2) + "SELECT video_id, i, rec AS recording, reason, backfill, decision FROM t")
def gate_mog2(spark, sf_dir):
    return _scanned(spark, sf_dir, MOG2).select("video_id", "i", "recording", "reason", "backfill", "decision")


@query(scan_sql(MOG2) + "SELECT video_id, i, ran AS ran_cnn, p AS p_frame FROM t")
def cnn_schedule_fixed(spark, sf_dir):
    return _scanned(spark, sf_dir, MOG2).select("video_id", "i", "ran_cnn", "p_frame")


@query(scan_sql(ADAPTIVE) + "SELECT video_id, i, ran AS ran_cnn, p AS p_frame, state AS motion_state FROM t")
def cnn_schedule_adaptive(spark, sf_dir):
    return _scanned(spark, sf_dir, ADAPTIVE).select("video_id", "i", "ran_cnn", "p_frame", "motion_state")


@query(scan_sql(ADAPTIVE) + "SELECT video_id, i, rec AS recording, reason, guard AS guard_active, night, armed, since AS since_confirmed, round(energy, 9) AS mhi_energy, round(stay, 9) AS stay_score FROM t")
def adaptive_gate(spark, sf_dir):
    return _scanned(spark, sf_dir, ADAPTIVE).select("video_id", "i", "recording", "reason", "guard_active", "night", "armed", "since_confirmed", _r("mhi_energy"), _r("stay_score"))


@query(scan_sql(HYBRID) + "SELECT video_id, i, round(presence, 9) AS presence_score, round(stay, 9) AS stay_score, round(ema, 9) AS motion_ema FROM t")
def stay_score(spark, sf_dir):
    return _scanned(spark, sf_dir, HYBRID).select("video_id", "i", _r("presence_score"), _r("stay_score"), _r("motion_ema"))


@query(scan_sql(ADAPTIVE) + f"SELECT video_id, i, {label_sql(ADAPTIVE)} AS trigger_source FROM t")
def trigger_labels(spark, sf_dir):
    return _scanned(spark, sf_dir, ADAPTIVE).select("video_id", "i", labels.trigger_source("vibe", 0.45, F.col("backfill")).alias("trigger_source"))


@query(scan_sql(MOG2) + f"SELECT video_id, i, {label_sql(MOG2)} AS trigger_source FROM t")
def trigger_labels_mog2(spark, sf_dir):
    return _scanned(spark, sf_dir, MOG2).select("video_id", "i", labels.trigger_source("mog2", 0.45, F.col("backfill")).alias("trigger_source"))


# Memories as windows


@query(f"WITH {FRAMES_SQL}, h AS (SELECT *, max(i) FILTER (WHERE cnn_p >= 0.8 OR (cnn_p >= 0.45 AND fg_ratio >= 0.01)) OVER (PARTITION BY video_id ORDER BY i) AS hit FROM f) SELECT video_id, i, greatest(0, coalesce(5 - (i - hit), 0))::INTEGER AS mem FROM h")
def presence_latch(spark, sf_dir):
    f = fixture.frames(spark, sf_dir)
    hit = (F.col("cnn_p") >= 0.8) | ((F.col("cnn_p") >= 0.45) & (F.col("fg_ratio") >= 0.01))
    return f.select("video_id", "i", temporal.countdown(hit, 5).alias("mem"))


@query(f"WITH {FRAMES_SQL}, h AS (SELECT *, max(i) FILTER (WHERE i % 3 = 0) OVER w AS run, max(i) FILTER (WHERE fg_ratio >= 0.06) OVER w AS sure FROM f WINDOW w AS (PARTITION BY video_id ORDER BY i)) SELECT h.video_id, h.i, coalesce(g.cnn_p, 0) AS p_frame, coalesce(h.i - h.sure, 1000001 + h.i)::BIGINT AS since_confirmed FROM h LEFT JOIN f g ON g.video_id = h.video_id AND g.i = h.run")
def sticky_score(spark, sf_dir):
    """The last score taken, and frames since confirmed motion."""
    f = fixture.frames(spark, sf_dir)
    return f.select("video_id", "i", temporal.sticky(F.col("cnn_p"), F.col("i") % 3 == 0).alias("p_frame"), temporal.since(F.col("fg_ratio") >= 0.06, 1_000_000).alias("since_confirmed"))


@query(f"WITH RECURSIVE {FRAMES_SQL}, r AS (SELECT video_id, i, 0.2::DOUBLE * fg_ratio AS ema FROM f WHERE i = 0 UNION ALL SELECT f.video_id, f.i, 0.2::DOUBLE * f.fg_ratio + 0.8::DOUBLE * r.ema FROM r JOIN f ON f.video_id = r.video_id AND f.i = r.i + 1) SELECT video_id, i, round(ema, 9) AS ema FROM r")
def motion_ema(spark, sf_dir):
    return temporal.ema(fixture.frames(spark, sf_dir), "fg_ratio", 0.2, "ema").select("video_id", "i", _r("ema"))


# Scores


@query(scan_sql(ISLANDS) + _summary_sql())
def confusion_summary(spark, sf_dir):
    return _summary(_gated(spark, sf_dir, ISLANDS))


@query(scan_sql(SYMMETRIC) + 'SELECT video_id, count(*) FILTER (WHERE decision) AS kept, round((1.0 - count(*) FILTER (WHERE decision) / 200.0) * 100.0, 9) AS "Storage_Saved_Pct" FROM t GROUP BY video_id')
def storage_saved(spark, sf_dir):
    """Storage saved against the length of the file, which the scanned range is a part of."""
    out = metrics.frame_summary(_gated(spark, sf_dir, SYMMETRIC), WARMUP, F.lit(200).cast("long"))
    return out.select("video_id", "kept", _r("Storage_Saved_Pct"))


_EVENTS_SQL = f""", {_RUNS.format(src='t', hit='gt', name='gr')}, g2 AS (SELECT video_id, greatest(s, 5) AS gs, e AS ge FROM gr WHERE e >= 5), {_RUNS.format(src='t', hit='decision', name='p').replace('g AS', 'g3 AS').replace('FROM g GROUP', 'FROM g3 GROUP')},
o AS (SELECT g2.video_id, gs, ge, p.s AS ps, p.e AS pe, CASE WHEN p.s IS NOT NULL THEN least(ge, p.e) - greatest(gs, p.s) + 1 END AS ov FROM g2 LEFT JOIN p ON p.video_id = g2.video_id AND p.s <= ge AND p.e >= gs),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY video_id, gs, ge ORDER BY ov DESC NULLS LAST, ps) = 1)"""


def _event_inputs(spark, sf_dir, m: Machine):
    g = _gated(spark, sf_dir, m)
    truth = intervals.clipped(temporal.islands(g, F.col("gt")), F.lit(WARMUP).cast("long"), F.lit(1 << 40))
    return g, truth, gates.segments(g)


@query(scan_sql(ISLANDS).replace("b AS (SELECT *,", "bf AS (SELECT *,").replace("FROM b JOIN f", "FROM bf b JOIN f") + _EVENTS_SQL + " SELECT video_id, gs, ge, ps, pe, coalesce(ov, 0)::BIGINT AS overlap FROM b")
def best_overlap(spark, sf_dir):
    _, truth, found = _event_inputs(spark, sf_dir, ISLANDS)
    return intervals.best_overlap(truth.select("video_id", F.col("s").alias("gs"), F.col("e").alias("ge")), found)


_EVENT_METRICS = """SELECT v.video_id, coalesce(round(avg(CASE WHEN b.gs IS NOT NULL THEN (ov IS NOT NULL)::INTEGER END), 9), 0)::DOUBLE AS "Event_Recall", coalesce(round(avg(coalesce(ov, 0) / (ge - gs + 1)::DOUBLE), 9), 0)::DOUBLE AS "Animal_Coverage",
 coalesce(round(avg(CASE WHEN ov IS NOT NULL THEN greatest(0, ps - gs) / 10.0 END), 9), 0)::DOUBLE AS "Mean_Trigger_Delay_Sec", coalesce(round(avg(CASE WHEN ov IS NOT NULL THEN greatest(0, pe - ge) / 10.0 END), 9), 0)::DOUBLE AS "Mean_Extra_Tail_Sec" FROM (SELECT DISTINCT video_id FROM f) v LEFT JOIN b ON b.video_id = v.video_id GROUP BY v.video_id"""


@query(scan_sql(ISLANDS).replace("b AS (SELECT *,", "bf AS (SELECT *,").replace("FROM b JOIN f", "FROM bf b JOIN f") + _EVENTS_SQL + _EVENT_METRICS)
def event_metrics(spark, sf_dir):
    g, truth, found = _event_inputs(spark, sf_dir, ISLANDS)
    out = metrics.event_metrics(truth, found, g, F.lit(FPS))
    return out.select("video_id", *[_r(c) for c in out.columns[1:]])


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT video_id, gt::INTEGER AS g, (fg_pixels >= 60)::INTEGER AS d, CASE WHEN fg_ratio < 0.01 THEN 'none' ELSE 'vibe' END AS stage, fg_pixels / 8.0 AS ms FROM f),
c AS (SELECT video_id, count(*) AS total, count(*) FILTER (WHERE stage <> 'none') AS processed, count(*) FILTER (WHERE g = 1 AND d = 1) AS TP, count(*) FILTER (WHERE g = 0 AND d = 1) AS FP, count(*) FILTER (WHERE g = 1 AND d = 0) AS FN, count(*) FILTER (WHERE g = 0 AND d = 0) AS TN, sum(ms) AS ms FROM l GROUP BY video_id)
SELECT video_id, total, processed, TP, FP, FN, TN, round(pr, 4) AS "Precision", round(re, 4) AS "Recall", round({_F1}, 4) AS "F1_Score", round((1.0 - (TP + FP) / total::DOUBLE) * 100.0, 2) AS "Storage_Saved_Pct" FROM (SELECT *, {_RATES} FROM c)""")
def legacy_summary(spark, sf_dir):
    f = fixture.frames(spark, sf_dir)
    log = f.select("video_id", F.col("gt").cast("int").alias("ground_truth"), (F.col("fg_pixels") >= 60).cast("int").alias("final_decision"), F.when(F.col("fg_ratio") < 0.01, "none").otherwise("vibe").alias("trigger_stage"), (F.col("fg_pixels") / 8.0).alias("time_ms"))
    return metrics.legacy_summary(log).drop("Avg_FPS")


def _events_of(sql: str) -> str:
    """The frames' SQL with its best event matches as b; names that both use are set apart."""
    return sql.replace("b AS (SELECT *,", "bf AS (SELECT *,").replace("FROM b JOIN f", "FROM bf b JOIN f") + _EVENTS_SQL


VARIANTS = {"symmetric": SYMMETRIC, "asymmetric": ISLANDS, "strict": SCANNED}


def sweep(spark, sf_dir) -> DataFrame:
    """All variants over all videos: a union of the variants' summaries, missing columns filled."""
    f = fixture.frames(spark, sf_dir)
    out = None
    for name, m in VARIANTS.items():
        one = metrics.frame_summary(gates.gate(f, m), WARMUP).withColumn("variant", F.lit(name)).withColumn("config_file", F.lit(f"{name}.yaml"))
        one = one.drop("TN") if name == "strict" else one
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _variants_sql(select: str) -> str:
    """The machines' frames side by side: each in a subquery of its own."""
    return " UNION ALL ".join(f"SELECT * FROM ({scan_sql(m)} {select.format(v=v, tn='NULL::BIGINT' if v == 'strict' else 'TN')})" for v, m in VARIANTS.items())


@query(_variants_sql("SELECT '{v}' AS variant, '{v}.yaml' AS config_file, video_id, processed, kept, TP, FP, FN, {tn} AS TN FROM (SELECT video_id, " + _SCORES + " FROM t GROUP BY video_id)"))
def variant_merge(spark, sf_dir):
    return sweep(spark, sf_dir).select("variant", "config_file", "video_id", "processed", "kept", "TP", "FP", "FN", "TN")


def _event_variants_sql() -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_events_of(scan_sql(m))}, em AS ({_EVENT_METRICS}), sm AS (SELECT video_id, {_SCORES} FROM t GROUP BY video_id) SELECT '{v}' AS variant, * FROM sm JOIN em USING (video_id))" for v, m in VARIANTS.items())


_WEIGHTED = ", ".join(f"""round(CASE WHEN sum(TP + FN) > 0 THEN sum("{c}" * (TP + FN)) / sum(TP + FN) ELSE 0 END, 6) AS "{c}\"""" for c in ("Animal_Coverage", "Mean_Trigger_Delay_Sec", "Mean_Extra_Tail_Sec"))


@query(f"WITH e AS ({_event_variants_sql()}), u AS (SELECT variant, sum(TP)::BIGINT AS TP, sum(FP)::BIGINT AS FP, sum(FN)::BIGINT AS FN, {_WEIGHTED}, (1.0 - sum(kept) / sum(processed)::DOUBLE) * 100.0 AS sv FROM e GROUP BY variant)" + f" SELECT variant, TP, FP, FN, \"Animal_Coverage\", \"Mean_Trigger_Delay_Sec\", \"Mean_Extra_Tail_Sec\", round(sv, 6) AS \"Storage_Saved_Pct\", round(pr, 9) AS \"Precision\", round(re, 9) AS \"Recall\", round({_F1}, 9) AS \"F1_Score\" FROM (SELECT *, {_RATES} FROM u)")
def leaderboard(spark, sf_dir):
    """All variants over all videos, with the means of their events."""
    f, out = fixture.frames(spark, sf_dir), None
    for name, m in VARIANTS.items():
        g, truth, found = _event_inputs(spark, sf_dir, m)
        one = metrics.frame_summary(g, WARMUP).join(metrics.event_metrics(truth, found, f, F.lit(FPS)), "video_id").withColumn("variant", F.lit(name))
        out = one if out is None else out.unionByName(one)
    out = metrics.leaderboard(out)
    return out.select("variant", "TP", "FP", "FN", *[_r(c, 6) for c in ("Animal_Coverage", "Mean_Trigger_Delay_Sec", "Mean_Extra_Tail_Sec", "Storage_Saved_Pct")], *[_r(c) for c in ("Precision", "Recall", "F1_Score")])


@query(scan_sql(HYBRID) + f"SELECT video_id::VARCHAR AS video_id, i AS frame_id, gt::INTEGER AS ground_truth, round(fg_ratio, 9) AS vibe_mask_ratio, round(energy, 9) AS mhi_energy, p AS cnn_confidence, decision::INTEGER AS final_decision, {label_sql(HYBRID)} AS trigger_source FROM t")
def detection_log(spark, sf_dir):
    """The detection log (without its wall-clock column)."""
    out = _scanned(spark, sf_dir, HYBRID)
    return out.select(F.col("video_id").cast("string").alias("video_id"), F.col("i").alias("frame_id"), F.col("gt").cast("int").alias("ground_truth"), _r(F.col("fg_ratio")).alias("vibe_mask_ratio"), _r(F.col("mhi_energy")).alias("mhi_energy"), F.col("p_frame").alias("cnn_confidence"), F.col("decision").cast("int").alias("final_decision"), labels.trigger_source("vibe", 0.45, F.col("backfill")).alias("trigger_source"))


@query(_events_of(scan_sql(HYBRID)) + f""", em AS ({_EVENT_METRICS}), sm AS (SELECT *, {_RATES} FROM (SELECT video_id, count(*) FILTER (WHERE ran) AS runs, {_SCORES} FROM t GROUP BY video_id))
SELECT video_id::VARCHAR AS video_id, processed AS total_frames, runs AS frames_processed, TP, FP, FN, round(pr, 9) AS "Precision", round(re, 9) AS "Recall", round({_F1}, 9) AS "F1_Score", em.* EXCLUDE (video_id), round((1.0 - kept / 300.0) * 100.0, 9) AS "Storage_Saved_Pct", NULL::DOUBLE AS "Avg_FPS" FROM sm JOIN em USING (video_id)""")
def benchmark_summary(spark, sf_dir):
    """The summary in all its columns; the scanned frames are a part of files of 300 frames. Rows that were not
    timed have no frames a second."""
    g = _scanned(spark, sf_dir, HYBRID)
    truth = intervals.clipped(temporal.islands(g, F.col("gt")), F.lit(WARMUP).cast("long"), F.lit(1 << 40))
    runs = g.groupBy("video_id").agg(F.count_if("ran_cnn").alias("frames_processed"))
    events = metrics.event_metrics(truth, gates.segments(g), g, F.lit(FPS))
    out = metrics.frame_summary(g, WARMUP, F.lit(300).cast("long")).join(runs, "video_id").join(events, "video_id")
    return out.select(F.col("video_id").cast("string").alias("video_id"), F.col("processed").alias("total_frames"), "frames_processed", "TP", "FP", "FN", *[_r(c) for c in ("Precision", "Recall", "F1_Score", *events.columns[1:], "Storage_Saved_Pct")], F.lit(None).cast("double").alias("Avg_FPS"))


# Array kernels on 8 x 8 frames


@query(f"WITH {PIXELS_SQL} SELECT video_id, i, round(list_sum(gray) / 64.0, 9) AS mean_luma, len(list_filter(gray, lambda x: x >= 140))::INTEGER AS fg_pixels, round(len(list_filter(gray, lambda x: x >= 140)) / 64.0, 9) AS fg_ratio FROM e")
def mean_luma(spark, sf_dir):
    g = F.col("gray")
    fg = F.size(F.filter(g, lambda x: x >= 140))
    return fixture.pixels(spark, sf_dir).select("video_id", "i", _r(F.aggregate(g, F.lit(0), lambda a, x: a + x) / F.lit(64.0)).alias("mean_luma"), fg.alias("fg_pixels"), _r(fg / F.lit(64.0)).alias("fg_ratio"))


def _ema_line_sql(value: str, seed: str, a: float, lo: float, hi: float, x: float, y: float) -> str:
    return f"""WITH RECURSIVE {PIXELS_SQL}, m AS (SELECT video_id, i, ({value})::DOUBLE AS v FROM e), r AS (SELECT video_id, i, {seed} AS ema FROM m WHERE i = 0 UNION ALL SELECT m.video_id, m.i, {a}::DOUBLE * m.v + {1 - a}::DOUBLE * r.ema FROM r JOIN m ON m.video_id = r.video_id AND m.i = r.i + 1)
SELECT video_id, i, greatest(1, round_even({x} + least(1.0, greatest(0.0, (ema - {lo}) / {hi - lo})) * {y - x}, 0))::BIGINT AS setting FROM r"""


@query(_ema_line_sql("list_sum(gray) / 64.0", "v", 0.2, 115.0, 140.0, 1.0, 4.0))
def at_min_matches(spark, sf_dir):
    """Adaptive threshold: matches needed, from the smoothed mean of the frame."""
    p = fixture.pixels(spark, sf_dir).withColumn("v", F.aggregate("gray", F.lit(0), lambda a, x: a + x) / F.lit(64.0))
    return temporal.ema(p, "v", 0.2, "ema", None).select("video_id", "i", scalars.clamped_lerp(F.col("ema"), 115.0, 140.0, 1, 4, 2, 1, 20).alias("setting"))


@query(_ema_line_sql("len(list_filter(gray, lambda x: x >= 140)) / 64.0", "0.2::DOUBLE * v", 0.2, 0.1, 0.4, 8.0, 64.0))
def alr_update_period(spark, sf_dir):
    """Adaptive update period, from the smoothed share of foreground."""
    p = fixture.pixels(spark, sf_dir).withColumn("v", F.size(F.filter("gray", lambda x: x >= 140)) / F.lit(64.0))
    return temporal.ema(p, "v", 0.2, "ema").select("video_id", "i", scalars.clamped_lerp(F.col("ema"), 0.1, 0.4, 8, 64, 16).alias("setting"))


@query(f"WITH {PIXELS_SQL}, x AS (SELECT video_id, i, unnest(range(64)) AS p, unnest(gray) AS g FROM e), c AS (SELECT a.video_id, a.i, a.p, count(*) FILTER (WHERE abs(b.g - a.g) < 20) AS n FROM x a JOIN x b ON b.video_id = a.video_id AND b.p = a.p AND b.i BETWEEN a.i - 5 AND a.i - 1 WHERE a.i >= 5 GROUP BY ALL) SELECT video_id, i, p::INTEGER AS p, n::INTEGER AS matches, n < 2 AS foreground FROM c")
def match_count(spark, sf_dir):
    """Sample matches and classification of every pixel, the five frames before as its samples."""
    x = fixture.pixels(spark, sf_dir).select("video_id", "i", F.posexplode("gray").alias("p", "g"))
    w = W.partitionBy("video_id", "p").orderBy("i").rowsBetween(-5, -1)
    n = regions.match_count(F.col("bank"), F.col("g"), 20)
    return x.withColumn("bank", F.collect_list("g").over(w)).where("i >= 5").select("video_id", "i", "p", n.alias("matches"), (n < 2).alias("foreground"))


@query(f"WITH {PIXELS_SQL}, x AS (SELECT video_id, i, unnest(range(64)) AS p, unnest(gray) AS g FROM e), h AS (SELECT *, i - max(i) FILTER (WHERE g >= 160) OVER (PARTITION BY video_id, p ORDER BY i) AS d FROM x) SELECT video_id, i, round(avg((coalesce(d, 99) < 6)::INTEGER), 9)::DOUBLE AS active, round(avg((coalesce(d, 99) <= 3)::INTEGER), 9)::DOUBLE AS recent FROM h GROUP BY video_id, i")
def mhi_active_recent(spark, sf_dir):
    """Motion history of every pixel: the share in it, and in its most recent part (memory of 6, from 3 on)."""
    x = fixture.pixels(spark, sf_dir).select("video_id", "i", F.posexplode("gray").alias("p", "g"))
    last = F.max(F.when(F.col("g") >= 160, F.col("i"))).over(W.partitionBy("video_id", "p").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    mem = F.greatest(F.lit(0), F.coalesce(6 - (F.col("i") - last), F.lit(0)))
    return x.withColumn("mem", mem).groupBy("video_id", "i").agg(_r(F.avg((F.col("mem") > 0).cast("double"))).alias("active"), _r(F.avg((F.col("mem") >= 3).cast("double"))).alias("recent"))


_COMPONENTS = f"""WITH RECURSIVE {PIXELS_SQL}, x AS (SELECT video_id, i, p, p % 8 AS px, p // 8 AS py FROM (SELECT video_id, i, unnest(range(64)) AS p, unnest(gray) AS g FROM e) WHERE g >= 150),
r AS (SELECT video_id, i, p AS label, p, px, py FROM x UNION SELECT r.video_id, r.i, r.label, x.p, x.px, x.py FROM r JOIN x ON x.video_id = r.video_id AND x.i = r.i AND abs(x.px - r.px) <= 1 AND abs(x.py - r.py) <= 1),
l AS (SELECT video_id, i, p, px, py, min(label) AS label FROM r GROUP BY ALL),
k AS (SELECT video_id, i, label, count(*) AS area, min(px) AS x, min(py) AS y, max(px) AS x2, max(py) AS y2 FROM l GROUP BY video_id, i, label HAVING count(*) >= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY video_id, i ORDER BY area DESC, label) AS rank FROM k QUALIFY rank <= 3)
"""


def _top(spark, sf_dir):
    p = fixture.pixels(spark, sf_dir)
    return regions.largest(p.select("video_id", "i", F.transform("gray", lambda x: x >= 150).alias("mask")), 2, 3, 8)


@query(_COMPONENTS + "SELECT video_id, i, rank::INTEGER AS rank, area, x::INTEGER AS x, y::INTEGER AS y, (x2 - x + 1)::INTEGER AS w, (y2 - y + 1)::INTEGER AS h FROM t")
def component_topk(spark, sf_dir):
    return _top(spark, sf_dir)


@query(_COMPONENTS + """, b AS (SELECT video_id, i, rank, x + 0.5 * (x2 - x + 1) AS cx, y + 0.5 * (y2 - y + 1) AS cy, 0.675 * (x2 - x + 1) AS dx, 0.675 * (y2 - y + 1) AS dy FROM t)
SELECT video_id, i, rank::INTEGER AS rank, greatest(0, least(7, round_even(cx - dx, 0) - 1))::INTEGER AS x1, greatest(0, least(7, round_even(cy - dy, 0) - 1))::INTEGER AS y1, greatest(0, least(8, round_even(cx + dx, 0) + 1))::INTEGER AS x2, greatest(0, least(8, round_even(cy + dy, 0) + 1))::INTEGER AS y2 FROM b""")
def box_proposals(spark, sf_dir):
    b = scalars.expanded_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 1.35, 1, 8, 8)
    return _top(spark, sf_dir).select("video_id", "i", "rank", b.alias("b")).select("video_id", "i", "rank", "b.*")


@query(f"WITH {PIXELS_SQL} SELECT video_id, i, len(list_filter(gray, lambda x: x >= 150))::INTEGER AS any_level, len(list_filter(gray, lambda x: x = 255))::INTEGER AS full_level, round(1 / (1 + exp(-(gray[1] / 100.0))), 9) AS one, round(exp(gray[2] / 100.0) / (exp(gray[1] / 100.0) + exp(gray[2] / 100.0)), 9) AS many FROM e")
def masks_and_heads(spark, sf_dir):
    """Shadow thresholds of a mask, and score heads of one and of two logits."""
    logits = lambda k: F.transform(F.slice("gray", 1, k), lambda x: x / F.lit(100.0))
    count = lambda *a: F.size(F.filter(scalars.shadows_dropped(F.col("gray"), *a), lambda x: x))
    return fixture.pixels(spark, sf_dir).select("video_id", "i", count(150, False, False).alias("any_level"), count(150, True, False).alias("full_level"), _r(scalars.positive_share(logits(1))).alias("one"), _r(scalars.positive_share(logits(2))).alias("many"))


# Pixel streams: checked by unit tests


def _gray_frames(spark, sf_dir) -> DataFrame:
    p = fixture.pixels(spark, sf_dir)
    raw = F.unhex(F.array_join(F.transform("gray", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return p.select("video_id", "i", F.lit(8).alias("height"), F.lit(8).alias("width"), raw.alias("gray"))


SMALL = Postprocess(median_blur_ksize=3, erode_iters=0, dilate_iters=1, min_blob_area=2, max_blobs=3)


@query()
def vibe_stream(spark, sf_dir):
    return pixels.vibe(_gray_frames(spark, sf_dir), Background(radius=30, adaptive_min_matches=True, adaptive_update=True), SMALL, min_crop=1)


@query()
def gmm_stream(spark, sf_dir):
    return pixels.mog2(_gray_frames(spark, sf_dir), SMALL, history=20, min_crop=1)


#: A guard that holds most of the time: all frames of the fixture are night to it, all scores low.
HARDENED = replace(ADAPTIVE, adaptive=replace(ADAPTIVE.adaptive, cnn_motion_high_fg_ratio=0.9, fp_guard=replace(GUARD, night_luma_threshold=256.0, negative_p=0.6, negative_streak_to_activate=1, hold_sec=0.4)))
HARDENED_BANK, HARDENED_CROPS = Background(radius=30, min_matches=2, subsampling_factor=8), Crops(min_crop_area=1, pad_px=0, input_size=8, output="sigmoid")


@query()
def guard_feedback(spark, sf_dir):
    """The gate whose guard hardens the background model: one ordered pass."""
    return feedback.run(_gray_frames(spark, sf_dir), HARDENED, HARDENED_BANK, SMALL, HARDENED_CROPS)


@query()
def cnn_score(spark, sf_dir):
    f = _gray_frames(spark, sf_dir)
    b = pixels.vibe(f, Background(radius=30), SMALL, min_crop=1).select("video_id", "i", "boxes")
    return scorer.score(f.join(b, ["video_id", "i"]), size=8)


