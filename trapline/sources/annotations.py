"""Ground truth from annotation JSON in any of its five shapes.

The first shape that is not empty wins: events in seconds, frame intervals, positive frames,
a `frames` object, a `frames` list. Everything is VARIANT expressions on one text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import islands

INTERVALS, POSITIVES, FRAME_IDS = ("intervals", "gt_intervals", "events_frames"), ("positive_frames", "pos_frames", "gt_frames", "frames_pos"), ("frame_id", "frame_idx", "frame")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, doc): one row per annotation file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def _list(v: Column, key: str) -> Column:
    """An array of variants under a key, null unless it is a list with elements."""
    x = F.try_variant_get(v, f"$.{key}", "array<variant>")
    return F.when(F.size(x) > 0, x)


def _int(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "double").cast("long")


def extract(docs: DataFrame, fps: Column, fall_through: bool = False) -> DataFrame:
    """(video_id, s, e) of rows (video_id, doc). A list of invalid intervals only counts as no ground truth, or with
    `fall_through` as an empty shape."""
    d = docs.select("video_id", fps.cast("double").alias("fps"), F.try_parse_json("doc").alias("v"))
    events = _list(F.col("v"), "events")
    spans = F.coalesce(*[_list(F.col("v"), k) for k in INTERVALS])
    pairs = F.transform(spans, lambda x: F.struct(F.coalesce(_int(x, "$[0]"), _int(x, "$.start")).alias("s"), F.coalesce(_int(x, "$[1]"), _int(x, "$.end")).alias("e")))
    pairs = F.filter(pairs, lambda p: p.e >= p.s)
    if fall_through:
        pairs = F.when(F.size(pairs) > 0, pairs)
    frames = F.coalesce(*[_list(F.col("v"), k) for k in POSITIVES])
    frames = F.transform(frames, lambda x: _int(x))
    as_map = F.try_variant_get("v", "$.frames", "map<string,variant>")
    as_map = F.when(F.size(as_map) > 0, as_map)
    empty = lambda x: x.isNull() | F.is_variant_null(x) | F.coalesce(F.size(F.try_variant_get(x, "$", "array<variant>")) == 0, F.lit(False)) | F.coalesce(F.to_json(x) == "{}", F.lit(False))
    keyed = F.transform(F.filter(F.map_entries(as_map), lambda x: x.key.try_cast("long").isNotNull() & ~empty(x.value)), lambda x: x.key.try_cast("long"))
    listed = _list(F.col("v"), "frames")

    def own(x: Column) -> Column:
        """The id under the first key that is there, whatever it holds."""
        out = F.lit(None).cast("long")
        keys = F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))
        for k in reversed(FRAME_IDS):
            out = F.when(F.array_contains(keys, k), _int(x, f"$.{k}")).otherwise(out)
        return out

    ids = F.filter(F.transform(listed, own), lambda x: x.isNotNull())
    d = d.select("video_id", "fps", events.alias("events"), pairs.alias("pairs"), F.coalesce(frames, keyed, ids).alias("frames"))
    seconds = F.transform("events", lambda x: F.struct(F.greatest(F.lit(0).cast("long"), F.floor(F.try_variant_get(x, "$.start_sec", "double") * F.col("fps"))).alias("s"), (F.ceil(F.try_variant_get(x, "$.end_sec", "double") * F.col("fps")) - 1).alias("e")))
    rows = d.select("video_id", F.explode(F.coalesce(F.when(F.col("events").isNotNull(), F.filter(seconds, lambda p: p.e >= p.s)), F.col("pairs"))).alias("p"))
    whole = rows.select("video_id", F.col("p.s").cast("long").alias("s"), F.col("p.e").cast("long").alias("e"))
    single = d.where("events is null and pairs is null").select("video_id", F.explode(F.array_distinct("frames")).alias("i"))
    return whole.unionByName(islands(single, F.lit(True)))
