"""Manifests, configuration files and paths."""

from __future__ import annotations

import os
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "items array<struct<id:string,video_path:string,annotation_path:string,fps:double>>"


def items(spark: SparkSession, path: str, only_ids: list[str] | None = None) -> DataFrame:
    """(id, video_path, annotation_path, fps) of a JSON manifest; no ids, or none given, means all."""
    rows = spark.read.schema(ITEMS).option("multiLine", True).json(path).select(F.explode("items").alias("x")).select("x.*")
    return rows.where(F.col("id").isin(only_ids)) if only_ids else rows


def resolved(path: str, bases: list[str]) -> str:
    """An existing path: as given, or below the first base that has it; else the path unchanged."""
    for p in [Path(path), *[Path(b) / path for b in bases]]:
        if p.exists():
            return str(p)
    return path


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f)
    if not isinstance(out, dict):
        raise ValueError(f"{path} must hold a mapping")
    return out


#: The order in which variants are run and listed; fixed values.
PREFERRED = ["vibe", "vibe_AT", "vibe_ALR", "vibe_AT_ALR", "vibe_MHI", "vibe_AT_ALR_MHI", "vibe_cnn", "vibe_AT_ALR_cnn", "vibe_MHI_cnn", "vibe_AT_ALR_MHI_cnn"]


def discover(folder: str, preferred: list[str] | None = None) -> list[str]:
    """Configuration files of a folder: the preferred ones in their order, then all others by name."""
    names = {os.path.splitext(n)[0]: os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith((".yaml", ".yml"))}
    first = [n for n in (PREFERRED if preferred is None else preferred) if n in names]
    return [names[n] for n in [*first, *[n for n in names if n not in first]]]


def output_paths(config: dict, default: str = "benchmark_summary.csv") -> tuple[str, str]:
    """Summary and detection-log paths of a configuration."""
    summary = config.get("benchmark_summary_csv") or config.get("output_csv") or default
    p = Path(summary)
    return str(summary), config.get("detection_log_csv") or str(p.with_name(f"{p.stem}_detection_log{p.suffix or '.csv'}"))
