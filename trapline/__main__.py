"""python -m trapline --frames TABLE --truth TABLE (--config FILE | --configs_dir FOLDER) --out FOLDER"""

from __future__ import annotations

import argparse
import os

from .plans.evaluate import evaluate, sweep
from .session import session
from .sources import manifest, tables


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="trapline")
    p.add_argument("--frames", required=True, help="Parquet table (video_id, i, height, width, gray)")
    p.add_argument("--truth", required=True, help="Parquet table (video_id, s, e)")
    p.add_argument("--config")
    p.add_argument("--configs_dir")
    p.add_argument("--out", required=True)
    p.add_argument("--fps", type=float, default=30.0)
    p.add_argument("--no_default_order", action="store_true")
    p.add_argument("--evaluator", choices=["auto", "vibe", "mog2"], default="auto", help="background model; auto: by the configuration's sections")
    p.add_argument("--merged_csv", help="where a folder's merged summary goes (default: merged_summary below --out)")
    p.add_argument("--skip_eval", action="store_true", help="only show the merged summary of an earlier run")
    p.add_argument("--quiet", action="store_true")
    a = p.parse_args(argv)
    flavour = lambda c: a.evaluator if a.evaluator != "auto" else "mog2" if "mog2" in c else "vibe"
    if bool(a.config) == bool(a.configs_dir):
        p.error("give --config or --configs_dir")
    spark = session()
    frames, truth = spark.read.parquet(a.frames), spark.read.parquet(a.truth)
    if a.config:
        c = manifest.load_config(a.config)
        log, summary = evaluate(frames, truth, c, a.fps, flavour(c))
        tables.write_log(log, os.path.join(a.out, "detection_log"))
        tables.write_summary(summary, os.path.join(a.out, "benchmark_summary"))
    else:
        found = manifest.discover(a.configs_dir, [] if a.no_default_order else None)
        configs = {os.path.splitext(os.path.basename(f))[0]: manifest.load_config(f) for f in found}
        merged = a.merged_csv or os.path.join(a.out, "merged_summary")
        if not a.skip_eval:
            tables.write_merged(sweep(frames, truth, configs, a.fps, flavour), merged)
        if not a.quiet:
            spark.read.csv(merged, header=True).show(100, False)


if __name__ == "__main__":
    main()
