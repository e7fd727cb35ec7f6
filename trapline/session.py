"""Session settings and shared folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local one only where none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix=f"{name}-") + "/data"
