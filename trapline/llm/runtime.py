"""Plan-time helpers of the corpus operators: sizes, lineage cuts, document chunks."""

from __future__ import annotations

import ctypes
import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MB = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is made only where none is configured and all
    executors are threads of this process (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = spark.sparkContext
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="trapline-"))
        d = sc._jsc.sc().getCheckpointDir().get()
    return d


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold fewer rows than Spark's default; a session's own choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder, so later work has no lineage to redo and the
    planner knows its size (a checkpoint keeps the estimate of the plan that it cut)."""
    return cut_to(df, scratch(df.sparkSession, "cut"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Size of the input as the plan's statistics have it (file sizes: no job). Rows from the driver and
    joins have a product of estimates instead; they are written down first and then measured."""
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if not re.search(r"\bRelation(V2)? ?\[", text) or "Join" in text:
        plan = cut(df)._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes()))


def parts_for(df: DataFrame, each: int, least: int = 1) -> int:
    return max(least, math.ceil(plan_bytes(df) / each))


def chunked(docs: DataFrame, id_col: str, text_col: str, n: int, carry: list[str] | None = None) -> DataFrame:
    """(chunk, id, th, text): documents dealt to n chunks by a hash of id and text, which no
    source or group of copies with different ids can make uneven. carry: columns that go along, as a struct."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    more = [F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]).alias("carry")] if carry else []
    return docs.select(F.pmod(F.xxhash64(i, t), F.lit(n)).cast("int").alias("chunk"), i.alias("id"), F.xxhash64(t).alias("th"), t.alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def in_order(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order that doesn't depend on how the shuffle delivered them."""
    ids = table["id"]
    o = np.lexsort((table["th"].to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()))
    return table.take(pa.array(o))


def trim() -> None:
    """Gives a Python worker's freed memory back: workers live on between stages, and allocators keep what they freed."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free:
        free(0)


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def strings(buf: np.ndarray, at: np.ndarray, kind=pa.large_binary()) -> pa.Array:
    """An Arrow array over a byte buffer and its n + 1 offsets."""
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def cut_to(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows as a table in the shared folder and returns the table."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
