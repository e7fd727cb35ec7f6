"""Token-id output: length-delimited binary records with masked checksums, and an offset index.

A shard file is a run of records, one per document, in ascending document order:

    uint64 length | uint32 masked(length bytes) | payload | uint32 masked(payload) | "\\n"

all little-endian; `masked(x)` is ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32 of the
CRC-32 of x, so that a checksum stored inside checksummed data doesn't look like one. The
payload is uint8 null-id flag, int64 id, uint8 width (2 or 4), then the token ids. The last
byte only closes the record. Shards are Spark's own output files (an executor that is lost
leaves no half-written shard), numbered in the order of the ids. `index/` beside `data/` is a
Parquet table: file, seq, id, offset, length, n_tokens, start; with it any set of records can
be read in any order. `shards/` has one row per shard: the ids of all documents before it.

Defined cases: a null or empty text is the end id alone; null ids come first; rows repeated
with one id are records of their own, ordered by the text's hash; an empty table gives an
empty index and no records; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime as R
from . import vec
from .pretoken import Encoder

HEAD, INSIDE = struct.Struct("<QI"), struct.Struct("<BqB")
#: Shards whose sizes are added up by one task.
RUN = 1024
INDEX = "file string, seq int, id long, offset long, length long, n_tokens long, start_in_file long"


class Damaged(ValueError):
    """A record whose checksum or length doesn't hold."""


def masked(data: bytes | memoryview) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    payload = INSIDE.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload)), b"\n"))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """Document id and token ids of the record at an offset, and the next record's offset."""
    if at + HEAD.size > len(data):
        raise Damaged(f"the record at {at} ends early")
    n, check = HEAD.unpack_from(data, at)
    end = at + HEAD.size + n
    if masked(data[at : at + 8]) != check or n < INSIDE.size or end + 5 > len(data):
        raise Damaged(f"the length at {at} doesn't hold")
    payload = data[at + HEAD.size : end]
    if masked(payload) != int.from_bytes(data[end : end + 4], "little"):
        raise Damaged(f"the record at {at} doesn't hold")
    null, doc_id, width = INSIDE.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=INSIDE.size), end + 5


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """The tokenizers library behind the cache of pieces; once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    # pieces can't show an added token: texts that hold one go whole to the library
    added = [x.content.encode() for x in t.get_added_tokens_decoder().values()]

    def pieces(xs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in t.encode_batch_fast([x.decode() for x in xs], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64)

    return Encoder(pieces, lambda text: t.encode(text, add_special_tokens=False).ids, whole=added)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 6 * R.MB) -> DataFrame:
    """Encodes the documents, writes `path`/data and `path`/index, and returns the index.
    tokenizer: a file of the tokenizers library (byte-level BPE, up to 65,536 ids) that every
    executor has. shard_bytes: input bytes for one shard."""
    R.short_batches(docs.sparkSession)
    vocabulary = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def f(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            buf, at = vec.text_buffer(batch["text"])
            names = batch["id"].to_pylist()
            for i, j in vec.blocks(buf, at, 1 << 18):
                ids, counts = enc.encode(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                upto = np.concatenate(([0], np.cumsum(counts)))
                yield pa.RecordBatch.from_arrays([pa.array([frame(names[i + k], np.append(ids[upto[k] : upto[k + 1]], np.uint16(end_id)), 2)[:-1] for k in range(j - i)], pa.binary())], ["record"])
        R.trim()

    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(i.alias("id"), t.alias("text"), F.xxhash64(t).alias("th"))
    dealt = rows.repartitionByRange(R.parts_for(docs, shard_bytes, 12), "id").sortWithinPartitions("id", "th")
    # the text writer writes a string's bytes as they are, then the closing byte
    dealt.select("id", "text").mapInArrow(f, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(f"{path}/data")
    spark = docs.sparkSession
    found = R.cut_to(_files(spark, path).mapInArrow(_scan, INDEX), f"{path}/found")
    _bases(found.groupBy("file").agg(F.sum("n_tokens").alias("n"))).coalesce(1).write.parquet(f"{path}/shards")
    bases = spark.read.parquet(f"{path}/shards")
    found.join(bases, "file").select("file", "seq", "id", "offset", "length", "n_tokens", (F.col("base") + F.col("start_in_file")).alias("start")).write.parquet(f"{path}/index")
    R.drop(spark, f"{path}/found")
    return spark.read.parquet(f"{path}/index")


def _bases(shards: DataFrame) -> DataFrame:
    """(file, base): the ids of all shards before each. Shards are summed by RUN files, runs one after another."""
    run = F.floor(F.regexp_extract("file", r"part-(\d+)", 1).cast("long") / RUN)
    numbered = shards.withColumn("run", run)
    runs = numbered.groupBy("run").agg(F.sum("n").alias("all")).select("run", (F.sum("all").over(W.partitionBy(F.lit(0)).orderBy("run")) - F.col("all")).alias("before"))
    return numbered.join(runs, "run").select("file", (F.col("before") + F.sum("n").over(W.partitionBy("run").orderBy("file")) - F.col("n")).alias("base"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


_SCHEMA = pa.schema([("file", pa.string()), ("seq", pa.int32()), *((c, pa.int64()) for c in ("id", "offset", "length", "n_tokens", "start_in_file"))])


def _scan(batches):
    """Index rows of whole shards, every checksum read."""
    for batch in batches:
        for file, data in zip(batch["file"].to_pylist(), batch["content"], strict=True):
            data, at, start, rows = memoryview(data.as_buffer()), 0, 0, []
            while at < len(data):
                doc_id, ids, after = unframe(data, at)
                rows.append((file, len(rows), doc_id, at, after - at, len(ids), start))
                at, start = after, start + len(ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


RECORD = "file string, seq int, id long, start_in_file long, n_tokens long, ids array<int>"
DIGEST = "file string, seq int, id long, start_in_file long, n_tokens long, ids_crc32 long"


def _records(rows: list[tuple], schema: str = RECORD) -> pa.RecordBatch:
    file, seq, doc_id, start, ids = zip(*rows, strict=True)
    n = [len(x) for x in ids]
    if schema == DIGEST:
        last = pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())
    else:
        last = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(file), pa.array(seq, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), last], [c.split()[0] for c in schema.split(", ")])


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(file, seq, id, start, n_tokens, ids) of all records: every shard is read through once, every checksum
    too. digest: instead of ids, ids_crc32, the CRC-32 of the ids as little-endian 32-bit numbers."""
    schema = DIGEST if digest else RECORD

    def f(batches):
        for batch in batches:
            for file, data in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                data, at, seq, start, rows, held = memoryview(data.as_buffer()), 0, 0, 0, [], 0
                while at < len(data):
                    doc_id, ids, at = unframe(data, at)
                    rows.append((file, seq, doc_id, start, ids))
                    seq, start, held = seq + 1, start + len(ids), held + len(ids)
                    if held > 1 << 19:
                        yield _records(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _records(rows, schema)
        R.trim()

    out = _files(spark, path).mapInArrow(f, schema).join(spark.read.parquet(f"{path}/shards"), "file")
    return out.select("file", "seq", "id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", schema.split(", ")[-1].split()[0])


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The same of some rows of the index, in any order: a shard is opened once and its wanted records cut out by offset."""
    asked = wanted.groupBy("file").agg(F.collect_list(F.struct("seq", "offset", "start")).alias("asked"))

    def f(batches):
        for batch in batches:
            for file, data, rows in zip(batch["file"].to_pylist(), batch["content"], batch["asked"].to_pylist(), strict=True):
                data = memoryview(data.as_buffer())
                for k in range(0, len(rows), 500):
                    yield _records([(file, x["seq"], doc_id, x["start"], ids) for x in rows[k : k + 500] for doc_id, ids, _ in [unframe(data, x["offset"])]])

    return _files(spark, path).join(asked, "file").mapInArrow(f, RECORD).withColumnRenamed("start_in_file", "start")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    path = R.scratch(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, digest=True).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
