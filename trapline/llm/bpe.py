"""Byte-level BPE encoding and decoding from a rank file, with segment trees.

Within a piece, a segment tree over its byte positions stores in each leaf the rank of the
pair that starts there and in each inner node the least (rank, position) below it, so the
root is the leftmost pair of lowest rank. A merge rewrites three leaves (the pair, its right
part and the live neighbour before it) and their paths: logarithmic point updates. Short
pieces run in lockstep, one NumPy row per piece; long ones each have a tree of their own, so
a piece of n bytes costs O(n log n).

Defined cases: a null or empty text has no tokens and decodes to no bytes; null ids stay
null; rows repeated are encoded each; an empty table gives no rows; other columns are not
read. Ids fit in 16 bits for vocabularies of up to 65,536 tokens; larger ones are refused.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from . import vec
from .pretoken import Encoder

#: Pieces of up to so many bytes run in lockstep.
SHORT = 64
NONE = np.int64(1) << np.int64(60)


class Ranks:
    """The merges of a rank file: id of a pair of ids, or none."""

    def __init__(self, data: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        if max(self.rank.values()) > 0xFFFF:
            raise ValueError("vocabularies of more than 65,536 tokens aren't supported")
        keys, values = [], []
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 16 | b)
                    values.append(r)
        k, v = np.array(keys, np.int64), np.array(values, np.int64)
        o = np.argsort(k)
        self.keys, self.values = np.append(k[o], np.int64(1) << 40), np.append(v[o], -1)
        self.pair = dict(zip(keys, values, strict=True))
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        words = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            words[r] = token
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(w) for w in words])))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where there is none."""
        k = a << 16 | b
        i = np.searchsorted(self.keys, k)
        return np.where(self.keys[i] == k, self.values[i], -1)

    def long(self, piece: bytes) -> list[int]:
        """One piece by its own segment tree."""
        n, size = len(piece), 1 << max(1, (len(piece) - 1).bit_length())
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        leaf = np.full(size, NONE)
        r = self.pairs(ids[:-1], ids[1:])
        leaf[: n - 1] = np.where(r >= 0, r * size + np.arange(n - 1), NONE)
        levels = [leaf]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
        none, ids = int(NONE), ids.tolist()
        after, ahead, pair = list(range(1, n + 1)), list(range(-1, n - 1)), self.pair

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                m = a if a < b else b
                if tree[i] == m:
                    break
                tree[i] = m

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            k = after[j]
            ids[i], after[i] = rank, k
            put(j, none)
            if k < n:
                ahead[k] = i
                x = pair.get(rank << 16 | ids[k], -1)
                put(i, x * size + i if x >= 0 else none)
            else:
                put(i, none)
            if (p := ahead[i]) >= 0:
                x = pair.get(ids[p] << 16 | rank, -1)
                put(p, x * size + p if x >= 0 else none)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def lockstep(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of 2 to `size` bytes (a power of two), a row each: ids and a mask of the live positions."""
        m = len(pieces)
        n = np.array([len(x) for x in pieces])
        live = np.arange(size) < n[:, None]
        ids = np.zeros((m, size + 1), np.int64)
        ids[:, :size][live] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 1), (m, 1))
        ahead = np.tile(np.arange(-1, size), (m, 1))
        tree = np.full((m, 2 * size), NONE)
        r = self.pairs(ids[:, : size - 1], ids[:, 1:size])
        tree[:, size : 2 * size - 1] = np.where((r >= 0) & live[:, 1:], r * size + np.arange(size - 1), NONE)
        half = size
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            i = i + size
            tree[rows, i] = value
            for _ in range(size.bit_length() - 1):
                i = i >> 1
                tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while rows.size:
            rank, i = np.divmod(tree[rows, 1], size)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], after[rows, i], live[rows, j] = rank, k, False
            put(rows, j, NONE)
            inside = k < n[rows]
            ahead[rows[inside], k[inside]] = i[inside]
            x = self.pairs(rank, ids[rows, np.minimum(k, size)])
            put(rows, i, np.where(inside & (x >= 0), x * size + i, NONE))
            p = ahead[rows, i]
            some = p >= 0
            rp, p = rows[some], p[some]
            x = self.pairs(ids[rp, p], rank[some])
            put(rp, p, np.where(x >= 0, x * size + p, NONE))
            rows = rows[tree[rows, 1] < NONE]
        return ids[:, :size], live

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, laid end to end, and the count of each."""
        out: list = [None] * len(pieces)
        by: dict[int, list[int]] = {}
        get = self.rank.get
        for i, x in enumerate(pieces):
            if (r := get(x)) is not None:
                out[i] = (r,)
            elif len(x) <= SHORT:
                by.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
            else:
                out[i] = self.long(x)
        for size, own in by.items():
            ids, live = self.lockstep([pieces[i] for i in own], size)
            flat, cut = ids[live].tolist(), np.cumsum(live.sum(1)).tolist()
            a = 0
            for i, b in zip(own, cut, strict=True):
                out[i] = flat[a:b]
                a = b
        counts = np.array([len(x) for x in out], np.int64)
        return np.array([t for x in out for t in x], np.int64), counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids laid end to end."""
        ids = ids.astype(np.int64)
        n = self.at[ids + 1] - self.at[ids]
        end = np.cumsum(n)
        return self.bytes[np.repeat(self.at[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]


@lru_cache(2)
def _ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks(f.read())


@lru_cache(2)
def encoder(path: str, pattern: str) -> tuple[Ranks, Encoder]:
    """Once per Python worker."""
    ranks, split = _ranks(path), regex.compile(pattern)
    return ranks, Encoder(ranks.encode, lambda text: ranks.encode([x.encode() for x in split.findall(text)])[0].tolist() if text else [])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: id, ids (the tokens of its whole text) and decoded (the bytes of those ids).
    ranks: a rank file that every executor has (part of an installed package)."""
    R.short_batches(docs.sparkSession)
    path, pat = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def f(batches):
        rank, enc = encoder(path, pat)
        for batch in batches:
            buf, at = vec.text_buffer(batch["text"])
            for i, j in vec.blocks(buf, at, 1 << 18):
                ids, counts = enc.encode(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                upto = np.concatenate(([0], np.cumsum(counts)))
                raw = rank.decode(ids)
                ends = np.concatenate(([0], np.cumsum(rank.at[ids.astype(np.int64) + 1] - rank.at[ids])))[upto]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32))), R.strings(raw, ends).cast(pa.binary())], ["id", "ids", "decoded"])
        R.trim()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(f, "id long, ids array<int>, decoded binary")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
