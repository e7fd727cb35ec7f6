"""Exact substring dedup over word windows (Rabin-Karp).

Every window of `window` consecutive words of every document gets two Rabin-Karp hashes:
polynomials over word hashes modulo the prime 2**61 - 1 with independent bases, the windows'
lengths doubled until they reach `window`. Hashes are counted in Spark: each chunk of documents
sends every window it holds once, as packed arrays; the second hash deals them to ranges, the
first is what is compared there, so a window that fills a third of the corpus costs one entry
per chunk; the ranges find windows that two chunks hold and answer with one bit per entry.
Repeated windows then merge into maximal removal intervals in the chunk that holds the text.

The text is shuffled once (both uses of the chunks read the same exchange); a window costs
eight bytes of shuffle. Two windows count as equal if the 61 bits and their ranges are equal:
ranges grow with the input, so among n windows a chance pair has odds of n**2 / 2**62 over the
number of ranges (6 in 10**8 for 10 GB, and under one for 100 TB at 6 MB a range). Within a
chunk both hashes are compared.

Defined cases: a null or empty text has no words and nothing is removed; texts shorter than
the window keep everything; rows repeated with the same id are documents of their own; null
ids stay null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from . import vec

OUT = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"


PRIME = (1 << 61) - 1
BASES = 0x0B5297A4D3B6F2C1, 0x1A85EC53DA3E4F29
#: Words whose polynomials are made together: what fits in a processor's cache.
STRIP = 8192
_P, _HALF, _30, _31 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64(30), np.uint64(31)


def times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo PRIME (below 2**61 + 8); x below 2**61 + 8."""
    c1, c0 = np.uint64(c >> 31), np.uint64(c & 0x7FFFFFFF)
    x1, x0 = x >> _31, x & _HALF
    mid = x1 * c0 + x0 * c1
    out = (x1 * c1 << np.uint64(1)) + (mid >> _30) + ((mid & np.uint64(0x3FFFFFFF)) << _31)
    out = (out & _P) + (out >> np.uint64(61))
    x0 *= c0
    out += (x0 & _P) + (x0 >> np.uint64(61))
    return (out & _P) + (out >> np.uint64(61))


def rolling(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Polynomials of base modulo PRIME of all runs of `window` successive words (hashes)."""
    if len(words) > STRIP + window:
        return np.concatenate([rolling(words[k : k + STRIP + window - 1], window, base) for k in range(0, len(words) - window + 1, STRIP)])
    one = (words & _P) + (words >> np.uint64(61))
    out, have = one, 1
    for bit in bin(window)[3:]:
        out = times(out[:-have] if have < len(out) else out[:0], pow(base, have, PRIME)) + out[have:]
        out, have = (out & _P) + (out >> np.uint64(61)), 2 * have
        if bit == "1":
            n = max(0, len(out) - 1)
            out = times(out[:n], base) + one[have : have + n]
            out, have = (out & _P) + (out >> np.uint64(61)), have + 1
    return np.where(out >= _P, out - _P, out)


def window_hashes(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start words of all windows that lie in one document, and both their hashes."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    room = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(n) + window <= room)
    return starts, *(rolling(words, window, b)[starts] for b in BASES)


def _hashed(table: pa.Table, window: int):
    """Per block of a chunk: buffer, offsets, word spans, first words, window starts and hashes."""
    buf, at = vec.text_buffer(table["text"])
    for i, j in vec.blocks(buf, at):
        b, a = buf[at[i] : at[j]], at[i : j + 1] - at[i]
        s, e, first = vec.word_spans(b, a)
        yield i, b, a, s, e, first, *window_hashes(vec.slices_hash(b, s, e), first, window)


class Windows:
    """The distinct windows of a chunk in the order of (range, hash)."""

    def __init__(self, seen: list, parts: int):
        h, g = (np.concatenate([np.zeros(0, np.uint64), *(x[k] for x in seen)]) for k in (-2, -1))
        part = vec.mix(g) >> np.uint64(32)
        part = (part * np.uint64(parts)) >> np.uint64(32)
        o = np.lexsort((g, h, part))
        new = np.ones(len(o), bool)
        new[1:] = (h[o][1:] != h[o][:-1]) | (g[o][1:] != g[o][:-1])
        head = np.flatnonzero(new)
        self.hashes, self.several = h[o[head]], np.diff(np.append(head, len(o))) > 1
        #: The distinct window of each window.
        self.which = np.empty(len(o), np.int64)
        self.which[o] = np.cumsum(new) - 1
        self.at = np.searchsorted(part[o[head]], np.arange(parts + 1).astype(np.uint64))


def _send(window: int, parts: int):
    def f(table: pa.Table) -> pa.Table:
        R.trim()
        chunk = table["chunk"][0].as_py()
        w = Windows([x[-2:] for x in _hashed(R.in_order(table), window)], parts)
        own = np.flatnonzero(np.diff(w.at))
        return pa.table({"part": pa.array(own, pa.int32()), "chunk": pa.array(np.full(len(own), chunk), pa.int32()), "hashes": pa.array([w.hashes[w.at[p] : w.at[p + 1]].tobytes() for p in own], pa.binary())})

    return f


def _count(table: pa.Table) -> pa.Table:
    """Of the hashes of one range: which are held by two chunks or more."""
    R.trim()
    blobs = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    every = np.sort(np.concatenate(blobs))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    flags = []
    for x in blobs:
        k = np.searchsorted(again, x)
        k[k == len(again)] = 0
        flags.append(R.bits(again[k] == x) if len(again) else b"")
    return pa.table({"part": table["part"], "chunk": table["chunk"], "flags": pa.array(flags, pa.binary())})


def _cut(window: int, parts: int):
    def f(table: pa.Table, answers: pa.Table) -> pa.Table:
        R.trim()
        table = R.in_order(table)
        seen = list(_hashed(table, window))
        w = Windows(seen, parts)
        bad = w.several
        for p, flags in zip(answers["part"].to_pylist(), answers["flags"].to_pylist(), strict=True):
            if flags:
                bad[w.at[p] : w.at[p + 1]] |= R.unbits(flags, w.at[p + 1] - w.at[p])
        bad, upto = bad[w.which], 0
        n_words, n_removed, span_at, spans, kept, sizes = [], [], [0], [], [], []
        for _, b, a, s, e, first, starts, _, _ in seen:
            hit = starts[bad[upto : upto + len(starts)]]
            upto += len(starts)
            gone = vec.mask_of(hit, hit + window, len(s))
            # kept words joined by one space: each keeps its bytes and, unless it is the document's first kept word, a space before
            doc = np.repeat(np.arange(len(a) - 1), np.diff(first))
            ks, ke, kd = s[~gone], e[~gone], doc[~gone]
            lead = np.ones(len(ks), np.int64)
            lead[np.flatnonzero(np.diff(kd, prepend=-1))] = 0
            n = ke - ks + lead
            end = np.cumsum(n)
            out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
            src = np.repeat(ks - (end - n) - lead, n) + np.arange(len(out))
            body = np.ones(len(out), bool)
            body[(end - n)[lead == 1]] = False
            out[body] = b[src[body]]
            kept.append(out)
            per = np.bincount(kd, weights=n, minlength=len(a) - 1).astype(np.int64)
            sizes.append(per)
            n_words.append(np.diff(first))
            n_removed.append(np.bincount(doc[gone], minlength=len(a) - 1))
            edge = np.zeros(len(s) + 1, bool)
            edge[first] = True
            # maximal runs that don't cross documents
            g = np.flatnonzero(gone)
            new = np.concatenate(([True], (g[1:] != g[:-1] + 1) | edge[g[1:]])) if len(g) else np.zeros(0, bool)
            rs = g[new]
            re_ = g[np.concatenate((new[1:], [True]))] + 1 if len(g) else rs
            rd = doc[rs]
            spans.append((rs - first[rd], re_ - first[rd]))
            span_at.extend((span_at[-1] + np.cumsum(np.bincount(rd, minlength=len(a) - 1))).tolist())
        cat = lambda x, t=np.int64: np.concatenate([np.zeros(0, t), *x])
        ss, se = cat([x[0] for x in spans]), cat([x[1] for x in spans])
        return pa.table(
            {
                "id": table["id"],
                "n_words": pa.array(cat(n_words), pa.int64()),
                "n_removed": pa.array(cat(n_removed), pa.int64()),
                "spans": pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(ss, pa.int32()), pa.array(se, pa.int32())], ["start", "end"])),
                "kept": R.strings(cat(kept, np.uint8), np.concatenate(([0], np.cumsum(cat(sizes))))).cast(pa.binary()),
            }
        )

    return f


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = 2 * R.MB, part_bytes: int = 6 * R.MB) -> DataFrame:
    """Per document: id, n_words, n_removed, spans (word intervals removed, end exclusive) and kept
    (UTF-8 bytes of the kept words joined by one space). chunk_bytes and part_bytes are input bytes
    for one chunk of text and one hash range; they bound a task's memory."""
    chunks, parts = R.parts_for(docs, chunk_bytes, 48), R.parts_for(docs, part_bytes, 24)
    c = R.chunked(docs, id_col, text_col, chunks)
    sent = c.groupBy("chunk").applyInArrow(_send(window, parts), "part int, chunk int, hashes binary")
    flags = sent.groupBy("part").applyInArrow(_count, "part int, chunk int, flags binary")
    return c.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_cut(window, parts), OUT)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
r AS (SELECT row_number() OVER () AS rid, doc_id, w, len(w)::BIGINT AS n FROM t),
i AS (SELECT rid, w, unnest(range(1, n - 33)) AS p FROM r WHERE n >= 35),
h AS (SELECT rid, p, array_to_string(w[p:p + 34], ' ') AS s FROM i),
d AS (SELECT rid, p, count(*) OVER (PARTITION BY s) AS c FROM h),
g AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS q FROM d WHERE c > 1),
x AS (SELECT rid, list(q) AS qs FROM g GROUP BY rid)
SELECT doc_id, n AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE [w[k] FOR k IN range(1, n + 1) IF NOT list_contains(qs, k)] END, ' ')) AS kept_sha256
FROM r LEFT JOIN x USING (rid)
"""
