"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts in a document with a
smaller id. Every such string has an anchor: the position in it whose `ANCHOR`-byte hash is
least. Successive strings of a document that share an anchor form a run; strings that are
equal lie in runs with equal anchors, so all comparing happens among the runs of one anchor:

1. Each chunk of documents sends one entry per distinct run (anchor, digest, smallest id).
   Ranges of anchors answer whether a smaller id holds the same run (then the whole run goes
   elsewhere than in its first document), and whether the anchor has another distinct run that
   may share a string: each string reaches half of its other bytes or more to one side of its
   anchor, so runs that share one agree in a hash of that side (16 bits more a side).
2. Only such runs send text, once for each distinct run, from its first document: each chunk
   builds the Burrows-Wheeler transform of its own runs (a shard), and the range of anchors
   merges the shards. The interleave starts with the rows placed by eight symbols, read through
   the last-to-first mapping of their own shard; each round doubles the symbols by which rows
   are placed, up to `length`, as a row's place and that of the row so many symbols on give
   its new place. Rows in one interval at last repeat each other; no suffixes are compared or
   sorted again. Rows are named by walking each shard backwards from its sentinels.
3. The chunk that holds the text joins the answers and cuts.

Copies cost one entry per chunk, so groups of any size stay small. The text is shuffled
once, entries are sixteen bytes for about thirteen bytes of text, and only a few hundredths
of the text goes to step 2. Runs count as equal if their anchors' and their own hashes agree
(64 bits and the bits that the range fixes).

Defined cases: a null or empty text has no bytes and keeps none; shorter texts than `length`
keep everything; rows with one id don't remove from each other; a null id counts as larger
than all others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from . import vec

#: Bytes of an anchor: long enough to be rare by chance, short enough that runs hold many strings.
ANCHOR = 24
#: A text longer than this is anchored in pieces.
PIECE = 1 << 19
#: Strings whose anchors are looked for together.
STRIP = 1 << 14
LAST = np.int64(2**63 - 1)

OUT = "id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
ENTRY = "part int, chunk int, base long, a binary, s binary, ids binary, left binary, right binary"
SHARD = "part int, chunk int, less binary, entry binary, ids binary, bwt binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w successive values."""
    have = 1
    while have < w:
        s = min(have, w - have)
        x = np.minimum(x[:-s], x[s:])
        have += s
    return x


def anchors(words: tuple[np.ndarray, ...]) -> np.ndarray:
    """Hashes of strings of ANCHOR bytes, given as three numbers of eight bytes."""
    first, *rest = words
    with np.errstate(over="ignore"):
        h = first * np.uint64(0x9E3779B97F4A7C15)
        for x, odd in zip(rest, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), strict=True):
            h ^= h >> np.uint64(32)
            h += x
            h *= np.uint64(odd)
    h ^= h >> np.uint64(32)
    return h


def positions(w: np.ndarray, n: int, length: int) -> np.ndarray:
    """Where the least anchor hash of each of n strings is, the first of equal ones. w: the bytes' `eights`.
    Strings are taken in strips that fit in a processor's cache."""
    out, wide = np.empty(n, np.int32), length - ANCHOR + 1
    for a in range(0, n, STRIP):
        b = min(n, a + STRIP)
        m = b - a + wide - 1
        key = anchors(tuple(w[a + k : a + k + m] for k in (0, 8, 16)))
        key &= ~np.uint64(0xFFFFF)
        key |= np.arange(m, dtype=np.uint64)
        out[a:b] = (sliding_min(key, wide) & np.uint64(0xFFFFF)).astype(np.int32) + a
    return out


def runs(b: np.ndarray, a: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of a block: first string, end of strings, anchor, digest and the anchor's place. Strings are named by their start."""
    if len(b) > PIECE + length:
        found = []
        for t in range(0, len(b), PIECE):
            u = min(len(b), t + PIECE + length - 1)
            s, e, *h, p = runs(b[t:u], np.array([0, u - t]), length)
            found.append((s + t, e + t, *h, p + t))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    if len(b) < length:
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return z, z, h, h, z
    w, n = vec.eights(b), len(b) - length + 1
    pos = positions(w, n, length)
    ok = np.zeros(n + 1, np.int32)
    whole = np.flatnonzero(np.diff(a) >= length)
    np.add.at(ok, a[whole], 1)
    np.add.at(ok, a[whole + 1] - length + 1, -1)
    ok = np.cumsum(ok[:-1]) > 0
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (pos[1:] != pos[:-1]) | (ok[1:] != ok[:-1])
    edge[a[(a > 0) & (a < n)]] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    start, end = start[ok[cut[:-1]]], end[ok[cut[:-1]]]
    with np.errstate(over="ignore"):
        anchor = vec.mix(anchors(tuple(w[pos[start] + k] for k in (0, 8, 16))) * np.uint64(0xD1342543DE82EF95))
    return start, end, anchor, vec.slices_hash(b, start, end + length - 1), pos[start].astype(np.int64)


class Chunk:
    """The runs of a chunk and its entries: distinct runs in the order of (part, anchor, digest)."""

    def __init__(self, table: pa.Table, length: int, parts: int):
        self.table, self.length = R.in_order(table), length
        self.ids = self.table["id"].fill_null(int(LAST)).to_numpy()
        self.buf, self.at = vec.text_buffer(self.table["text"])
        found = []
        for i, j in vec.blocks(self.buf, self.at, 1 << 19):
            s, e, *h, p = runs(self.buf[self.at[i] : self.at[j]], self.at[i : j + 1] - self.at[i], length)
            found.append((s + self.at[i], e + self.at[i], *h, p + self.at[i]))
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.start, self.end, anchor, digest, self.pos = (np.concatenate(x) for x in zip((z, z, h, h, z), *found, strict=True))
        self.owner = self.ids[np.searchsorted(self.at, self.start, "right") - 1]
        part = ((anchor >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        key = (anchor << np.uint64(32)) | (digest & np.uint64(0xFFFFFFFF))
        o = np.lexsort((self.owner, key, part))
        part, key = part[o], key[o]
        new = np.ones(len(o), bool)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        head = np.flatnonzero(new)
        self.entry = np.empty(len(o), np.int64)
        self.entry[o] = np.cumsum(new) - 1
        self.first, self.part, self.key = o[head], part[head].astype(np.int64), key[head]
        self.least = self.owner[self.first]
        self.cut = np.searchsorted(self.part, np.arange(parts + 1))

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Of all entries: hashes of what stands left and right of the anchor, from 1; 0 where no string reaches
        so far. Each string reaches far enough on one side, so runs that share a string share a side's hash."""
        s, e, p = self.start[self.first], self.end[self.first], self.pos[self.first]
        near = (self.length - ANCHOR) // 2
        far = self.length - ANCHOR - near + 1
        out = []
        for on, a, b in ((p - s >= near, p - near, p), (p - e + 1 < near, p + ANCHOR, p + ANCHOR + far)):
            h = np.zeros(len(p), np.uint16)
            h[on] = vec.slices_hash(self.buf, a[on], b[on]) % np.uint64(0xFFFF) + np.uint64(1)
            out.append(h)
        return out[0], out[1]

    def answered(self, table: pa.Table, column: str) -> np.ndarray:
        """A flag of all entries, from the answers of the ranges."""
        out = np.zeros(len(self.first), bool)
        for p, x in zip(table["part"].to_pylist(), table[column].to_pylist(), strict=True):
            s, e = self.cut[p], self.cut[p + 1]
            out[s:e] = R.unbits(x, e - s)
        return out


def _entries(length: int, parts: int):
    def f(table: pa.Table) -> pa.Table:
        R.trim()
        c = Chunk(table, length, parts)
        base = int(c.least.min()) if len(c.least) else 0
        with np.errstate(over="ignore"):
            far = c.least.astype(np.uint64) - np.uint64(base % (1 << 64))
        far = far.astype(np.uint32) if not len(far) or far.max() < 1 << 32 else far
        own = np.flatnonzero(np.diff(c.cut)).tolist()
        s = [(c.cut[p], c.cut[p + 1]) for p in own]
        a, d = (c.key >> np.uint64(32)).astype(np.uint32), c.key.astype(np.uint32)
        return pa.table([pa.array(own, pa.int32()), pa.array([table["chunk"][0].as_py()] * len(own), pa.int32()), pa.array([base] * len(own), pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in s], pa.binary()) for x in (a, d, far, *c.sides()))], ["part", "chunk", "base", "a", "s", "ids", "left", "right"])

    return f


def _resolve(table: pa.Table) -> pa.Table:
    """Entries of one range of anchors: who comes first, and which runs may share a string with another one
    of their anchor, as what stands left or right of it agrees."""
    R.trim()
    a = [np.frombuffer(x, np.uint32) for x in table["a"].to_pylist()]
    n = [len(x) for x in a]
    key = np.concatenate(a).astype(np.uint64) << np.uint64(32) | np.concatenate([np.frombuffer(x, np.uint32) for x in table["s"].to_pylist()])
    with np.errstate(over="ignore"):
        ids = np.concatenate([(np.frombuffer(x, np.uint32 if len(x) == 4 * k else np.uint64).astype(np.uint64) + np.uint64(b % (1 << 64))).astype(np.int64) for x, k, b in zip(table["ids"].to_pylist(), n, table["base"].to_pylist(), strict=True)])
    o = np.argsort(key)
    k = key[o]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    which = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[o], np.flatnonzero(new))
    up = k[new] >> np.uint64(32)
    same = up[1:] == up[:-1]
    own = np.zeros(len(up), bool)
    own[1:] |= same
    own[:-1] |= same
    own = np.flatnonzero(own)
    several = np.zeros(len(up), bool)
    for side in ("left", "right"):
        h = np.concatenate([np.frombuffer(x, np.uint16) for x in table[side].to_pylist()])[o[new][own]]
        runs_of = own[h > 0]
        at = up[runs_of] << np.uint64(16) | h[h > 0]
        at, runs_of = at[s := np.argsort(at)], runs_of[s]
        same = at[1:] == at[:-1]
        several[runs_of[1:][same]] = True
        several[runs_of[:-1][same]] = True
    less, send = np.empty(len(k), bool), np.empty(len(k), bool)
    less[o] = ids[o] > least[which]
    send[o] = several[which]
    send &= ~less
    at = np.concatenate(([0], np.cumsum(n))).tolist()
    return pa.table([table["part"], table["chunk"], *(pa.array([R.bits(x[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x in (less, send))], ["part", "chunk", "less", "send"])


def transform(strings: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transforms of strings that are sorted by (group, bytes), all groups in one pass:
    symbols (byte + 1, 0 at a string's start) in the order of (group, suffix), and each row's group."""
    n = np.array([len(s) + 1 for s in strings])
    end = np.cumsum(n)
    x = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint64) + np.uint64(1)
    x[end - 1] = 0
    rem = np.repeat(end - 1, n) - np.arange(len(x))  # bytes to the string's end
    pad = np.concatenate((x, np.zeros(8, np.uint64)))
    w = np.zeros(len(x), np.uint64)
    for i in range(8):
        w |= np.where(rem > i, pad[i : i + len(x)], np.uint64(0)) << np.uint64(56 - 8 * i)
    group = np.repeat(groups, n)
    order = np.lexsort((w, group))
    new = np.ones(len(x), bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (group[order][1:] != group[order][:-1])
    rank, step = np.cumsum(new) - 1, 8
    while True:
        tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
        tied = tied[rem[order[tied]] >= step]  # rows of one rank have more bytes all, or none
        if not tied.size:
            break
        p = order[tied]
        nxt = np.where(rem[p] > step, w[np.minimum(p + step, len(w) - 1)], np.uint64(0))
        o = np.lexsort((nxt, rank[tied]))
        order[tied], v, r = p[o], nxt[o], rank[tied]
        new[tied[1:]] |= (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        rank, step = np.cumsum(new) - 1, step + 8
    before = np.concatenate(([np.uint64(0)], x[:-1])).astype(np.uint8)
    before[end - n] = 0
    return before[order], group[order]


def mapping(bwts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' symbols (rows are numbered shard after shard), and the last-to-first mapping within shards."""
    bwt, at = np.concatenate(bwts), 0
    first = np.empty(len(bwt), np.int32)
    for x in bwts:
        first[at + np.argsort(x, kind="stable")] = np.arange(at, at + len(x), dtype=np.int32)
        at += len(x)
    return bwt, first


def merge(bwt: np.ndarray, first: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave refinement of shard transforms: the rows of which `length` symbols or more are left
    (left: how many each row has), in the merged order, and the interval of each: rows whose first `length`
    symbols are the same. Only the transforms' mappings are read. A round places the rows by twice the
    symbols of the round before: by their interval, then by that of the row so many symbols on."""
    on = np.empty_like(first)  # one symbol on, then 2, 4 and so forth
    on[first] = np.arange(len(first), dtype=np.int32)
    symbols = np.empty(len(bwt), np.uint64)
    symbols[first] = bwt
    jumps, known = [on], 1
    while known < 8:
        symbols = symbols << np.uint64(8 * known) | symbols[jumps[-1]]
        jumps.append(jumps[-1][jumps[-1]])
        known *= 2
    rows = np.flatnonzero(left >= known)
    key = symbols[rows]
    while True:
        o = np.argsort(key)
        key, rows = key[o], rows[o]
        interval = np.zeros(len(rows), np.int32)
        interval[1:] = np.cumsum(key[1:] != key[:-1])
        if known >= length:
            return rows, interval
        place = np.zeros(len(bwt), np.int32)
        place[rows] = interval
        step = min(known, length - known)
        known += step
        rows = np.flatnonzero(left >= known)
        far = rows
        for k, jump in enumerate(jumps):
            if step >> k & 1:
                far = jump[far]
        key = place[rows].astype(np.uint64) << np.uint64(32) | place[far].astype(np.uint64)
        if 2 * known < length:
            jumps.append(jumps[-1][jumps[-1]])


def repeated(shards: list[tuple[np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """Of shards (transform, id of each string): for each string the strings of `length` bytes in it,
    as bits from its start, that also occur in a string with a smaller id."""
    bwts = [x for x, _ in shards]
    if not sum(map(len, bwts)):
        return [np.zeros(0, np.uint64) for _ in shards]
    bwt, first = mapping(bwts)
    ids = np.concatenate([y for _, y in shards])
    base = np.concatenate(([0], np.cumsum([len(x) for x in bwts])))[:-1]
    count = [len(y) for _, y in shards]
    own, left = np.empty(len(bwt), np.int32), np.empty(len(bwt), np.int32)
    # a shard's first rows are its strings' sentinels, in the order of the strings
    row, string, t = np.concatenate([b + np.arange(k) for b, k in zip(base, count, strict=True)]), np.arange(len(ids)), 0
    size = np.zeros(len(ids), np.int32)
    while row.size:
        own[row], left[row] = string, t
        on = bwt[row] != 0
        size[string[~on]] = t
        row, string, t = first[row[on]], string[on], t + 1
    rows, interval = merge(bwt, first, left, length)
    bits = np.zeros(len(ids), np.uint64)
    if rows.size:
        new = np.ones(len(rows), bool)
        new[1:] = interval[1:] != interval[:-1]
        who = ids[own[rows]]
        hit = rows[who > np.minimum.reduceat(who, np.flatnonzero(new))[np.cumsum(new) - 1]]
        np.bitwise_or.at(bits, own[hit], np.uint64(1) << (size[own[hit]] - left[hit]).astype(np.uint64))
    return np.split(bits, np.cumsum(count)[:-1])


def _shards(length: int, parts: int):
    def f(table: pa.Table, answers: pa.Table) -> pa.Table:
        R.trim()
        c = Chunk(table, length, parts)
        e = np.flatnonzero(c.answered(answers, "send"))
        raw = c.buf.tobytes()
        text = [raw[a:b] for a, b in zip(c.start[c.first[e]].tolist(), (c.end[c.first[e]] + length - 1).tolist(), strict=True)]
        part = c.part[e].tolist()
        o = sorted(range(len(e)), key=lambda i: (part[i], text[i]))
        e, text = e[o], [text[i] for i in o]
        group = c.part[e]
        own = answers["part"].to_pylist()
        bwt, rows = transform(text, group) if text else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
        out = []
        for p in own:
            s, t = np.searchsorted(group, [p, p + 1])
            u, v = np.searchsorted(rows, [p, p + 1])
            out.append(((e[s:t] - c.cut[p]).astype(np.uint32).tobytes(), c.least[e[s:t]].tobytes(), bwt[u:v].tobytes()))
        x, y, z = zip(*out, strict=True) if out else ((), (), ())
        # what the first answer said goes along, so that the last step reads one answer
        return pa.table([answers["part"], answers["chunk"], answers["less"], *(pa.array(k, pa.binary()) for k in (x, y, z))], ["part", "chunk", "less", "entry", "ids", "bwt"])

    return f


def _merge(length: int):
    def f(table: pa.Table) -> pa.Table:
        R.trim()
        table = table.sort_by("chunk")
        shards = [(np.frombuffer(x, np.uint8), np.frombuffer(y, np.int64)) for x, y in zip(table["bwt"].to_pylist(), table["ids"].to_pylist(), strict=True)]
        return pa.table([table["part"], table["chunk"], table["less"], table["entry"], pa.array([x.tobytes() for x in repeated(shards, length)], pa.binary())], ["part", "chunk", "less", "entry", "gone"])

    return f


def _cut(length: int, parts: int, characters: bool):
    def f(table: pa.Table, answers: pa.Table) -> pa.Table:
        R.trim()
        c = Chunk(table, length, parts)
        less = c.answered(answers, "less")
        some = np.zeros(len(c.first), np.uint64)
        for p, x, y in zip(*(answers[k].to_pylist() for k in ("part", "entry", "gone")), strict=True):
            if x:
                some[c.cut[p] + np.frombuffer(x, np.uint32)] = np.frombuffer(y, np.uint64)
        whole = less[c.entry] | (c.owner > c.least[c.entry])
        rest = np.flatnonzero(~whole & (some[c.entry] != 0))
        bits = np.unpackbits(some[c.entry[rest]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
        r, k = np.nonzero(bits)
        single = c.start[rest][r] + k
        gone = vec.mask_of(np.concatenate((c.start[whole], single)), np.concatenate((c.end[whole] - 1, single)) + length, len(c.buf))
        if characters and len(gone):
            char = np.cumsum((c.buf & 0xC0) != 0x80)
            gone = (np.bincount(char, weights=gone) > 0)[char]
        upto = np.concatenate(([0], np.cumsum(gone)))[c.at]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        edge[c.at[:-1][c.at[:-1] < len(gone)]] |= gone[c.at[:-1][c.at[:-1] < len(gone)]]
        s = np.flatnonzero(edge)
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        stop = c.at[1:][c.at[1:] > 0] - 1
        last[stop] |= gone[stop]
        e = np.flatnonzero(last) + 1
        doc = np.searchsorted(c.at, s, "right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(s, c.at), pa.int32()), pa.StructArray.from_arrays([pa.array(s - c.at[doc], pa.int32()), pa.array(e - c.at[doc], pa.int32())], ["start", "end"]))
        return pa.table({"id": c.table["id"], "n_bytes": pa.array(np.diff(c.at)), "n_removed": pa.array(np.diff(upto), pa.int64()), "spans": spans, "kept": R.strings(c.buf[~gone], c.at - upto).cast(pa.binary())} | ({"carry": c.table["carry"]} if "carry" in c.table.column_names else {}))

    return f


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, carry: list[str] | None = None, characters: bool = False, chunk_bytes: int = 2 * R.MB, part_bytes: int = 6 * R.MB) -> DataFrame:
    """Per document: id, n_bytes, n_removed, spans (byte intervals removed, end exclusive), kept (the
    remaining bytes) and, if columns are to be carried along, carry (a struct of them). characters: a character of which some bytes go goes whole, so kept is UTF-8. length: from ANCHOR + 1 to ANCHOR + 63. chunk_bytes and part_bytes are input
    bytes for one chunk of text and one range of anchors; they bound a task's memory."""
    if not ANCHOR < length < ANCHOR + 64:
        raise ValueError(f"length must be from {ANCHOR + 1} to {ANCHOR + 63}")
    chunks, parts = R.parts_for(docs, chunk_bytes, 48), R.parts_for(docs, part_bytes, 24)
    c = R.chunked(docs, id_col, text_col, chunks, carry)
    out = OUT + f", carry {c.schema['carry'].dataType.simpleString()}" if carry else OUT
    answers = c.groupBy("chunk").applyInArrow(_entries(length, parts), ENTRY).groupBy("part").applyInArrow(_resolve, "part int, chunk int, less binary, send binary")
    shards = c.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_shards(length, parts), SHARD)
    merged = shards.groupBy("part").applyInArrow(_merge(length), "part int, chunk int, less binary, entry binary, gone binary")
    return c.groupBy("chunk").cogroup(merged.groupBy("chunk")).applyInArrow(_cut(length, parts, characters), out)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = """
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
r AS (SELECT rid, doc_id, h, (length(h) // 2)::BIGINT AS n FROM t),
i AS (SELECT rid, doc_id, h, unnest(range(0, n - 49)) AS p FROM r WHERE n >= 50),
s AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM i),
f AS (SELECT rid, p FROM (SELECT rid, p, doc_id, min(doc_id) OVER (PARTITION BY w) AS first_id FROM s) WHERE doc_id > first_id),
-- hits whose strings touch or overlap form one removed run
g AS (SELECT rid, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS k FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS before FROM f)),
x AS (SELECT rid, k, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY rid, k),
y AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM x GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN y.rid IS NULL THEN h ELSE array_to_string([substr(h, 2 * q[1] + 1, 2 * (q[2] - q[1])) FOR q IN list_zip(list_prepend(0::BIGINT, ends), list_append(starts, n))], '') END)) AS kept_sha256
FROM r LEFT JOIN y USING (rid)
"""
