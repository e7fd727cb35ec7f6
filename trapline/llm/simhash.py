"""SimHash near-dedup with a byte-position inverted index and count filtering.

Every document gets a 64-bit fingerprint: bit k is set if it is set in over half of the
XXH64 hashes of its word shingles, repeats included. Two fingerprints that differ in at most
d bits differ in at most d of their eight bytes, so at least 8 - d positional bytes agree:
the guaranteed minimum of the count filter. The inverted index holds distinct fingerprints
only. Its postings are kept by half of the guaranteed positions at once (a third or half of
the bytes, see `keys`): every pair that reaches the minimum meets in a list, and lists are
short where single bytes would give n / 256 members each. In a list the shared positional bytes
of every pair are tallied, pairs below the minimum are dropped and the others verified by their
Hamming distance. Lists of more than `LIST` members aren't tallied as they are: their postings
are dealt again by all guaranteed positions, where every pair has the minimum and a list has at
most 256**d distinct members however large a group of copies is (65,536 for d = 2); long ones
are looked up by flipped bits. Only a spanning forest of a list's links leaves it.

Defined cases: a null or empty text has fingerprint zero and links like any other; texts with
fewer words than a shingle hash their whole word sequence; rows repeated with one id are rows
of the result; null ids stay null and are never a component's id unless it has no other; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from . import vec
from .components import components, local_roots


def joined_words(buf: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces: bytes, starts, ends, and first word of each text."""
    s, e, first = vec.word_spans(buf, at)
    n = e - s + 1
    end = np.cumsum(n)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
    body = np.ones(len(out), bool)
    body[end - 1] = False
    out[body] = vec.lower(buf)[(np.repeat(s - (end - n), n) + np.arange(len(out)))[body]]
    return out.tobytes(), end - n, end - 1, first


def fingerprints_of(buf: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Fingerprints of all texts."""
    raw, s, e, first = joined_words(buf, at)
    count = np.diff(first)
    shingles = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    doc = np.repeat(np.arange(len(count)), shingles)
    own = np.cumsum(shingles)
    k = np.arange(len(doc)) - (own - shingles)[doc] + first[doc]
    last = np.minimum(k + words, first[doc + 1]) - 1
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(raw[a:b], 42) for a, b in zip(s[k].tolist(), e[last].tolist(), strict=True)), np.uint64, len(doc))
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        ones = np.add.reduceat(np.unpackbits(h[:, None].view(np.uint8), axis=1, bitorder="little"), (own - shingles)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > shingles[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id long, th long, fp long): one row per document; th is a hash of its text."""

    def f(batches):
        for batch in batches:
            buf, at = vec.text_buffer(batch["text"])
            for i, j in vec.blocks(buf, at, 1 << 18):
                fp = fingerprints_of(buf[at[i] : at[j]], at[i : j + 1] - at[i], words)
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), batch["th"].slice(i, j - i), pa.array(fp.view(np.int64))], ["id", "th", "fp"])
        R.trim()

    R.short_batches(docs.sparkSession)
    t = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(t).alias("th"), t.alias("text")).mapInArrow(f, "id long, th long, fp long")


def flips(bits: int, distance: int) -> np.ndarray:
    """Masks of 1 to `distance` of the low bits."""
    return np.array([sum(1 << b for b in c) for d in range(1, distance + 1) for c in combinations(range(bits), d)], np.uint64)


def list_links(members: np.ndarray, distance: int, free: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of one posting list. free: the bit positions in which its members can
    differ, if they are few enough to be flipped."""
    m = np.unique(members)
    if free is None or len(m) <= 64:
        a, b = tallied(m, distance)
    else:
        spread = sum(((np.uint64(1) << np.uint64(p)) * ((flips(len(free), distance) >> np.uint64(k)) & np.uint64(1)) for k, p in enumerate(free)), np.uint64(0))
        a, b = [], []
        for mask in spread:
            at = np.searchsorted(m, m ^ mask)
            at[at == len(m)] = 0
            hit = np.flatnonzero((m[at] == m ^ mask) & (np.arange(len(m)) < at))
            a.append(hit)
            b.append(at[hit])
        a, b = np.concatenate(a), np.concatenate(b)
    root = local_roots(len(m), a, b)
    own = np.flatnonzero(root != np.arange(len(m)))
    return m[root[own]], m[own]


#: Members of a list whose pairs are all tallied.
LIST = 256


def keys(distance: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """Positions of the postings' keys, first and second: one of the first is shared by every pair that
    differs in at most `distance` bytes, and so is one of the second, which are all choices of 8 - distance.
    The first are unions of groups of positions: distance + 2 groups, two of which have no difference."""
    groups = [tuple(p for p in range(8) if p * (distance + 2) // 8 == g) for g in range(distance + 2)]
    return [tuple(sorted(a + b)) for a, b in combinations(groups, 2)], list(combinations(range(8), 8 - distance))


def tallied(members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a list that share enough positional bytes and then differ in few enough bits."""
    a, b = np.triu_indices(len(members), 1)
    x = members[a] ^ members[b]
    shared = (x[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(1)
    some = shared >= 8 - distance
    a, b, x = a[some], b[some], x[some]
    ok = np.bitwise_count(x) <= distance
    return a[ok], b[ok]


def _post(fps: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    masks = [sum(0xFF << 8 * p for p in c) for c in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("p")).select("fp", "p.choice", "p.key")


def links(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect what links of at most `distance` bits connect. fps: distinct fingerprints (fp)."""
    short, whole = keys(distance)
    free = [np.array([8 * p + k for p in range(8) if p not in c for k in range(8)]) for c in whole]

    def link(second: bool):
        def f(batches):
            for batch in batches:
                lists = batch["members"]
                at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
                size, which = np.diff(at), batch["choice"].to_numpy()
                two = size == 2
                x, y = flat[at[:-1][two]], flat[at[:-1][two] + 1]
                shared = ((x ^ y)[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(1)
                ok = (shared >= 8 - distance) & (np.bitwise_count(x ^ y) <= distance)
                a, b = [x[ok]], [y[ok]]
                for k in np.flatnonzero(size > 2):
                    p, q = list_links(flat[at[k] : at[k + 1]], distance, free[which[k]] if second else None)
                    a.append(p)
                    b.append(q)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])

        return f

    lists = lambda posted: posted.groupBy("choice", "key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    posted = _post(fps, short)
    sizes = posted.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = R.cut(sizes)
    few, many = sizes.where(F.col("n") <= LIST).drop("n"), sizes.where(F.col("n") > LIST).drop("n")
    found = lists(posted.join(few, ["choice", "key"], "left_semi")).mapInArrow(link(False), "a long, b long")
    again = posted.join(many, ["choice", "key"], "left_semi").select("fp").distinct()
    return found.unionByName(lists(_post(again, whole)).mapInArrow(link(True), "a long, b long"))


def near_duplicates(fps: DataFrame, distance: int = 2) -> DataFrame:
    """fps (id, fp and any others) with component added: the least id that links of at most `distance` bits reach."""
    if not 0 <= distance <= 4:
        raise ValueError("a pair has to share four positional bytes or more")
    fps = R.cut(fps)
    groups = R.cut(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    spread = groups.select("fp").repartition(R.parts_for(groups, R.MB, fps.sparkSession.sparkContext.defaultParallelism), "fp")
    linked = components(links(spread, distance))
    # only fingerprints of several rows or with links need a look-up; all others are their own component
    of = groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or component is not null").withColumn("c", F.coalesce("component", "fp"))
    least = of.groupBy("c").agg(F.min("least").alias("component_id"))
    known = of.select("fp", "c").join(least, "c").select("fp", "component_id")
    return fps.join(known, "fp", "left").select(*fps.columns, F.coalesce("component_id", "id").alias("component"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
