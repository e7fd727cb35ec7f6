"""Near copies by exact shingle similarity, with SimHash fingerprints as the candidates.

Candidates are texts whose fingerprints differ in at most `distance` bits, 7 by default: the
most for which one of eight positional bytes must agree, so that the byte index has every such
pair. Its lists are keyed by one byte position. 7 bits over four pairs of bytes leave one pair
with at most one bit, so a list compares only members whose neighbouring byte differs in at
most one bit. A candidate is a link if the Jaccard similarity of the two sets of word shingles
is `least` or more; shingles count as equal if their 64-bit hashes are equal.

What is asked for are the components of the links, so candidates within a component need no
look: in two rounds each list sends one candidate for each member at most (its least one in
another component), which joins a large group of copies by as many rows as it has members, and
the last round sends every candidate that is left between components.

Defined cases: texts without words are copies of each other; texts with fewer words than a
shingle have their whole word sequence as one; null ids are never a component's id unless it
has no other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from . import simhash, vec
from .components import components

#: Pairs of a list that are compared at a time.
PAIRS = 1 << 20


def shingle_sets(buf: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, laid end to end, and the n + 1 offsets."""
    raw, s, e, first = simhash.joined_words(buf, at)
    count = np.diff(first)
    n = np.where(count == 0, 0, np.maximum(1, count - words + 1))
    doc = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + first[doc]
    h = vec.slices_hash(np.frombuffer(raw, np.uint8), s[k], e[np.minimum(k + words, first[doc + 1]) - 1])
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(at)))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted sets; two empty ones are equal."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def candidates(fp: np.ndarray, label: np.ndarray, position: int, distance: int):
    """Pairs (i, j) of a list's members within `distance` bits and with other labels, in blocks; a pair
    comes from one of the lists that have it only."""
    neighbour = (fp >> np.uint64(8 * (position ^ 1))).astype(np.uint8)
    order = np.argsort(neighbour, kind="stable")
    fp, label, neighbour = fp[order], label[order], neighbour[order].astype(np.int64)
    start = np.searchsorted(neighbour, np.arange(257))
    own = np.arange(len(fp))
    for mask in (0, *(1 << k for k in range(8))):
        other = neighbour ^ mask
        lo, hi = (own + 1 if not mask else start[other]), start[other + 1]
        n = np.where(other >= neighbour, hi - lo, 0)
        upto = np.concatenate(([0], np.cumsum(n)))
        i = 0
        while i < len(fp):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + PAIRS, "right")) - 1)
            a = np.repeat(own[i:j], n[i:j])
            b = np.arange(len(a)) + np.repeat(lo[i:j] - (upto[i:j] - upto[i]), n[i:j])
            i = j
            x = fp[a] ^ fp[b]
            ok = (np.bitwise_count(x) <= distance) & (label[a] != label[b])
            a, b, x = a[ok], b[ok], x[ok]
            bits = np.bitwise_count(x[:, None].view(np.uint8).reshape(-1, 8))
            has = (bits == 0) & (bits[:, [1, 0, 3, 2, 5, 4, 7, 6]] <= 1)
            mine = has.argmax(axis=1) == position
            yield order[a[mine]], order[b[mine]]


def _rounds(distance: int, whole: bool):
    def f(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        th, fp, label = (table[c].to_numpy() for c in ("th", "fp", "label"))
        found = candidates(fp.view(np.uint64), label, key[0].as_py(), distance)
        if whole:
            parts = [(th[a], th[b]) for a, b in found]
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts) if parts else ((), ())))
        else:
            rank = np.argsort(np.argsort(th))
            best = np.full(len(th), len(th))
            for a, b in found:
                np.minimum.at(best, a, rank[b])
                np.minimum.at(best, b, rank[a])
            some = np.flatnonzero(best < len(th))
            a, b = th[some], np.sort(th)[best[some]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return f


def _sets(words: int):
    def f(batches):
        for batch in batches:
            buf, at = vec.text_buffer(batch["text"])
            for i, j in vec.blocks(buf, at, 1 << 18):
                h, offsets = shingle_sets(buf[at[i] : at[j]], at[i : j + 1] - at[i], words)
                yield pa.RecordBatch.from_arrays([batch["th"].slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))], ["th", "shingles"])
        R.trim()

    return f


def _verify(least: float):
    def f(batches):
        for batch in batches:
            (i, x), (j, y) = ((batch[c].offsets.to_numpy(), batch[c].values.to_numpy()) for c in ("x", "y"))
            ok = [jaccard(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]]) >= least for k in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        R.trim()

    return f


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, distance: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, component): one row per document; component is the least id that links of similar texts reach."""
    if not 0 <= distance <= 7:
        raise ValueError("one of eight bytes agrees for 7 bits at most")
    fps = R.cut(simhash.fingerprints(docs, id_col, text_col, words))
    nodes = R.cut(fps.groupBy("th").agg(F.first("fp").alias("fp"), F.min("id").alias("least"), F.count("*").alias("n")))
    text = F.col(f"`{text_col}`").cast("string")
    label, links, sets = None, None, None
    for whole in (False, False, True):
        now = nodes.select("th", "fp", F.col("th").alias("label")) if label is None else nodes.join(label, nodes.th == label.node, "left").select("th", "fp", F.coalesce("component", "th").alias("label"))
        posted = now.select("*", F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)).alias("byte")) for p in range(8)])).alias("k"))
        pairs = R.cut(posted.select("k.position", "k.byte", "th", "fp", "label").groupBy("position", "byte").applyInArrow(_rounds(distance, whole), "a long, b long").distinct())
        if pairs.isEmpty():
            break
        if sets is None:  # the first round names every text that has a candidate
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
            own = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(wanted, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
            sets = R.cut(own.mapInArrow(_sets(words), "th long, shingles array<long>"))
        both = pairs.join(sets.select(F.col("th").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("th").alias("b"), F.col("shingles").alias("y")), "b")
        found = R.cut(both.select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long"))
        links = found if links is None else links.unionByName(found)
        label = components(links)
    of = nodes.withColumn("c", F.col("th")) if label is None else nodes.join(label, nodes.th == label.node, "left").withColumn("c", F.coalesce("component", "th"))
    of = of.drop("component")
    known = of.select("th", "c").join(of.groupBy("c").agg(F.min("least").alias("component")), "c").select("th", "component")
    return fps.join(known, "th").select("id", "th", "component")
