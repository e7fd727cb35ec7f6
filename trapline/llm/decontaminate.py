"""Benchmark decontamination by latent semantic retrieval.

Texts are read and hashed once: what is kept of a document is which of its words are words of
the benchmark, as a table in the shared folder that every later step reads. Documents are cut
into passages of `2 * STRIDE` words, `STRIDE` apart. A passage is a TF-IDF vector over the words
of the benchmark (words in over `COMMON` of the cells of STRIDE words weigh nothing); document
frequencies cover all documents. A randomised SVD of these vectors runs distributed and in one
pass: a task adds up its part of A'AX for a thin orthonormal X, the parts are summed by blocks
of words in a tree, and the thin result Y (words by rank) comes to the driver, where A'A is
taken as Y (X'Y)^-1 Y' (Nystroem) and decomposed. Benchmark items take part as passages with the
weight of all others together, so that every item has its direction in the latent space as far
as `rank` goes; there is one space for all items. Passages whose latent cosine with an item
reaches `COSINE` are candidates. Items with so few weighted words that a match may hold none of
them (at most 1 - `WEAK` of their words) are looked for by words instead: every passage that
holds `WEAK` of an item's words, in any order, is a candidate, which no match can fail. A
candidate is verified on its words: the longest common subsequence of item and passage (widened
by the item's length) must hold `STRONG` of the item's words, or `WEAK` of them and nearly all of
its answer, the item's last `ANSWER` words, unless all of these are words that weigh nothing; a
paraphrase that changes, drops or adds words keeps both.

The benchmark has to fit in the driver's memory, and its vocabulary times `rank` in a task's;
items are looked for `GROUP` at a time, which bounds what a search sends and changes no result.
Documents are never shuffled.

Defined cases: a null or empty text has no passages; an item without words matches nothing; null
ids stay null and give rows; rows repeated give rows each, and so do repeated ids; items repeated
give rows each; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime as R
from . import vec

STRIDE = 32
COMMON = 0.05
COSINE = 0.35
STRONG, WEAK = 0.8, 0.6
ANSWER, ANSWER_SHARE = 5, 0.8
#: Items that one search looks for.
GROUP = 8192
#: Directions beyond one for each item.
OVERSAMPLE = 32
#: Passages that are multiplied together.
PASSAGES = 128
#: Words of the vocabulary whose sums travel together, and parts that one step of the tree adds up.
SHEET, FAN = 256, 64
#: Words of the benchmark that are handled together.
ENTRIES = 1 << 16

HITS = "id long, item_id long, similarity double, answer double, first_word int, last_word int"


def hashed(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words without punctuation, and the first word of each text (n + 1)."""
    b = vec.lower(buf) if len(buf) else buf
    s, e, first = vec.word_spans(b, at, vec.PLAIN)
    return vec.slices_hash(b, s, e), first


def common_length(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Length of the longest common subsequence (bit-parallel), and the first and last position of b that matches a word of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, lo, hi = full, -1, -1
    for j, x in enumerate(b):
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
            lo, hi = (j if lo < 0 else lo), j
    return len(a) - v.bit_count(), lo, hi


class Space:
    """The words of a benchmark, their weights and the latent space."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, h = [i for i, _ in items], [], []
        buf, at = vec.text_buffer(pa.array([t for _, t in items], pa.large_string()))
        for i, j in vec.blocks(buf, at):
            x, first = hashed(buf[at[i] : at[j]], at[i : j + 1] - at[i])
            h += [x[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *h]))
        #: Of each item its words, as numbers in the vocabulary.
        self.words = [np.searchsorted(self.vocabulary, x) for x in h]
        self.idf = np.zeros(len(self.vocabulary), np.float32)
        self.right = np.zeros((len(self.vocabulary), 0), np.float32)

    def item_rows(self, items: slice) -> tuple[np.ndarray, ...]:
        """Each item as one passage."""
        words = self.words[items]
        n = np.array([len(x) for x in words], np.int64)
        pos = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in n)])
        return rows(self.idf, n, np.repeat(np.arange(len(n)), n), pos, np.concatenate([np.zeros(0, np.int64), *words]), stride=int(max(n.max(initial=0), 1)))

    def latent(self, items: slice) -> np.ndarray:
        row, v, value, doc, _ = self.item_rows(items)
        out = np.zeros((len(self.words[items]), self.right.shape[1]), np.float32)
        y = times(row, v, value, self.right)
        out[doc] = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return out

    def plain(self) -> list[int]:
        """Items that are looked for by words."""
        return [k for k, w in enumerate(self.words) if len(w) and np.mean(self.idf[w] > 0) <= 1 - WEAK]


def rows(idf: np.ndarray, n: np.ndarray, doc: np.ndarray, pos: np.ndarray, v: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """Sparse TF-IDF rows of the passages of some texts of n words, of which words v are at pos of texts doc:
    passage, word and value of each entry (unit rows, in the order of passages), and the text and first word
    of each passage that has entries."""
    own = idf[v] > 0
    doc, pos, v = doc[own], pos[own], v[own]
    passages = np.maximum(1, -(-n // stride) - 1)
    base = np.concatenate(([0], np.cumsum(passages)))
    k = pos // stride
    here, back = k < passages[doc], k > 0
    key = np.concatenate(((base[doc] + k)[here], (base[doc] + k - 1)[back])) * len(idf) + np.concatenate((v[here], v[back]))
    key, tf = np.unique(key, return_counts=True)
    g, v = np.divmod(key, max(1, len(idf)))
    value = (1 + np.log(tf)) * idf[v]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    p, row = g[new], np.cumsum(new) - 1
    value /= np.sqrt(np.bincount(row, weights=value * value, minlength=len(p)))[row]
    doc = np.searchsorted(base, p, "right") - 1
    return row, v, value.astype(np.float32), doc, (p - base[doc]) * stride


def dense(row: np.ndarray, v: np.ndarray, value: np.ndarray, step: int = PASSAGES):
    """Sparse rows in dense blocks of `step` rows over the words that occur in them: first row, words, block."""
    for a in range(0, int(row[-1]) + 1 if len(row) else 0, step):
        i, j = np.searchsorted(row, [a, a + step])
        words, at = np.unique(v[i:j], return_inverse=True)
        block = np.zeros((int(row[j - 1]) + 1 - a, len(words)), np.float32)
        block[row[i:j] - a, at] = value[i:j]
        yield a, words, block


def times(row: np.ndarray, v: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sparse rows times a thin matrix."""
    return np.concatenate([np.zeros((0, x.shape[1]), np.float32), *(block @ x[words] for _, words, block in dense(row, v, value))])


def _known(vocabulary):
    """Of each text: how many words it has, which of them the vocabulary has (bits) and their numbers there."""

    def f(batches):
        known = vocabulary.value
        kind = np.uint16 if len(known) <= 1 << 16 else np.uint32
        for batch in batches:
            buf, at = vec.text_buffer(batch["text"])
            for i, j in vec.blocks(buf, at, 1 << 18):
                h, first = hashed(buf[at[i] : at[j]], at[i : j + 1] - at[i])
                v = np.minimum(np.searchsorted(known, h), len(known) - 1)
                here = known[v] == h
                n = np.diff(first)
                size = -(-n // 8)  # a text's bits start at a byte
                start = np.concatenate(([0], np.cumsum(size)))
                bit = np.zeros(8 * int(start[-1]), bool)
                bit[np.flatnonzero(here) + np.repeat(8 * start[:-1] - first[:-1], n)[here]] = True
                upto = np.concatenate(([0], np.cumsum(here)))[first]
                yield pa.RecordBatch.from_arrays([batch["id"].slice(i, j - i), pa.array(n.astype(np.int32)), R.strings(np.packbits(bit), start).cast(pa.binary()), R.strings(v[here].astype(kind).view(np.uint8), upto * kind().itemsize).cast(pa.binary())], ["id", "n", "here", "words"])
        R.trim()

    return f


def _read(batches, size: int):
    """Texts of the table that _known made, in blocks: the batch and first row, words of each text, and text,
    position and number of each word that the vocabulary (of `size`) has."""
    for batch in batches:
        n = batch["n"].to_numpy().astype(np.int64)
        bit, at = vec.text_buffer(batch["here"])
        v, upto = vec.text_buffer(batch["words"])
        v = v.view(np.uint16 if size <= 1 << 16 else np.uint32)
        upto = upto // v.itemsize
        for i, j in vec.blocks(v, upto, ENTRIES):
            g = np.flatnonzero(np.unpackbits(bit[at[i] : at[j]]))
            doc = np.searchsorted(8 * (at[i : j + 1] - at[i]), g, "right") - 1
            yield batch, i, n[i:j], doc, g - 8 * (at[i:j] - at[i])[doc], v[upto[i] : upto[j]].astype(np.int64)
    R.trim()


def _frequencies(size: int):
    """In how many cells of STRIDE words each word of the vocabulary is; index -1 counts the cells."""

    def f(batches):
        count, cells = np.zeros(size, np.int64), 0
        for _, _, n, doc, pos, v in _read(batches, size):
            base = np.concatenate(([0], np.cumsum(-(-n // STRIDE))))
            count += np.bincount(np.unique((base[doc] + pos // STRIDE) * size + v) % size, minlength=size)
            cells += int(base[-1])
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(count[k], cells))], ["word", "n"])

    return f


def _gram(weights, x):
    """This task's part of A'AX in sheets of the vocabulary; sheet -1 counts the passages."""

    def f(batches):
        idf, thin = weights.value, x.value
        z, total = np.zeros(thin.shape, np.float32), 0
        for _, _, n, doc, pos, v in _read(batches, len(idf)):
            row, v, value, doc, _ = rows(idf, n, doc, pos, v)
            total += len(doc)
            for _, words, block in dense(row, v, value):
                z[words] += block.T @ (block @ thin[words])
        sheets = [k for k in range(0, len(z), SHEET) if z[k : k + SHEET].any()]
        parts = [*[z[k : k + SHEET].astype(np.float64).tobytes() for k in sheets], b""]
        yield pa.RecordBatch.from_arrays([pa.array([*[k // SHEET for k in sheets], -1], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), pa.array([total] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["sheet", "lane", "n", "part"])

    return f


def _sum(table: pa.Table) -> pa.Table:
    total = None
    for x in table["part"]:
        part = np.frombuffer(x.as_buffer())
        total = part.copy() if total is None else np.add(total, part, out=total)
    return pa.table([table["sheet"].slice(0, 1), table["lane"].slice(0, 1), pa.array([int(np.sum(table["n"].to_numpy()))]), pa.array([total.tobytes()], pa.binary())], ["sheet", "lane", "n", "part"])


def _product(known: DataFrame, space: Space, thin: np.ndarray) -> np.ndarray:
    """A'AX over all passages, and over the items with the weight of all passages together."""
    sc, schema = known.sparkSession.sparkContext, "sheet int, lane int, n long, part binary"
    parts = known.mapInArrow(_gram(sc.broadcast(space.idf), sc.broadcast(thin)), schema)
    lanes = parts.rdd.getNumPartitions()
    while True:
        parts, lanes = parts.withColumn("lane", F.floor(F.col("lane") / FAN).cast("int")).groupBy("sheet", "lane").applyInArrow(_sum, schema), -(-lanes // FAN)
        if lanes <= 1:
            break
    z, n = np.zeros(thin.shape), 0
    for sheet, _, count, part in parts.collect():  # the vocabulary times rank
        if sheet < 0:
            n = count
        else:
            x = np.frombuffer(part).reshape(-1, thin.shape[1])
            z[sheet * SHEET : sheet * SHEET + len(x)] = x
    for k in range(0, len(space.ids), GROUP):
        row, v, value = space.item_rows(slice(k, k + GROUP))[:3]
        for _, words, block in dense(row, v, value):
            z[words] += max(1.0, n / max(1, len(space.ids))) * (block.T @ (block @ thin[words]))
    return z


def fit(known: DataFrame, space: Space, rank: int) -> None:
    """Weights and latent space of a benchmark from all passages."""
    size = len(space.vocabulary)
    counts = dict(known.mapInArrow(_frequencies(size), "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    cells = max(1, counts.pop(-1, 0))
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    space.idf = np.where(df <= COMMON * cells, np.log1p(cells / (1 + df)), 0).astype(np.float32)
    rank = min(size, len(space.ids) + OVERSAMPLE, rank)
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((size, rank)))[0].astype(np.float32)
    y = _product(known, space, x)
    t, u = np.linalg.eigh((x.T @ y + y.T @ x) / 2)
    keep = t > 1e-6 * max(t.max(initial=0), 1e-30)
    # squared singular values are those of the factor below, squared; its left vectors span the space
    left, singular, _ = np.linalg.svd((y @ u[:, keep]) / np.sqrt(t[keep]), full_matrices=False)
    space.right = left[:, singular > 1e-4 * singular.max(initial=0)].astype(np.float32)


def by_words(items: dict[int, np.ndarray], n: np.ndarray, doc: np.ndarray, at: np.ndarray, v: np.ndarray, first: np.ndarray):
    """Text, first word of the passage, and item, of the passages (widened by the item's length) that hold
    WEAK of an item's words. at: where words v are in the texts laid end to end; first: where texts start there."""
    passages = np.maximum(1, -(-n // STRIDE) - 1)
    text = np.repeat(np.arange(len(n)), passages)
    start = (np.arange(len(text)) - (np.cumsum(passages) - passages)[text]) * STRIDE
    for item, its in items.items():
        lo = np.maximum(first[text], first[text] + start - len(its))
        hi = np.minimum(first[text + 1], first[text] + start + 2 * STRIDE + len(its))
        words, many = np.unique(its, return_counts=True)
        k = np.minimum(np.searchsorted(words, v), len(words) - 1)
        own = np.flatnonzero(words[k] == v)
        where = at[own]
        some = np.flatnonzero((np.searchsorted(where, hi) - np.searchsorted(where, lo)) / len(its) >= WEAK)
        if len(some):
            held = np.zeros(len(some), np.int64)
            for word, most in enumerate(many):
                x = where[k[own] == word]
                held += np.minimum(most, np.searchsorted(x, hi[some]) - np.searchsorted(x, lo[some]))
            for p in some[held / len(its) >= WEAK]:
                yield int(text[p]), int(start[p]), item


class Search:
    """What the search for some items sends to the executors."""

    def __init__(self, space: Space, items: slice):
        self.ids, self.words, self.latent = space.ids[items], space.words[items], space.latent(items)
        plain = set(space.plain())
        self.plain = {k - items.start: space.words[k] for k in range(items.start, min(items.stop, len(space.ids))) if k in plain}
        self.idf, self.right = space.idf, space.right
        #: Of each item: whether its answer can be told from what any text says.
        self.telling = [bool((space.idf[x[-ANSWER:]] > 0).any()) for x in self.words]

    def candidates(self, n, doc, pos, v):
        """(text, first word of the passage, item) that are to be verified."""
        row, word, value, text, start = rows(self.idf, n, doc, pos, v)
        for a, own, block in dense(row, word, value):
            y = block @ self.right[own]
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            for p, item in zip(*(x.tolist() for x in np.nonzero(y @ self.latent.T >= COSINE)), strict=True):
                yield int(text[a + p]), int(start[a + p]), item
        if self.plain:
            first = np.concatenate(([0], np.cumsum(n)))
            yield from by_words(self.plain, n, doc, first[doc] + pos, v, first)

    def found(self, n, doc, pos, v) -> dict[tuple[int, int], tuple]:
        """Of each (text, item) the best match: share of the item, of its answer, first and last word."""
        out: dict[tuple[int, int], tuple] = {}
        edge = np.searchsorted(doc, np.arange(len(n) + 1))
        for d, begin, item in self.candidates(n, doc, pos, v):
            words = self.words[item]
            own = slice(edge[d], edge[d + 1])
            a, b = edge[d] + np.searchsorted(pos[own], (begin - len(words), begin + 2 * STRIDE + len(words)))
            passage = v[a:b].tolist()
            k, lo, hi = common_length(words.tolist(), passage)
            share = k / len(words)
            if share < WEAK:
                continue
            tail = words[-ANSWER:].tolist()
            answer = common_length(tail, passage)[0] / len(tail)
            if share >= STRONG or answer >= ANSWER_SHARE and self.telling[item]:
                hit = (share, answer, int(pos[a + lo]), int(pos[a + hi]))
                out[d, item] = max(out.get((d, item), hit), hit)
        return out


def _search(sent):
    def f(batches):
        s = sent.value
        for batch, i, *texts in _read(batches, len(s.idf)):
            found = s.found(*texts)
            if found:
                keys = sorted(found)
                share, answer, b, e = zip(*(found[x] for x in keys), strict=True)
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array([i + d for d, _ in keys])), pa.array([s.ids[x] for _, x in keys], pa.int64()), pa.array(share), pa.array(answer), pa.array(b, pa.int32()), pa.array(e, pa.int32())], [c.split()[0] for c in HITS.split(", ")])

    return f


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 512) -> DataFrame:
    """One row per document and benchmark item found in it: id, item_id, similarity (share of the item's
    words in the common subsequence), answer (the same of its last words) and the words it spans.
    rank: most directions of the latent space."""
    spark = docs.sparkSession
    R.short_batches(spark)
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    space = Space([(x.i, x.t) for x in items.toLocalIterator()])
    if not len(space.vocabulary):
        return spark.createDataFrame([], HITS)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    path, out = R.scratch(spark, "benchmark-words"), None
    known = R.cut_to(texts.mapInArrow(_known(spark.sparkContext.broadcast(space.vocabulary)), "id long, n int, here binary, words binary"), path)
    fit(known, space, rank)
    for k in range(0, len(space.ids), GROUP):
        hits = known.mapInArrow(_search(spark.sparkContext.broadcast(Search(space, slice(k, k + GROUP)))), HITS)
        out = hits if out is None else out.unionByName(hits)
    out = R.cut(out)
    R.drop(spark, path)
    return out


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    hits = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(F.col("id").alias("doc_id"), "item_id", F.round("similarity", 6).alias("similarity"), F.round("answer", 6).alias("answer"), "first_word", "last_word")
