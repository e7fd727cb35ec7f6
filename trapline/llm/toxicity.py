"""Toxicity by class-conditional Kneser-Ney models.

Two language models over the bytes of words, one for toxic and one for ordinary text, each of
order `ORDER` with absolute discounting. Their highest order is counted per class; every
lower order is shared: Kneser-Ney continuation counts over the whole corpus, that is how many
different bytes come before an n-gram (n-grams that begin a word have none before them and count
the distinct words that they begin), so what neither class has seen often backs off to the same
figures and says nothing about the class. The log-likelihood ratio of a word is a sum over its bytes; a text is
described by its length-normalised ratio and by the largest length-normalised ratio of any
`SPAN` successive words, and a two-feature logistic fit on labelled texts that the models
haven't counted turns these into a score from 0 to 1.

Labels are learnt from a sample of at most `per_class` labelled texts a class, chosen by a
hash of the id; the sums behind the shared counts cover every text. The model that is sent to
the executors has all n-grams of the sampled texts. Labels, language, source and ids are never
inputs of a score.

Defined cases: a null or empty text has no words and gets the score of two zero ratios; a
document with several labels is toxic if one says so; null labels are left out; without
labels of both classes every score is 0; rows repeated are scored each; null ids stay null
and count as not held out; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import runtime as R
from . import vec

ORDER = 6
DISCOUNT = 0.75
SPAN = 16
#: Words that a task remembers to have sent.
SEEN = 300_000
THRESHOLD = 0.3
#: Marks before and after a word: bytes that UTF-8 never has.
START, END = 0xFE, 0xFF


def grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every word and its end mark: the ORDER bytes up to it as one number (bytes before
    the word are zero, the start mark counts as one), how many of them there are, and the word."""
    n = ends - starts + 2
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    word = np.repeat(np.arange(len(n)), n)
    k = np.arange(total) - (stop - n)[word]
    x = np.full(total, END, np.uint64)
    x[k == 0] = START
    body = (k > 0) & (k < n[word] - 1)
    x[body] = buf[(starts[word] + k - 1)[body]]
    g = np.zeros(total, np.uint64)
    for back in range(ORDER):
        g[back:] |= np.where(k[back:] >= back, x[: total - back if back else total], np.uint64(0)) << np.uint64(8 * back)
    keep = k > 0
    return g[keep], np.minimum(k + 1, ORDER)[keep], word[keep]


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    buf, at = vec.text_buffer(column)
    buf = vec.lower(buf) if len(buf) else buf
    return buf, *vec.word_spans(buf, at)


def tail(g: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes of packed n-grams."""
    return g & np.uint64((1 << 8 * order) - 1)


class Model:
    """Log-likelihood ratios of packed n-grams, and of contexts with an unseen byte."""

    def __init__(self, gram: np.ndarray, ratio: np.ndarray, context: np.ndarray, back: np.ndarray, fit=(0.0, 0.0, 0.0)):
        self.gram, self.ratio, self.context, self.back, self.fit = gram, ratio, context, back, fit

    @classmethod
    def train(cls, gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """gram: packed n-grams of full order, sorted. low: per order below it, sorted packed n-grams and their shared counts."""
        shared = np.full(len(gram), 1 / 257)
        for order, (keys, counts) in enumerate(low, 1):
            shared = _discounted(tail(gram, order), keys, counts.astype(float), order, shared)
        ratio = np.zeros(len(gram))
        context, at = np.unique(gram >> np.uint64(8), return_inverse=True)
        back = np.zeros(len(context))
        for sign, c in ((1, toxic), (-1, ordinary)):
            total, types = np.bincount(at, weights=c, minlength=len(context)), np.bincount(at, weights=c > 0, minlength=len(context))
            left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
            ratio += sign * np.log(np.maximum(c - DISCOUNT, 0) / np.maximum(total[at], 1) + left[at] * shared)
            back += sign * np.log(left)
        return cls(gram, ratio.astype(np.float32), context, back.astype(np.float32))

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word."""
        if not len(starts) or not len(self.gram):
            return np.zeros(len(starts))
        g, _, word = grams(buf, starts, ends)
        i = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        j = np.minimum(np.searchsorted(self.context, g >> np.uint64(8)), len(self.context) - 1)
        value = np.where(self.gram[i] == g, self.ratio[i], np.where(self.context[j] == g >> np.uint64(8), self.back[j], np.float32(0)))
        return np.bincount(word, weights=value, minlength=len(starts))

    def features(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Per text: ratio per word over the text, and the largest ratio per word of SPAN successive words."""
        buf, at = vec.text_buffer(column)
        mean, peak = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for i, j in vec.blocks(buf, at, 1 << 19):
            b = vec.lower(buf[at[i] : at[j]])
            s, e, first = vec.word_spans(b, at[i : j + 1] - at[i])
            if not len(s):
                continue
            h = vec.slices_hash(b, s, e)
            _, one, back = np.unique(h, return_index=True, return_inverse=True)
            w = self.words(b, s[one], e[one])[back]
            upto = np.concatenate(([0.0], np.cumsum(w)))
            n = np.diff(first)
            mean[i:j] = (upto[first[1:]] - upto[first[:-1]]) / np.maximum(n, 1)
            # every window starts at a word and ends at its text's end at the latest
            stop = np.minimum(np.arange(len(s)) + SPAN, np.repeat(first[1:], n))
            best = (upto[stop] - upto[:-1]) / SPAN
            some = np.flatnonzero(n)
            peak[i + some] = np.maximum.reduceat(best, first[some])
        return mean, peak

    def score(self, mean: np.ndarray, peak: np.ndarray) -> np.ndarray:
        a, b, c = self.fit
        if not np.isfinite(a):
            return np.zeros(len(mean))
        return 1 / (1 + np.exp(-np.clip(a + b * mean + c * peak, -500, 500)))


def _discounted(gram: np.ndarray, keys: np.ndarray, counts: np.ndarray, order: int, lower: np.ndarray) -> np.ndarray:
    """Interpolated absolute discounting of one order; keys holds all n-grams of the contexts asked for."""
    if not len(keys):
        return lower
    context, at = np.unique(keys >> np.uint64(8), return_inverse=True)
    total, types = np.bincount(at, weights=counts), np.bincount(at)
    i = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
    j = np.minimum(np.searchsorted(context, gram >> np.uint64(8)), len(context) - 1)
    n = np.where(keys[i] == gram, counts[i], 0.0)
    seen = context[j] == gram >> np.uint64(8)
    return np.where(seen, np.maximum(n - DISCOUNT, 0) / total[j] + DISCOUNT * types[j] / total[j] * lower, lower)


def _reduce(keys: list[np.ndarray], weights: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    u, back = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(back, weights=None if weights is None else np.concatenate(weights), minlength=len(u)).astype(np.int64)


def _class_counts(batches):
    """(gram, toxic, n) of labelled texts."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy()
        for kind in (0, 1):
            own = batch.filter(pa.array(toxic == kind))
            buf, s, e, _ = words_of(own["text"])
            for i in range(0, len(s), 100_000):
                u, n = np.unique(grams(buf, s[i : i + 100_000], e[i : i + 100_000])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), kind, np.int32)), pa.array(n)], ["gram", "toxic", "n"])


def _distinct_words(batches):
    seen: set[bytes] = set()
    for batch in batches:
        buf, at = vec.text_buffer(batch["text"])
        for i, j in vec.blocks(buf, at, 1 << 20):
            b = vec.lower(buf[at[i] : at[j]])
            s, e, _ = vec.word_spans(b, at[i : j + 1] - at[i])
            _, one = np.unique(vec.slices_hash(b, s, e), return_index=True)
            raw = b.tobytes()
            if len(seen) > SEEN:  # a word may then be sent again
                seen = set()
            new = {raw[x:y] for x, y in zip(s[one].tolist(), e[one].tolist(), strict=True)} - seen
            seen |= new
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary())], ["word"])
    seen.clear()
    R.trim()


def _extensions(wanted):
    """N-grams of the lower orders, for the contexts of the model, with the byte before them (long: the n-gram
    has one more byte than its order) or, if they begin a word, in how many words."""

    def f(batches):
        contexts = wanted.value
        for batch in batches:
            buf, at = vec.text_buffer(batch["word"])
            for i in range(0, len(at) - 1, 50_000):
                a = at[i : i + 50_001]
                g, have, _ = grams(buf[a[0] : a[-1]], a[:-1] - a[0], a[1:] - a[0])
                for order in range(1, ORDER):
                    c, x = contexts[order - 1], tail(g, order) >> np.uint64(8)
                    own = c[np.minimum(np.searchsorted(c, x), len(c) - 1)] == x
                    for longer in (True, False):
                        x = tail(g, order + longer)[own & (have > order if longer else have == order)]
                        u, n = np.unique(x, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), order, np.int32)), pa.array([longer] * len(u), pa.bool_()), pa.array(u.view(np.int64)), pa.array(n)], ["n_order", "longer", "gram", "n"])

    return f


def continuations(words: DataFrame, wanted) -> DataFrame:
    """(n_order, gram, n): continuation counts over distinct words (word)."""
    found = words.mapInArrow(_extensions(wanted), "n_order int, longer boolean, gram long, n long").groupBy("n_order", "longer", "gram").agg(F.sum("n").alias("n"))
    mask = F.expr("shiftleft(1L, 8 * n_order) - 1L")
    return found.groupBy("n_order", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.sum(F.when(F.col("longer"), 1).otherwise(F.col("n"))).alias("n"))


def held_out(id_col: Column) -> Column:
    """Labels of these ids are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000) -> Model:
    spark = docs.sparkSession
    R.short_batches(spark)
    empty = np.zeros(0, np.uint64)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna().where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = R.cut(known.withColumn("u", F.xxhash64("id")))
    size = dict(known.groupBy("toxic").count().collect())
    # at most 2 * per_class rows of a few bytes
    sample = known.where("toxic = 1").orderBy("u", "id").limit(per_class).unionByName(known.where("toxic = 0").orderBy("u", "id").limit(per_class))
    sample = R.cut(text.join(F.broadcast(R.cut(sample)), "id").withColumn("fit", F.pmod(F.col("u"), F.lit(4)) == 3))
    counted = sample.where("not fit").mapInArrow(_class_counts, "gram long, toxic int, n long").groupBy("gram").pivot("toxic", [0, 1]).sum("n").fillna(0)
    rows = counted.select("gram", F.col("0").alias("o"), F.col("1").alias("t")).toArrow()
    if not rows.num_rows or not size.get(0) or not size.get(1):
        return Model(empty, empty, empty, empty, (-np.inf, 0.0, 0.0))
    gram = rows["gram"].to_numpy().view(np.uint64)
    o = np.argsort(gram)
    gram, toxic, ordinary = gram[o], rows["t"].to_numpy()[o].astype(float), rows["o"].to_numpy()[o].astype(float)
    wanted = spark.sparkContext.broadcast([np.unique(tail(gram, k) >> np.uint64(8)) for k in range(1, ORDER)])
    words = text.select("text").mapInArrow(_distinct_words, "word binary").distinct()
    # bytes after a context of the model: at most 256 for each
    low = continuations(words, wanted).toArrow()
    order, key, n = (low[c].to_numpy() for c in ("n_order", "gram", "n"))
    shared = []
    for k in range(1, ORDER):
        x, c = key[order == k].view(np.uint64), n[order == k]
        p = np.argsort(x)
        shared.append((x[p], c[p]))
    model = Model.train(gram, toxic, ordinary, shared)
    model.fit = _fit(spark, model, sample.where("fit"), size)
    return model


def _fit(spark, model: Model, sample: DataFrame, size: dict) -> tuple[float, float, float]:
    """Ridge logistic regression on at most 2 * per_class rows, weighted to the labels' own shares."""
    held = spark.sparkContext.broadcast(model)

    def f(batches):
        for batch in batches:
            mean, peak = held.value.features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(mean), pa.array(peak)], ["toxic", "mean", "peak"])

    got = sample.select("toxic", "text").mapInArrow(f, "toxic int, mean double, peak double").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return (-1.0, 1.0, 1.0)
    x = np.column_stack((np.ones(len(y)), got["mean"].to_numpy(), got["peak"].to_numpy()))
    w = np.where(y > 0, size[1] / y.sum(), size[0] / (1 - y).sum())
    w *= len(y) / w.sum()
    beta, ridge = np.zeros(3), np.array([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (w * (y - p)) - ridge * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(beta.tolist())


def score(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str] | None = None, into: str = "toxicity") -> DataFrame:
    """docs' columns (or those named) with a score from 0 to 1 added; `into` must be a new name."""
    R.short_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if columns is None else columns
    rows = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    text = rows.columns.index(text_col)

    def f(batches):
        for batch in batches:
            mean, peak = held.value.features(batch.column(text).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(held.value.score(mean, peak))], [*batch.schema.names[: len(keep)], into])
        R.trim()

    return rows.mapInArrow(f, StructType([*rows.schema.fields[: len(keep)], StructField(into, DoubleType())]))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, columns=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
