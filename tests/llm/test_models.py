"""Toxicity, decontamination, embeddings, sharding, token counts and the pipeline."""

import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from trapline.llm import decontaminate, embedding_dedup, sharding, token_counts, toxicity
from trapline.llm.hnsw import Graph

SF = "/root/testdata/sf0.001"


def toxic_docs(n=400):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("an", "er", "th", "on") for b in ("ed", "in", "re", "ti") for c in ("es", "ly", "or", "nd", "st")]
    bad = [f"{s}{e}" for s in ("grokk", "blivvo") for e in ("es", "ly", "or", "nd", "st", "ar")]
    out = []
    for i in range(n):
        w, t = [rng.choice(words) for _ in range(rng.randint(10, 200))], i % 5 == 0
        for _ in range(3 * t):
            w[rng.randrange(len(w))] = rng.choice(bad)
        out.append((i, " ".join(w), int(t)))
    return out


def test_toxicity(spark, no_docs):
    rows = toxic_docs()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "grokkes", "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: (r.s, r.h) for r in toxicity.score(docs, model, into="s").select("doc_id", "s", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert {i for i, (_, h) in got.items() if h} == {i for i in got if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    held = [(got[i][0], y) for i, _, y in rows if got[i][1]]
    assert np.mean([(s >= toxicity.THRESHOLD) == bool(y) for s, y in held]) > 0.95
    assert got[9000][0] == got[9001][0] and all(0 <= s <= 1 for s, _ in got.values())
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert {r.toxicity for r in toxicity.score(docs.drop("toxicity"), none).collect()} == {0.0}


def test_all_ngrams_of_the_sample(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(bytes(x).decode() for x in rng.integers(97, 123, (1300, 10)).astype(np.uint8)) for _ in range(200)]
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2][:200]
    docs = spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    fit = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3).select("doc_id").collect()}
    buf, s, e, _ = toxicity.words_of(pa.array([t for i, t in zip(ids, texts) if i not in fit]))
    want = np.unique(toxicity.grams(buf, s, e)[0])
    assert len(want) > 1 << 20 and np.array_equal(model.gram, want)


def test_leaks(spark, no_docs):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [say(rng.randint(15, 55)) for _ in range(30)]
    docs, want = [], set()
    for i in range(300):
        w = say(rng.randint(1, 400))
        if i % 10 == 0:
            x = list(items[i // 10])
            if i % 20 == 0:  # a paraphrase: words changed, dropped and added, the answer kept
                for k in rng.sample(range(len(x) - 5), len(x) // 8):
                    x[k] = "other"
                x.insert(3, "added")
            w[rng.randrange(len(w)) : 0] = [t.upper() + "," for t in x]
            want.add((i, i // 10))
        docs.append((i, " ".join(w), 1))
    docs += [(5000, None, 1), (5001, "", 1), (None, " ".join(items[1]), 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*enumerate(map(" ".join, items)), (77, None), (78, "..."), (None, "x")], "item_id long, text string")
    assert {(r.id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == want | {(None, 1)}
    assert decontaminate.contaminated(no_docs, b).count() == 0 and decontaminate.contaminated(d, b.where("false")).count() == 0


def test_a_leak_that_fills_the_corpus(spark):
    """Words of a leaked item in over a twentieth of more than 400 cells: no weights, and all leaks found."""
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    item, usual = [f"leak{k}" for k in range(40)], say(30)
    page = say(8) + item + say(10)
    docs = [(i, " ".join(page)) for i in range(100)] + [(i, " ".join(say(250))) for i in range(100, 300)]
    changed = [w if k % 10 else "other" for k, w in enumerate(item)]
    docs += [(300, " ".join(say(100) + changed + say(90))), (301, " ".join(say(70) + usual + say(9))), (302, " ".join(item[::-1]))]
    assert sum(-(-len(t.split()) // decontaminate.STRIDE) for _, t in docs) > 400
    b = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(usual))], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    space = decontaminate.Space([(1, " ".join(item)), (2, " ".join(usual))])
    known = d.selectExpr("doc_id as id", "text").mapInArrow(decontaminate._known(spark.sparkContext.broadcast(space.vocabulary)), "id long, n int, here binary, words binary")
    decontaminate.fit(known, space, 512)
    assert space.plain() == [0]
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {*((i, 1) for i in range(100)), (300, 1), (301, 2)}
    # all items by words
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(d, b.where("item_id = 1")).collect()}
    assert got == {*((i, 1) for i in range(100)), (300, 1)}


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_length(a, b)[0] == t[-1][-1]


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24))
    x[700:800] = x[3] + 0.05 * rng.standard_normal((100, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x.astype(np.float32), Graph.order(rng.integers(0, 1 << 62, 1500).astype(np.uint64))[1])
    r, k, _, _ = embedding_dedup.hits(g, x, x, 0.9, 16)
    want = (x @ x.T >= 0.9).sum()
    assert len(r) >= 0.99 * want and (np.einsum("nd,nd->n", x[r], x[k]) >= 0.9).all()


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((120, 8))
    v[50:60] = v[5] * np.linspace(1, 3, 10)[:, None] + 0.05 * rng.standard_normal((10, 8))
    v[60:75] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] * 4), (204, [float("nan")] * 8), (205, [float("inf")] * 8), (206, [1.0, 0.0]), (207, [2.0, 0.0]), (None, v[7].tolist())]
    audit = []
    got = {r.id: (r.n_links, r.component) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least_shards=2, audit=audit).collect()}
    assert audit[0] == audit[1] > 0
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    twin = {7, *range(60, 75)}
    for i in range(120):
        assert got[i][0] == s[i].sum() - 1 + (i in twin or bool(s[i, 7]))
    assert got[55][1] == 5 and got[70][1] == 7 and got[None] == (16, 7) and got[207] == (1, 206)
    assert all(got[i] == (0, i) for i in range(200, 206))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_rows_search_one_graph_of_leaders(spark, monkeypatch):
    """A row visits the homes in one beam, whatever the rows; in a group with more leaders than the beam, all of them.
    With a graph of few leaders and a narrow beam the results are those of brute force."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 24))
    v[300:600] = v[3] + 0.15 * rng.standard_normal((300, 24))
    v[600:700] = v[:100] + 0.2 * rng.standard_normal((100, 24))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    leaders = np.r_[0:3, 300:380, 700:760]
    g = Graph.build(u[leaders].astype(np.float32), Graph.order(np.arange(len(leaders)).astype(np.uint64))[1])
    home, count, _ = embedding_dedup.visits(g, u.astype(np.float32), 0.9, 8)
    assert count[700:].max() == 8 and count[300:600].min() >= 80 and ((home[300:600] >= 3) & (home[300:600] < 83)).all()
    monkeypatch.setattr(embedding_dedup, "BEAM", 8)
    audit = []
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    out = sorted((r.id, r.n_links, r.component) for r in embedding_dedup.near_duplicates(d, shard_rows=150, least_shards=2, audit=audit).collect())
    want = int(near.sum()) - 900
    assert audit[0] == want and audit[1] >= 0.995 * want
    assert sum(n for _, n, _ in out) == audit[1] and all(n <= near[i].sum() - 1 for i, n, _ in out)
    assert {c for i, _, c in out if 300 <= i < 600} == {3}


def test_shards(spark, docs, no_docs):
    out = sharding.balanced_shards(docs, rounds=3).collect()
    assert len(out) == docs.count()
    per = {s: sorted(r.slot for r in out if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in per.values()) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.id), r.size, r.text_crc32) for r in out) == want
    assert sharding.balanced_shards(no_docs).count() == 0


def test_cut_links_fall(spark, docs):
    """Copies, and then given links: what the result cuts is counted by brute force and below a deal by hash."""
    report = []
    out = sharding.balanced_shards(docs, report=report).collect()
    by = {}
    for r in out:
        by.setdefault(r.text_crc32, []).append(r.shard)
    cut = sum(a != b for v in by.values() for k, a in enumerate(v) for b in v[:k])
    assert report[1] == cut < report[0]
    rng = random.Random(9)
    links = [(10 * g + rng.randrange(10), 10 * g + rng.randrange(10)) for g in range(40) for _ in range(20)] + [(5, 5), (7, 70000), (None, 3)]
    d, report = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string"), []
    out = sharding.balanced_shards(d, links=spark.createDataFrame(links, "a long, b long"), report=report, rounds=8).collect()
    at, pairs = {r.id: r.shard for r in out}, {(min(x), max(x)) for x in links if None not in x and x[0] != x[1] and max(x) < 400}
    assert sorted(list(at.values()).count(s) for s in range(8)) == [50] * 8
    assert report[1] == sum(at[a] != at[b] for a, b in pairs) < 0.6 * report[0]


def test_a_group_larger_than_a_shard(spark):
    d = spark.createDataFrame([(i, "same" if i < 60 else f"own {i}") for i in range(120)], "doc_id long, text string")
    out = sharding.balanced_shards(d).collect()
    n = [sum(r.shard == s for r in out) for s in range(8)]
    assert n == [15] * 8


def test_token_counts(spark, docs, tmp_path):
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    counts = docs.withColumn("n", token_counts.counted(docs.text, token_counts.WORDS))
    assert r.totals().count() == 0
    for _ in range(2):
        r.commit("a", token_counts.inserts(counts, "v1", "n"))
    assert not r.commit("a", counts.limit(0).transform(lambda d: token_counts.inserts(d, "v1", "n")))
    total = lambda: sorted((x.tokenizer, x.docs, x.tokens) for x in r.totals().groupBy("tokenizer").sum("docs", "tokens").toDF("tokenizer", "docs", "tokens").collect())
    words = sum(len((x.text or "").replace("\t", " ").split()) for x in docs.collect())
    assert total() == [("v1", docs.count(), words)]
    some = counts.where("doc_id < 10")
    r.commit("b", token_counts.revisions(some, "v1", "n", "v2", "n"))
    r.compact()
    assert not r.commit("b", token_counts.deletes(some, "v1", "n"))
    r.commit("c", token_counts.deletes(some, "v2", "n"))
    left = total()
    assert [x[0] for x in left] == ["v1"] and left[0][1] == docs.count() - some.count()
    with pytest.raises(ValueError):
        r.commit("a+b", counts)


def test_snapshots_of_many_batches(spark, tmp_path):
    """A snapshot holds any number of batches, and snapshots are folded too."""
    r = token_counts.Rollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("s", "en", 3)], "source string, lang string, n long")
    for k in range(6):
        r.commit(f"{'long-name-' * 15}{k}", token_counts.inserts(one, "v", "n"))
        if k % 2:
            r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v", 6, 18)]
    assert not r.commit(f"{'long-name-' * 15}0", token_counts.inserts(one, "v", "n")) and len(list((tmp_path / "r").glob("[a-z]*"))) == 2


def test_token_count_query(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(token_counts.OP5_SQL).fetchall())
    assert sorted(map(tuple, token_counts.op5_token_counts(spark, SF).select("source", "lang", "tokenizer", "docs", "tokens").collect())) == want


def test_stage_rejects_what_op1_predicts(spark, monkeypatch):
    assert corpus_pipeline.REJECT == toxicity.THRESHOLD
    d = spark.createDataFrame([(i, "x") for i in range(10)], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "train", lambda *a: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model, into: docs.withColumn(into, F.col("doc_id") / 10))
    assert sorted(r.doc_id for r in corpus_pipeline.toxic(spark, d, SF).collect()) == [0, 1, 2]


def test_pipeline(spark):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    d, before = start, start.count()
    for name, stage in corpus_pipeline.STAGES[1:3]:
        d = stage(spark, d, SF)
        assert d.columns == start.columns, name
    assert 0 < d.count() < before
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[0] == "doc_id" and 0 < out.count() < before
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
