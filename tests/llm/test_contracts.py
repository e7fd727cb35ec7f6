"""Every query and every pipeline stage on one small folder with all edge cases, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from trapline.llm import bpe, components, decontaminate, pretoken, queries, simhash, substring_dedup, suffix_dedup, toxicity, vec

from .test_dedup import cut_strings, fingerprint
from .test_near_copies import shingles, similar

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    more = list(thue_morse(11)) + ["the <|endoftext|> mark", "leak of " + " ".join(f"item{k}" for k in range(20)) + " here"]
    own = docs.schema.fieldNames()
    extra = spark.createDataFrame([(5000 + k, t, "en", "s0", len(t), "c", 1, "x", 0.5, 1) for k, t in enumerate(more)], docs.schema)
    docs.unionByName(extra).select(*own).coalesce(2).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, 1, 1), (51, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20))), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    rng = np.random.default_rng(2)
    v = rng.standard_normal((60, 6))
    v[20:30] = v[4]
    v[30:34] = v[4] + 0.02 * rng.standard_normal((4, 6))
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)] + [(100, None, 1), (101, [0.0] * 6, 1)], "vec_id long, embedding array<double>, label int").write.parquet(str(d / "embeddings.parquet"))
    return str(d)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op1(spark, folder, rows):
    out = queries.QUERIES["op1_toxicity"](spark, folder).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _ in rows)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_op3(spark, folder, rows, monkeypatch):
    root = {fingerprint(t.encode(), 3): None for _, t in rows}
    root = {f: f for f in root}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if i is not None:
            f = find(fingerprint(t.encode(), 3))
            least[f] = min(i, least.get(f, i))
    want = sorted((str(i), f"{fingerprint(t.encode(), 3):016x}", str(least.get(find(fingerprint(t.encode(), 3))))) for i, t in rows)
    for most in (256, 1):  # with 1 all lists are dealt again by all choices of positions
        monkeypatch.setattr(simhash, "LIST", most)
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in queries.QUERIES["op3_simhash"](spark, folder).collect()) == want


def test_op6(spark, folder, rows):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    out = sorted(queries.QUERIES["op6_token_files"](spark, folder).collect(), key=lambda r: r.start)
    ids = lambda t: np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in out) == sorted((str(i), len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    assert [r.start for r in out] == np.concatenate(([0], np.cumsum([r.n_tokens for r in out])))[:-1].tolist()
    assert [r.doc_id for r in out if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)


def test_op7(spark, folder, rows):
    ranks = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)[0]
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(x := lib.encode_ordinary(t)), sha(",".join(map(str, x)).encode()), sha(t.encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op7_bpe"](spark, folder).collect()) == want


def test_op8(spark, folder, rows):
    out = queries.QUERIES["op8_sharding"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted((str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
    n = [sorted(r.slot for r in out if r.shard == s) for s in range(8)]
    assert all(x == list(range(len(x))) for x in n) and max(map(len, n)) - min(map(len, n)) <= 1
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_op9(spark, folder):
    assert {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_decontaminate"](spark, folder).collect()} == {(5003, 1)}


def test_op10(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    x = np.array([e if e and any(e) else [np.nan] * 6 for _, e in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.nan_to_num(u @ u.T, nan=-2) >= 0.9
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    ids = np.array([i for i, _ in rows])
    root = components.local_roots(len(ids), a, b)
    least = {k: ids[root == k].min() for k in set(root.tolist())}
    want = sorted((int(i), int(near[k].sum()), int(least[root[k]]), bool(i == least[root[k]])) for k, i in enumerate(ids))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op10_embedding_dedup"](spark, folder).collect()) == want


def test_words_that_cancel(spark):
    """Thue-Morse words collide in any polynomial modulo 2**64."""
    a, b = thue_morse(11)
    tail = " ".join(f"w{k}" for k in range(34))
    buf, at = vec.text_buffer(pa.array([a, b]))
    assert len(set(vec.slices_hash(buf, at[:-1], at[1:]).tolist())) == 2
    d = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeated_windows(d).collect()] == [0, 0]
    got = sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.remove_repeated_strings(d).collect())
    assert got == cut_strings([(1, f"{a} {tail}".encode()), (2, f"{b} {tail}".encode())], 50)
    items = spark.createDataFrame([(1, f"{a} x1 x2 x3 x4")], "item_id long, text string")
    assert [r.id for r in decontaminate.contaminated(spark.createDataFrame([(1, f"{a} x1 x2 x3 x4 more"), (2, b)], "doc_id long, text string"), items).collect()] == [1]


def test_pieces_with_one_hash_stay_apart(monkeypatch):
    """Bytes decide what a cached piece is, even if all hashes are equal."""
    ranks = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)[0]
    buf, at = vec.text_buffer(pa.array(["some words and others", "other words again and again", "some more"] * 3))
    want = pretoken.Encoder(ranks.encode, lambda t: []).encode(buf, at)
    monkeypatch.setattr(vec, "slices_hash", lambda b, s, e: np.zeros(len(s), np.uint64))
    own = pretoken.Encoder(ranks.encode, lambda t: [])
    for _ in range(2):
        assert all(np.array_equal(x, y) for x, y in zip(own.encode(buf, at), want))


def test_long_texts_are_cut_between_words(monkeypatch):
    ranks = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)[0]
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc de's  12\n.é") for _ in range(n)) for n in (5000, 3, 0, 9000)] + ["x" * 5000]
    buf, at = vec.text_buffer(pa.array(texts))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    monkeypatch.setattr(pretoken.Encoder, "MOST", 300)
    ids, counts = pretoken.Encoder(ranks.encode, lib.encode_ordinary).encode(buf, at)
    upto = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [lib.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("n,order", [(1000, "up"), (1000, "down"), (20_000, "mixed")])
def test_chains(spark, n, order):
    ids = list(range(n))
    if order == "mixed":
        random.Random(1).shuffle(ids)
    log = []
    out = components.components(spark.createDataFrame([*zip(ids, ids[1:])] if order != "down" else [*zip(ids[1:], ids)], "a long, b long").repartition(4), log)
    assert [tuple(r) for r in out.groupBy("component").count().collect()] == [(0, n)]
    assert len(log) <= n.bit_length() and max(log) <= n.bit_length() + 2


def key(t):
    return sorted(map(str, t))


def test_stages(spark, folder, rows):
    """Each stage on all edge cases: what stays, its columns, and an empty table."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.limit(0)
    scored = {str((r.doc_id, r.text)): r.s for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")), into="s").collect()}
    out = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, folder)
    assert out.columns == docs.columns
    assert key((r.doc_id, r.text) for r in out.collect()) == sorted(k for r in docs.collect() for k in [str((r.doc_id, r.text))] if scored[k] < 0.3)

    out = dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, docs, folder)
    assert out.columns == docs.columns and key((r.doc_id, r.text) for r in out.collect()) == key((r.doc_id, r.text) for r in docs.collect() if r.doc_id != 5003)

    out = dict(corpus_pipeline.STAGES)["suffix_array_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    left = {}
    for i, n, gone, _, _ in cut_strings([(i, t.encode()) for i, t in rows], 50):
        left.setdefault(i, []).append(n == gone and n > 0)
    assert {str(r.doc_id) for r in out.collect()} == {i for i, all_gone in left.items() if not all(all_gone)}

    out = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, folder)
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in out.collect()) == sorted((str(i), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)

    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, folder)
    assert out.columns == docs.columns
    every = {(i, t) for i, t in rows if i is not None}
    stay = {(r.doc_id, r.text or "") for r in out.collect() if r.doc_id is not None}
    sets = {x: shingles(x[1]) for x in every}
    assert stay < every and all(any(y[0] < x[0] and similar(sets[x], sets[y]) for y in every) for x in every - stay)
    same = {}
    for i, t in stay:
        same.setdefault(b" ".join(WORD.findall(t.encode().lower())), set()).add(i)  # A-Z only
    assert all(len(v) == 1 for v in same.values())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
