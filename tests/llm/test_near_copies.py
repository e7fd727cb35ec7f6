"""The pipeline's near-dedup stage against brute force over shingle sets and fingerprints."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from trapline.llm import near_copies, simhash, vec


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def corpus():
    """Texts with edits, so that links lie at 0 to 7 bits and pairs within 7 bits on both sides of 0.8."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(500)]
    out = []
    for _ in range(40):
        w = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(8):
            x = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                x[rng.randrange(len(x))] = rng.choice(words)
            out.append(" ".join(x))
    # one frequent line sets the fingerprint of texts that are not alike
    out += [" ".join(["so it goes on and"] * 40 + [rng.choice(words) for _ in range(30)]) for _ in range(20)]
    return out + [out[0], out[0].upper(), None, "", " \n", "one two", "One  two", "one three"]


def test_stage_is_brute_force(spark):
    rows = list(enumerate(corpus()))
    random.Random(2).shuffle(rows)
    buf, at = vec.text_buffer(pa.array([t for _, t in rows]))
    fp, sets = simhash.fingerprints_of(buf, at, 5), [shingles(t) for _, t in rows]
    root, seen = {i: i for i, _ in rows}, np.zeros(65, int)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    rejected = 0
    for a in range(len(rows)):
        for b in range(a):
            d = int(fp[a] ^ fp[b]).bit_count()
            if d <= 7:
                if similar(sets[a], sets[b]):
                    seen[d] += 1
                    x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                    root[y] = x
                else:
                    rejected += 1
    assert seen[3:8].sum() > 20 and rejected > 20  # two bits alone, and bits alone, give another result
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, None).collect())
    assert got == [i for i in sorted(root) if top(i) == i]


def test_lists_have_every_pair_once():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 63, 30).astype(np.uint64)
    fp = np.concatenate([fp, *(fp ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 30)).astype(np.uint64)) for k in (1, 3, 5, 7, 7, 8))])
    got = []
    for p in range(8):
        byte = (fp >> np.uint64(8 * p)) & np.uint64(255)
        for v in np.unique(byte):
            own = np.flatnonzero(byte == v)
            got += [tuple(sorted((own[i], own[j]))) for a, b in near_copies.candidates(fp[own], own, p, 7) for i, j in zip(a, b)]
    a, b = np.triu_indices(len(fp), 1)
    ok = np.bitwise_count(fp[a] ^ fp[b]) <= 7
    assert sorted(got) == sorted(zip(a[ok], b[ok]))
