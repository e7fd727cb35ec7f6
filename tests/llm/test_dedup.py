"""Substring, suffix and SimHash dedup against brute force on documents with all edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from trapline.llm import simhash, substring_dedup, suffix_dedup, vec
from trapline.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def given(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("window", [35])
def test_windows(docs, window):
    rows = [(i, WORD.findall(t)) for i, t in given(docs)]
    n = Counter(tuple(w[k : k + window]) for _, w in rows for k in range(len(w) - window + 1))
    want = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if n[tuple(w[k : k + window])] > 1:
                gone |= {*range(k, k + window)}
        want.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    out = substring_dedup.remove_repeated_windows(docs, window=window).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, bytes(r.kept)) for r in out) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in out)


def cut_strings(rows, length):
    last = 1 << 62
    first = defaultdict(lambda: last + 1)
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(first[t[k : k + length]], last if i is None else i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < (last if i is None else i):
                gone[k : k + length] = b"\1" * length
        out.append((str(i), len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [50])
def test_strings(docs, length):
    out = suffix_dedup.remove_repeated_strings(docs, length=length).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == cut_strings(given(docs), length)


def test_strings_in_pieces(monkeypatch):
    """A text longer than a piece has the same runs' strings, whatever the pieces."""
    b = np.random.default_rng(0).integers(97, 101, 5000).astype(np.uint8)
    whole = suffix_dedup.runs(b, np.array([0, len(b)]), 50)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = suffix_dedup.runs(b, np.array([0, len(b)]), 50)
    starts = lambda x: sorted(k for s, e in zip(x[0], x[1]) for k in range(s, e))
    assert starts(whole) == starts(parts) == list(range(len(b) - 49))


def test_merged_transforms_sort_all_suffixes():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (60, 75, 61, 70, 60, 66)]
    strings += [strings[0][:10] + strings[1][5:60], strings[2]]
    ids = np.array([5, 3, 9, 1, 7, 7, 8, 2])
    shards = []
    for own in ([0, 1, 2], [3, 4, 5, 6, 7]):
        own = sorted(own, key=lambda k: strings[k])
        shards.append((suffix_dedup.transform([strings[k] for k in own], np.zeros(len(own), np.int64))[0], ids[own], own))
    bits = suffix_dedup.repeated([(x, y) for x, y, _ in shards], 50)
    for (_, _, own), found in zip(shards, bits):
        for k, b in zip(own, found.tolist()):
            want = {o for o in range(len(strings[k]) - 49) if any(ids[j] < ids[k] and strings[k][o : o + 50] in s for j, s in enumerate(strings))}
            assert {o for o in range(64) if b >> o & 1} == want


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz"])
def test_shared_strings_of_all_lengths(spark, letters):
    """Documents that share 24 to 60 bytes amid others; text is sent only where a side of the anchor agrees too."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows, common = [], {n: say(n) for n in range(24, 61)}
    for k, n in enumerate(common):
        rows += [(3 * k + j, f"{say(rng.randint(0, 60))}{common[n]}{say(rng.randint(0, 60))}") for j in range(3)]
    out = suffix_dedup.remove_repeated_strings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out) == cut_strings([(i, t.encode()) for i, t in rows], 50)


def test_anchors_that_meet_by_chance_send_no_text():
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for n, sent in ((30, False), (49, None), (50, True), (70, True)):
        common, chunks = say(n), []
        for c in range(2):
            chunks.append(pa.table({"chunk": pa.array([c] * 20, pa.int32()), "id": pa.array(range(20 * c, 20 * c + 20)), "th": pa.array([0] * 20), "text": [f"{say(40)}{common}{say(40)}" for _ in range(20)]}))
        entries = pa.concat_tables([suffix_dedup._entries(50, 1)(x) for x in chunks])
        several = sum(int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in suffix_dedup._resolve(entries)["send"].to_pylist())
        assert sent is None or (several > 0) == sent


def test_whole_characters_and_carried_columns(docs):
    out = suffix_dedup.remove_repeated_strings(docs, carry=["lang", "chunk"], characters=True).collect()
    assert len(out) == docs.count()
    for r in out:
        bytes(r.kept).decode()
    assert {r.carry.c0 for r in out} == {None, "en"}


def fingerprint(text, words):
    w = WORD.findall(text.lower())
    s = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x, 42) >> k & 1 for x in s) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(s))


@pytest.mark.parametrize("words,distance", [(3, 2)])
def test_simhash(docs, words, distance):
    rows = [(i, fingerprint(t, words)) for i, t in given(docs)]
    out = simhash.near_duplicates(simhash.fingerprints(docs, words=words), distance).collect()
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in list(root):
        for b in list(root):
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = sorted((str(i), f, str(least.get(find(f)))) for i, f in rows)
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component)) for r in out) == want


def test_long_lists_are_looked_up():
    rng = np.random.default_rng(2)
    m = np.unique(rng.integers(0, 1 << 16, 500).astype(np.uint64) << np.uint64(8))
    free = np.arange(8, 24)
    a, b = simhash.list_links(m, 2, free)
    assert (np.bitwise_count(a ^ b) <= 64).all()
    from trapline.llm.components import local_roots

    i, j = np.nonzero(np.triu(np.bitwise_count(m[:, None] ^ m) <= 2, 1))
    want = local_roots(len(m), i, j)
    got = local_roots(len(m), np.searchsorted(m, a), np.searchsorted(m, b))
    assert np.array_equal(want, got)


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(2000, 2050)]
    from trapline.llm.components import local_roots

    nodes = sorted({x for e in links for x in e if e[0] != e[1]})
    at = {x: k for k, x in enumerate(nodes)}
    own = [e for e in links if e[0] != e[1]]
    root = local_roots(len(nodes), np.array([at[a] for a, _ in own]), np.array([at[b] for _, b in own]))
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {x: nodes[root[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nothing(no_docs):
    assert substring_dedup.remove_repeated_windows(no_docs).count() == 0
    assert suffix_dedup.remove_repeated_strings(no_docs).count() == 0
    assert simhash.near_duplicates(simhash.fingerprints(no_docs)).count() == 0


def test_words():
    buf, at = vec.text_buffer(pa.array(["a b", None, "", "c", " d\te "]))
    s, e, first = vec.word_spans(buf, at)
    raw = buf.tobytes()
    assert [raw[x:y] for x, y in zip(s, e)] == [b"a", b"b", b"c", b"d", b"e"] and first.tolist() == [0, 2, 2, 2, 3, 5]
    h = vec.slices_hash(buf, np.array([0, 2, 0]), np.array([1, 3, 3]))
    assert len(set(h.tolist())) == 3
