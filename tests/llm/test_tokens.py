"""Tokenizers and token files: exact against the libraries, round trips, damage."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from trapline.llm import bpe, pretoken, token_files, vec

ALPHABET = [*"aabcstmdrevl'' \n\t  .,!?12éñ漢½ 　’—XY", "'s", "'re", "'ll", " '", "\n\n", "🙂", "\x1c", "\x85"]


def samples():
    rng = random.Random(1)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, " " * 2000, "ab" * 1000 + "é" * 300, ""]


def test_split_is_the_pattern():
    texts, pattern = samples(), regex.compile(P.PATTERN)
    buf, at = vec.text_buffer(pa.array(texts))
    starts, first, exotic = pretoken.split(buf, at)
    ends, raw = np.append(starts[1:], len(buf)), buf.tobytes()
    assert 100 < exotic.sum() < len(texts)
    for i, t in enumerate(texts):
        if not exotic[i]:
            assert [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] == pattern.findall(t)


def test_bpe_is_tiktoken():
    texts = samples()
    ranks, enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    buf, at = vec.text_buffer(pa.array(texts))
    ids, counts = enc.encode(buf, at)
    upto = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == [want.encode_ordinary(t) for t in texts]
    assert ranks.decode(ids).tobytes() == buf.tobytes()


def test_long_and_short_trees_agree():
    ranks = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)[0]
    rng = random.Random(3)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdest") for _ in range(rng.randint(2, 64)))
        ids, live = ranks.lockstep([piece], 64)
        assert ids[live].tolist() == ranks.long(piece)


def test_cache_that_is_cleared():
    ranks = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)[0]
    small = pretoken.Encoder(ranks.encode, lambda t: [], slots=16, room=50)
    buf, at = vec.text_buffer(pa.array(["hello world again", "some other words here"] * 20))
    one = [small.encode(buf, at) for _ in range(3)]
    assert all(np.array_equal(one[0][0], x[0]) for x in one) and ranks.decode(one[2][0]).tobytes() == buf.tobytes()


def test_frames_hold():
    ids = np.array([5, 50256, 2])
    data = token_files.frame(None, ids, 2) + token_files.frame(-7, np.array([], int), 2)
    first = token_files.unframe(memoryview(data), 0)
    assert first[0] is None and first[1].tolist() == ids.tolist()
    assert token_files.unframe(memoryview(data), first[2])[0] == -7
    for k in range(len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        if k == first[2] - 1:
            continue  # the closing byte isn't data
        with pytest.raises(token_files.Damaged):
            at = 0
            while at < len(bad):
                at = token_files.unframe(memoryview(bad), at)[2]


def test_files(spark, docs, no_docs, tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    token_files.write(docs, str(tmp_path / "t"))
    out = token_files.read(spark, str(tmp_path / "t")).collect()
    want = sorted(str((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in docs.select("doc_id", "text").collect())
    assert sorted(str((r.id, r.ids)) for r in out) == want
    by_start = sorted(out, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.concatenate(([0], np.cumsum([r.n_tokens for r in by_start])))[:-1].tolist()
    ids = [r.id for r in by_start]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    some = spark.read.parquet(str(tmp_path / "t/index")).where("id in (3, 7)")
    assert sorted((r.id, r.start, zlib.crc32(np.array(r.ids, "<u4"))) for r in token_files.read_records(spark, str(tmp_path / "t"), some).collect()) == sorted((r.id, r.start, zlib.crc32(np.array(r.ids, "<u4"))) for r in out if r.id in (3, 7))
    token_files.write(no_docs, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_files_of_texts_with_an_added_token(spark, tmp_path):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["page end<|endoftext|>next page", "plain", "cut <|endof", "text|> here", "<|endoftext|><|endoftext|>", "é<|endoftext|>\x85", "last<|endoftext|>", ""]
    token_files.write(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1), str(tmp_path / "t"))
    got = sorted((r.id, r.ids, r.start) for r in token_files.read(spark, str(tmp_path / "t")).collect())
    want = [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert want[0] == [7700, 886, 50256, 19545, 2443, 2]
    assert got == [(i, x, sum(map(len, want[:i]))) for i, x in enumerate(want)]


def test_round_trip(docs, no_docs):
    out = bpe.round_trip(docs).collect()
    assert sorted((str(r.id), bytes(r.decoded)) for r in out) == sorted((str(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert bpe.round_trip(no_docs).count() == 0
