import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from iontide.llm import arrays as A  # noqa: E402
from iontide.llm import bpe_encoding, bytepair, packing, token_counts  # noqa: E402

PIECES = ["'s", "'re", "'", "'ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "!", "#", "_", "　", "\xa0", "日本", "🙂", "́", "<|endoftext|>", "don't", "'S", "\x1c", "\x85", "​", "aaaaaa", "\r\n", "the", "ing"]


@pytest.fixture(scope="module")
def libraries():
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def ids(encoder, texts):
    out = []
    for c in A.chunks(pa.array(texts, pa.string()), 500):
        found, edges = encoder.encode(c)
        out += [found[a:b].tolist() for a, b in zip(edges, edges[1:])]
    return out


def both():
    return (
        bytepair.Encoder(bytepair.ranks_vocabulary(P.path("byte_bpe_50k.tiktoken")), bytepair.segment_tree_merge),
        bytepair.Encoder(bytepair.merges_vocabulary(P.path("byte_bpe_50k.json")), bytepair.rank_synchronous_merge),
    )


def test_ids_equal_the_libraries(libraries):
    draw = random.Random(2)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 14))) for _ in range(3000)]
    texts += ["", "x" * 3000, "ab" * 2000, " " * 900, "".join(draw.choices("abcde", k=4000))]
    tree, synchronous = both()
    assert ids(tree, texts) == [libraries[0].encode_ordinary(t) for t in texts]
    assert ids(synchronous, texts) == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    for encoder in both():
        for t, own in zip(texts, ids(encoder, texts)):
            assert encoder.vocabulary.decode(np.array(own, np.int64)).tobytes() == t.encode()


def test_a_full_cache_starts_again(libraries, monkeypatch):
    monkeypatch.setattr(bytepair, "POOL_ROOM", 10)
    texts = [f"word{i} again" for i in range(300)]
    assert ids(both()[0], texts) == [libraries[0].encode_ordinary(t) for t in texts]


def test_patterned_and_long_pre_tokens(libraries):
    letters = lambda n, first: "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))
    draw = random.Random(5)
    texts = [letters(2048, 0), letters(2048, 1), letters(2048, 0), "".join(draw.choices("abcdefghij", k=60000)), "a" * 30001, "".join(draw.choices("日本語が", k=9000)), "short " * 50]
    tree, synchronous = both()
    assert ids(tree, texts) == [libraries[0].encode_ordinary(t) for t in texts]
    assert ids(synchronous, texts) == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_of_different_pre_tokens(libraries, monkeypatch):
    """The cache compares bytes: it stays right where all hashes of a length are equal."""
    monkeypatch.setattr(A, "slice_hasher", lambda data: lambda start, end: (end - start).astype(np.uint64) << np.uint64(50))
    draw = random.Random(7)
    texts = [" ".join(draw.choices(["one", "two", "six", "window", "hidden", "extraordinary", "international"], k=20)) for _ in range(40)]
    tree, synchronous = both()
    assert ids(tree, texts) == [libraries[0].encode_ordinary(t) for t in texts]
    assert ids(synchronous, texts) == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_queries_digests_and_round_trip(spark, docs, texts, libraries):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe_encoding.digests(docs.select("doc_id", "text"), path).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        true = np.array(libraries[0].encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(true), hashlib.sha256(true.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = bpe_encoding.decode(bpe_encoding.encode(docs.select("doc_id", "text"), path), path)
    assert all(r.bytes.decode() == (texts[r.doc_id] or "") for r in back.collect())


def test_token_counts(docs, texts, empty, libraries):
    out = token_counts.count_tokens(docs.withColumn("n_tokens", F.lit("clash")), P.path("byte_bpe_50k.json"))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens_before", "n_bytes", "n_tokens", "over_limit"]
    assert out.filter("n_tokens_before = 'clash'").count() == len(texts) + 1
    for r in out.collect():
        t = texts[r.doc_id] or ""
        n = len(libraries[1].encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert token_counts.count_tokens(empty, P.path("byte_bpe_50k.json")).count() == 0


@given(st.integers(1, 9000))
def test_cuts_fill_their_slots(n):
    pieces = packing.cut(n)
    assert sum(p for p, _ in pieces) == n
    for length, k in pieces:
        assert length * max(k, 1) <= packing.CAPACITY
        assert k or length < packing.CAPACITY // (packing.CLASSES - 1)


def test_packing_holds_every_id_once(docs, texts, empty, libraries):
    rows = packing.pack(docs, P.path("byte_bpe_50k.json"), with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for i, t in enumerate(texts):
        own = [*libraries[1].encode(t or "", add_special_tokens=False).ids, 1]
        copies = 2 if i == 5 else 1
        parts = sorted(pieces[i], key=lambda r: r.start)
        assert sum(p.length for p in parts) == copies * len(own) and all(p.doc_tokens == len(own) for p in parts)
        if copies == 1:
            assert [x for p in parts for x in p.ids] == own
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert sum(p.length for p in parts) <= 2048
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_little_padding():
    packer, draw, used = packing.HarmonicPacker(0), random.Random(0), defaultdict(int)
    rows = []
    for i in range(3000):
        for length, k in packing.cut(draw.randint(1, 5000)):
            rows += packer.add(length, k, (length,))
    rows += packer.finish()
    for length, sequence, _ in rows:
        used[sequence] += length
    assert 1 - sum(used.values()) / (2048 * len(used)) < 0.01
