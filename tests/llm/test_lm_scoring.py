import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from iontide.llm import lm_scoring as m


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_filter_gives_levels_back():
    keys = m.A.mix(np.arange(1, 5001, dtype=np.uint64))
    counts = np.random.default_rng(0).zipf(1.5, 5000).clip(1, 10**6)
    bits = m.build_filter(keys, counts)
    start, length = np.zeros(5000, np.int64), np.full(5000, len(bits))
    levels = m.probe(bits, start, length, keys)
    assert (levels >= m.level_of(counts)).all() and (levels == m.level_of(counts)).mean() > 0.9
    assert (m.probe(bits, start, length, m.A.mix(keys + np.uint64(10**9))) == 0).mean() > 0.9


@pytest.mark.parametrize("shard_bytes", [m.SHARD_BYTES, 2000])
def test_scores_against_plain_counts(docs, texts, shard_bytes):
    marked = docs.withColumn("held_out", m.held_out())
    model = m.BloomLanguageModel.fit(marked.filter("not held_out"), shard_bytes=shard_bytes)
    assert (len(model.shards) > 1) == (shard_bytes == 2000)
    rows = model.score(marked.select("doc_id", "held_out", "text")).collect()
    assert len(rows) == len(texts) + 1
    train = [i for i in [*range(len(texts)), 5] if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(t for i in train for t in tokens(texts[i]))
    n, v = sum(c.values()), len(c)
    assert (model.n_tokens, model.n_words) == (n, v)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.n_tokens == len(own) and r.n_known == sum(t in c for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_training_texts_are_likelier_than_the_base(docs):
    model = m.BloomLanguageModel.fit(docs)
    row = model.score(docs.select("doc_id", "text")).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b


def test_empty_tables(docs, empty):
    assert m.BloomLanguageModel.fit(docs).score(empty).count() == 0
    rows = m.BloomLanguageModel.fit(empty).score(docs.limit(3).select("doc_id", "text")).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in rows)


def test_columns_of_any_name_stay(docs):
    model = m.BloomLanguageModel.fit(docs)
    out = model.score(docs.select("doc_id", "text", F.lit("mine").alias("score"), F.lit(3).alias("N_TOKENS")))
    assert out.columns == ["doc_id", "score_before", "N_TOKENS_before", "n_tokens", "n_known", "base_score", "score"]
    assert out.filter("score_before = 'mine' and N_TOKENS_before = 3 and score <= 0").count() == docs.count()


def test_scores_against_plain_levels(docs, texts):
    """Scores by the formula of the docstring, from exact counts quantised to levels; the filter may only raise a level."""
    model = m.BloomLanguageModel.fit(docs)
    train = [tokens(texts[i]) for i in [*range(len(texts)), 5]]
    c, pairs = Counter(t for x in train for t in x), Counter(p for x in train for p in zip([None, *x[:-1]], x))
    values = m.level_values()
    value = lambda n: float(values[int(m.level_of(np.array([n]))[0])]) if n else 0.0
    floor, close = sum(c.values()) + len(c) + 1, 0
    rows = model.score(docs.select("doc_id", "text")).collect()
    for r in rows:
        own, true = tokens(texts[r.doc_id]), 0.0
        for v, w in zip([None, *own[:-1]], own):
            lower, context = (value(c[w]) + 1) / floor, value(c[v])
            true += math.log10((min(value(pairs[v, w]), context) + m.PRIOR * lower) / (context + m.PRIOR))
        close += abs(r.score - true) <= 0.02 * abs(true) + 1e-6
    assert close >= 0.95 * len(rows)
