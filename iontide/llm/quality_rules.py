"""Quality rules: base counts of each text, and a likelihood ratio of hashed n-grams.

The words, signs and pairs of them in a text are hashed into BUCKETS.  Two multinomials over the
buckets, of the trusted documents (labelled quality 1) and of all documents, give each bucket
a log-likelihood ratio; a text's score is the mean over its n-grams and NEUTRAL more with a
ratio of 0, so length drops out and a few words alone prove little.
The threshold is fixed by labelled documents that the trusted multinomial hasn't seen: the
cut with the best balanced accuracy among those that keep at least KEEP of the trusted.

Raw counts cover all documents.  The trusted documents and those that fix the threshold are
a bounded sample (TRUSTED_ROWS of each label); only their ids are broadcast.  The model that
is broadcast has BUCKETS weights, whatever the corpus.

Edge cases: a null or empty text has no words and fails the base rules; without labels, or
if trusted documents are missing, all that pass the base rules are kept; repeated rows each
give a row and count once each; a score equal to the threshold is kept; a null doc_id has no
label; further columns are kept by ``annotate``, a column `x` named like a new one as
`x_before`; an empty table gives no rows and a model that keeps all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .frames import rows_where, with_text_columns
from .storage import read
from .tallies import labelled_sample, tallied, unpack

BUCKETS_BITS = 18
BUCKETS = 1 << BUCKETS_BITS
#: At most so many labelled rows of each label: half make the trusted multinomial, all others the threshold.
TRUSTED_ROWS = 20_000
#: The share of trusted documents that the threshold has to keep.
KEEP = 0.997
#: N-grams without evidence that each text's mean includes.
NEUTRAL = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Words in a window, for repeats.
WINDOW = 5
_PART_BITS = 12

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def base_counts(chunk: A.Chunk) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each text."""
    data = chunk.data
    start, end = chunk.words()
    doc = chunk.doc_of(start)
    per_text = lambda at: chunk.counts(chunk.doc_of(at)).astype(np.int64)
    n_words = chunk.counts(doc).astype(np.int64)
    word_chars = per_text(np.flatnonzero(~A.SPACE[data] & ((data & 0xC0) != 0x80)))
    n_symbols = per_text(np.flatnonzero(SYMBOLS[data]))
    hasher = A.slice_hasher(data)
    own = A.mix(np.arange(1, chunk.n + 1, dtype=np.uint64))

    line_end = np.flatnonzero(data == 10)
    line_start = np.append(0, line_end[:-1] + 1)[: len(line_end)]
    with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_doc = chunk.doc_of(line_start)
    keys = A.combine(own[line_doc], hasher(line_start, line_end))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order[1:]] == keys[order[:-1]]]
    n_dup_lines = chunk.counts(line_doc[again]).astype(np.int64)

    n_repeat = np.zeros(chunk.n, np.int64)
    if len(start) >= WINDOW:
        words = hasher(start, end)
        first = np.flatnonzero(doc[WINDOW - 1 :] == doc[: 1 - WINDOW])
    else:
        first = np.zeros(0, np.int64)
    if len(first):
        keys = A.combine(own[doc[first]], *(words[first + k] for k in range(WINDOW)))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        twice = first[order[np.append(same, False) | np.append(False, same)]]
        edges = np.zeros(len(start) + 1, np.int64)
        np.add.at(edges, twice, 1)
        np.add.at(edges, twice + WINDOW, -1)
        n_repeat = chunk.counts(doc[np.cumsum(edges[:-1]) > 0]).astype(np.int64)
    failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat, failed]


def features(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, signs and pairs of all texts, and the text of each."""
    data = A.LOWER[chunk.data]
    kind = np.where(A.SPACE[data], 0, np.where(A.WORDLIKE[data], 1, 2)).astype(np.int8)
    change = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    end = np.append(change[1:], len(data))
    real = kind[change] > 0
    start, end = change[real], end[real]
    hashes = A.slice_hasher(data)(start, end) if len(start) else np.zeros(0, np.uint64)
    doc = chunk.doc_of(start)
    paired = doc[1:] == doc[:-1]
    pairs = A.combine(hashes[:-1], hashes[1:])[paired]
    keys = np.concatenate((hashes, pairs)) >> np.uint64(64 - BUCKETS_BITS)
    return keys, np.concatenate((doc, doc[1:][paired]))


class LikelihoodRatio:
    """The weights of the buckets and the threshold."""

    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold

    def scores(self, chunk: A.Chunk) -> np.ndarray:
        keys, doc = features(chunk)
        n = chunk.counts(doc)
        return chunk.counts(doc, self.weights[keys.astype(np.int64)].astype(np.float64)) / (n + NEUTRAL)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> LikelihoodRatio:
        sample = labelled_sample(labels, "quality", rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)))
        marked = docs.join(F.broadcast(sample), "doc_id", "left").select(F.coalesce((F.col("label") == 1) & (F.col("half") == 0), F.lit(False)).alias("trusted"), "text")

        def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            trusted = np.asarray(batch.column(0).to_pylist(), bool)
            for chunk in A.chunks(batch.column(1)):
                keys, doc = features(chunk)
                yield keys
                yield keys[trusted[chunk.rows.start : chunk.rows.stop][doc]] | np.uint64(BUCKETS)

        counts = np.zeros(2 * BUCKETS)
        for row in tallied(marked, keys_of, lambda k: (k >> np.uint64(_PART_BITS)).astype(np.int64)).toLocalIterator():
            keys, n = unpack(row)
            counts[keys.astype(np.int64)] += n
        raw, target = counts[:BUCKETS], counts[BUCKETS:]
        if not target.sum():
            return cls(np.zeros(BUCKETS, np.float32), -np.inf)
        p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
        p_target = (target + BUCKETS * p_raw) / (target.sum() + BUCKETS)
        model = cls(np.log(p_target / p_raw).astype(np.float32), -np.inf)
        unseen = sample.filter((F.col("label") == 0) | (F.col("half") == 1)).select("doc_id", "label")
        scored = model.annotate(docs.join(F.broadcast(unseen), "doc_id").select("label", "text")).filter("not base_failed").select("label", "llr").toArrow()
        model.threshold = best_threshold(np.asarray(scored["label"]), np.asarray(scored["llr"]))
        return model

    def judge(self, chunk: A.Chunk) -> list[np.ndarray]:
        """The base counts, llr and kept of each text."""
        base, score = base_counts(chunk), self.scores(chunk)
        return [*base, score, ~base[-1] & (score >= self.threshold)]

    def _shared(self, docs: DataFrame) -> Callable[[], LikelihoodRatio]:
        shared = docs.sparkSession.sparkContext.broadcast((self.weights, self.threshold))
        return lambda: LikelihoodRatio(*shared.value)

    def annotate(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """The base counts, llr and kept in place of each text."""
        model = self._shared(docs)
        return with_text_columns(docs, column, f"{BASE}, llr double, kept boolean", lambda: model().judge)

    def kept(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """The rows that are kept, as they are."""
        model = self._shared(docs)

        def make():
            own = model()
            return lambda chunk: own.judge(chunk)[-1]

        return rows_where(docs, column, make)


def best_threshold(label: np.ndarray, score: np.ndarray, keep: float = KEEP) -> float:
    """The cut of best balanced accuracy that keeps that share of label 1; -inf if there are no such rows."""
    trusted = np.sort(score[label == 1])
    other = np.sort(score[label == 0])
    if not len(trusted):
        return -np.inf
    # Places between neighbouring scores of the trusted that lose few enough of them.
    cuts = trusted[: max(1, int((1 - keep) * len(trusted)))]
    if not len(other):
        return float(cuts[0])
    lost = np.searchsorted(trusted, cuts) / len(trusted)
    caught = np.searchsorted(other, cuts) / len(other)
    return float(cuts[np.argmax(caught - lost)])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return LikelihoodRatio.fit(docs, read(spark, sf_dir, "labels")).annotate(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their columns."""
    model = LikelihoodRatio.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return model.kept(docs)
