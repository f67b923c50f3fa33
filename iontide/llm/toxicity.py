"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled documents, score every text.  Each interpolates
pairs and words with absolute discounting, as Kneser and Ney do::

    p(w | v) = max(N(v w) - D, 0) / N(v .) + (what the discounts leave) * p(w)
    p(w)     = max(N(. w) - d, 0) / N(. .) + (what the discounts leave) * q(w)

N(v w) counts the pairs of the class, v being the word before w; N(. w) is the number of distinct words
before w in the class, so copies, repeated lines and shared passages count once there.  d and D are n1 / (n1 + 2 n2)
as usual, of the numbers of words with one and two contexts and of pairs seen once and twice (D: in the smaller class,
for both).  The backoff q is shared by the models: it follows the counts that the
classes have in common, 2 * min(N(. w)) + 1, and is tiny for a word that no class has, so a rare
expression is alike in both.

A text has two measures: the log-likelihood ratio by p(w | v), summed over all its tokens and normalised by their number,
and the mean of its STRONGEST ratios by p(w), which a few toxic words raise in a text of any length, where they
vanish in the mean over all.  Their weights are those of a logistic regression, at least 0, and a rising curve maps the sum to (0, 1).

Learning takes all labelled documents up to TRAIN_ROWS of each label (a documented bound; the ids are
the only broadcast of the fit).  Counts of the label with more rows are scaled to the rows of the
other, so discounts leave both alike.  Words are hashed into 2**WORD_BITS slots.  What is
broadcast to score are log ratios: two per slot and those of the pairs that exceed D in a class, which are as many as the
bounded sample has at most.  A quarter of the sample gives weights and curve, the rest the counts.  The curve's prior is the share of toxic texts that
PRIOR assumes.  Scoring reads every text whole and has no exchange; a score depends on its text and the model alone.

Edge cases: a null or empty text has no evidence and gets the score of a difference of 0;
without labels of both kinds every score is 0; repeated rows each give a row; a score equal to
CUT is toxic; further columns are kept by ``score``, a column `x` named like a new one as
`x_before`; a document with labels 0 and 1 is toxic; a null doc_id has no label; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .frames import apart, rows_where, with_text_columns
from .storage import read
from .tallies import labelled_sample, tallied, unpack

#: At most so many labelled documents of each label.
TRAIN_ROWS = 20_000
WORD_BITS, PART_BITS = 20, 6
#: One of so many sampled rows is left out of the counts, for the curve.
CALIBRATE = 4
#: The share of toxic texts that scores assume.
PRIOR = 0.2
CUT = 0.7
#: So many largest log ratios make the mean of the strongest (those a text lacks are 0).
STRONGEST = 4

_WORDS = 1 << WORD_BITS
#: In keys, the place of the class, above (slot, word before).
_CLASS = np.uint64(2 * WORD_BITS)
_PART = _CLASS - np.uint64(PART_BITS)


def discount(n: np.ndarray) -> float:
    """Kneser and Ney's estimate from the words with one and with two contexts (counts may be scaled by their least)."""
    seen = np.round(n[n > 0] / n[n > 0].min(initial=np.inf))
    one, two = (seen == 1).sum(), (seen == 2).sum()
    return float(one / max(one + 2 * two, 1)) * n[n > 0].min(initial=1)


def tokens(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the lower-case words of all texts, of the word before each (0 at the start), and the text of each."""
    data = A.LOWER[chunk.data]
    start, end = chunk.runs(A.WORDLIKE)
    doc = chunk.doc_of(start)
    words = (A.slice_hasher(data)(start, end) >> np.uint64(64 - WORD_BITS)).astype(np.uint32)
    before = np.append(np.uint32(0), words[:-1])[: len(words)]
    before[np.append(True, doc[1:] != doc[:-1])[: len(words)]] = 0
    return words, before, doc


def smoothed(counts: np.ndarray) -> list[np.ndarray]:
    """The probabilities of slots in both classes: what exceeds the discounts, and the shared share of the rest."""
    common = 2 * counts.min(0) + np.where((counts > 0).any(0), 1, 0.1)
    shared = common / common.sum()
    out = []
    for n in counts:
        total = max(n.sum(), 1)
        kept = np.maximum(n - discount(n), 0)
        out.append((kept + (total - kept.sum()) * shared) / total)
    return out


def weights(label: np.ndarray, measures: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of the measures by a logistic regression in which both labels weigh alike, none below 0; 1 each where a label is missing."""
    count = np.array([(label == k).sum() for k in (0, 1)])
    if not count.all():
        return np.ones(len(measures))
    weight = np.where(label == 1, 1, count[1] / count[0])
    spread = np.maximum(measures.std(1), 1e-9)
    used = np.arange(len(measures))
    while True:
        x = np.vstack(((measures[used] - measures[used].mean(1, keepdims=True)) / spread[used, None], np.ones(len(label))))
        beta = np.zeros(len(x))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
            slope = x @ (weight * (label - p)) - ridge * beta
            beta += np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + ridge * np.eye(len(x)), slope)
        own = beta[:-1] / spread[used]
        if (own > 0).all() or len(used) == 1:
            out = np.zeros(len(measures))
            out[used] = np.maximum(own, 1e-9)
            return out
        used = used[own > 0] if (own > 0).any() else used[-1:]


class Counts:
    """Continuation counts of words in both classes on the driver, as arrays of fixed size; index 0: ordinary, 1: toxic.

    rows: labelled documents of each class."""

    def __init__(self, rows: tuple[int, int]):
        self.scale = np.array([min(rows) / max(n, 1) for n in rows])
        self.before = np.zeros((2, _WORDS))
        # Pairs by the part of their words, so that few are unpacked at a time; how many of each class occur once and twice.
        self.after, self.rare = np.zeros((2, _WORDS)), np.zeros((2, 2), np.int64)
        self.pairs: dict[int, list[list[tuple[np.ndarray, np.ndarray]]]] = {}

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Distinct (class, slot, word before), and how often each occurs (once where that isn't given)."""
        counts = np.ones(len(keys), np.uint32) if counts is None else counts.astype(np.uint32)
        part = keys >> _PART
        for one in np.unique(part):
            own = part == one
            k, place = divmod(int(one), 1 << PART_BITS)
            pair, n = (keys[own] & ((np.uint64(1) << _CLASS) - np.uint64(1))).astype(np.int64), counts[own]
            np.add.at(self.before[k], pair >> WORD_BITS, 1)
            np.add.at(self.after[k], pair & (_WORDS - 1), n)
            self.rare[k] += (n == 1).sum(), (n == 2).sum()
            self.pairs.setdefault(place, [[], []])[k].append((pair, n))

    def closed(self) -> Model:
        words = smoothed(self.before * self.scale[:, None])
        # The discount is in counts of the smaller class, to which those of the other are scaled.
        one, two = self.rare[int(self.scale[1] == 1)]
        less = one / max(one + 2 * two, 1) / self.scale
        left = self.after.copy()
        for place, own in self.pairs.items():
            for k, parts in enumerate(own):
                pair, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                more = n > less[k]
                own[k] = pair[more], (n[more] - less[k]).astype(np.float32)
                np.subtract.at(left[k], own[k][0] & (_WORDS - 1), own[k][1])
        left = np.where(self.after > 0, np.maximum(left, 1e-9) / np.maximum(self.after, 1), 1)
        ratio = lambda x: (np.log(x[1]) - np.log(x[0])).astype(np.float32)
        keys, ratios = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for place in sorted(self.pairs):
            own = self.pairs.pop(place)
            keys.append(np.unique(np.concatenate([pair for pair, _ in own])))
            w, v = keys[-1] >> WORD_BITS, keys[-1] & (_WORDS - 1)
            likely = []
            for k, (pair, kept) in enumerate(own):
                above = np.zeros(len(w))
                above[np.searchsorted(keys[-1], pair)] = kept
                likely.append(above / np.maximum(self.after[k][v], 1) + left[k][v] * words[k][w])
            ratios.append(ratio(likely))
        return Model(ratio(words), ratio(left), np.concatenate(keys), np.concatenate(ratios))


class Model:
    """Log ratios (toxic over ordinary): of words, of what the discounts leave after a word, and of pairs (word, word before)."""

    def __init__(self, words: np.ndarray, left: np.ndarray, keys: np.ndarray, pairs: np.ndarray):
        self.words, self.left, self.keys, self.pairs = words, left, keys, pairs
        self.weights = np.ones(2)
        self.curve = None

    def measures(self, chunk: A.Chunk) -> np.ndarray:
        """Of each text, the log-likelihood ratio by p(w | v), normalised by all its tokens, and the mean of the largest log
        ratios by p(w) of its different pairs (a repeated pair says nothing new)."""
        words, before, doc = tokens(chunk)
        pair = words.astype(np.int64) << WORD_BITS | before
        ratio = self.words[words] + self.left[before]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[at] == pair
            ratio[known] = self.pairs[at[known]]
        whole = chunk.counts(doc, ratio) / np.maximum(chunk.counts(doc), 1)
        _, once = np.unique(doc << (2 * WORD_BITS) | pair, return_index=True)
        doc, ratio = doc[once], self.words[words[once]]
        order = np.lexsort((-ratio, doc))
        doc, ratio = doc[order], ratio[order]
        largest = np.arange(len(doc)) - np.searchsorted(doc, doc) < STRONGEST
        return np.stack((whole, chunk.counts(doc[largest], ratio[largest]) / STRONGEST))

    def differences(self, chunk: A.Chunk) -> np.ndarray:
        return self.weighed(self.measures(chunk))

    def weighed(self, measures: np.ndarray) -> np.ndarray:
        # Not a matrix product: its rounding depends on how many texts are together.
        return self.weights[0] * measures[0] + self.weights[1] * measures[1]

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
        sample = labelled_sample(labels, "toxic", rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(CALIBRATE)))
        marked = docs.join(F.broadcast(sample), "doc_id").select("label", "fold", "text")

        def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            label = np.asarray(batch.column(0).to_pylist(), np.uint64)
            for chunk in A.chunks(batch.column(1)):
                words, before, doc = tokens(chunk)
                yield label[chunk.rows.start : chunk.rows.stop][doc] << _CLASS | words.astype(np.uint64) << np.uint64(WORD_BITS) | before.astype(np.uint64)

        rows_of = {r["label"]: r["count"] for r in sample.filter("fold > 0").groupBy("label").count().collect()}
        gathered, classes = Counts((rows_of.get(0, 0), rows_of.get(1, 0))), set()
        for row in tallied(marked.filter("fold > 0").select("label", "text"), keys_of, lambda k: (k >> _PART).astype(np.int64)).toLocalIterator():
            keys, counts = unpack(row)
            classes.update((keys[[0, -1]] >> _CLASS).tolist())
            gathered.add(keys, counts)
        if classes != {0, 1}:
            return None
        model = gathered.closed()
        del gathered
        unseen = marked.filter("fold = 0").select("label", "text")
        shared = docs.sparkSession.sparkContext.broadcast(model)
        rest = _with(unseen, shared, "whole double, strongest double", lambda m, c: list(m.measures(c))).select("label", "whole", "strongest").toArrow()
        shared.destroy()
        label, measures = np.asarray(rest["label"]), np.stack([np.asarray(rest[c]) for c in ("whole", "strongest")])
        model.weights = weights(label, measures)
        model.calibrate(label, model.weighed(measures))
        return model

    def calibrate(self, label: np.ndarray, x: np.ndarray, prior: float = PRIOR) -> None:
        """A rising curve through the shares of toxic rows in bins of x: one below all toxic rows, the others with equally many.

        Shares that fall are pooled with their neighbours; label 1 weighs as much as the prior says.
        """
        toxic, other = np.sort(x[label == 1]), np.sort(x[label == 0])
        if not len(toxic) or not len(other):
            return
        n = int(np.clip(len(toxic) // 6, 2, 100))
        edges = np.unique(np.quantile(toxic, np.linspace(0, 1, n + 1)))[:-1]
        if not len(edges):
            edges = toxic[:1]
        ones = np.histogram(toxic, [-np.inf, *edges, np.inf])[0] + 0.5
        zeros = np.histogram(other, [-np.inf, *edges, np.inf])[0] + 0.5
        ones, zeros = ones * prior / ones.sum(), zeros * (1 - prior) / zeros.sum()
        middle = np.concatenate(([min((other[0] + edges[0]) / 2, edges[0])], (edges[1:] + edges[:-1]) / 2, [(edges[-1] + toxic[-1]) / 2]))
        blocks: list[list[float]] = []
        for a, b, m in zip(ones, zeros, middle):
            blocks.append([a, b, m * (a + b)])
            while len(blocks) > 1 and blocks[-1][0] / sum(blocks[-1][:2]) <= blocks[-2][0] / sum(blocks[-2][:2]):
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
        at = np.array([c / (a + b) for a, b, c in blocks])
        share = np.array([a / (a + b) for a, b, _ in blocks])
        low, high = min(x.min(), at[0]) - 1, max(x.max(), at[-1]) + 1
        self.curve = np.concatenate(([low], at, [high])), np.concatenate(([0.0], share, [1.0]))

    def probability(self, difference: np.ndarray) -> np.ndarray:
        """Where there was nothing to learn the curve from, a steep logistic one around 0."""
        if self.curve is None:
            return 1 / (1 + np.exp(-np.clip(20 * difference, -40, 40)))
        return np.interp(difference, *self.curve)

    def scores(self, chunk: A.Chunk) -> np.ndarray:
        return self.probability(self.differences(chunk))

    def score(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """score and predicted in place of each text."""

        def values(model: Model, chunk: A.Chunk) -> list:
            score = model.scores(chunk)
            return [score, (score >= CUT).astype(np.int32)]

        return _with(docs, docs.sparkSession.sparkContext.broadcast(self), "score double, predicted int", values, column)

    def kept(self, docs: DataFrame, column: str = "text") -> DataFrame:
        """The rows that aren't toxic, as they are."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def make():
            model = shared.value
            return lambda chunk: model.scores(chunk) < CUT

        return rows_where(docs, column, make)


def _with(docs: DataFrame, shared, added: str, values, column: str = "text") -> DataFrame:
    def make():
        model = shared.value
        return lambda chunk: values(model, chunk)

    return with_text_columns(docs, column, added, make)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = Model.fit(docs.select("doc_id", "text"), labels)
    if model is None:
        return apart(docs.drop("text"), ["score", "predicted"]).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    return model.score(docs)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    return scored(docs, read(spark, sf_dir, "labels").filter(~held_out()))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, with their columns."""
    model = Model.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").filter(~held_out()))
    return docs if model is None else model.kept(docs)
