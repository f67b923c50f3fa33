"""Language-model scores from a log-frequency Bloom filter.

The filter holds the quantised counts of all words and word pairs of the training
texts.  A count c has the level ``1 + floor(log(c) / log(BASE))``; the filter holds the
pairs (n-gram, 1) ... (n-gram, level), so probing the levels upwards until a probe
fails gives the level back, never too low and rarely too high.  Pair probabilities
back off to word probabilities by Dirichlet smoothing::

    p(w | v) = (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR)      p(w) = (c(w) + 1) / (N + V + 1)

Counting: each task tallies the n-gram hashes of its texts with numpy and sends every
hash range ("part") one packed row; the task that owns a part sums them and builds the
part's slice of the filter.  No n-gram is a row of its own, and no key is hot.

Broadcasting: parts are joined into shards of at most ``SHARD_BYTES`` each, which bounds
every broadcast and what a worker holds, however large the corpus; a scoring task takes
the shards one after the other over the n-grams of its texts, the more texts at once the more
shards there are (at most PASSES times TOKEN_ROOM tokens).  Besides the filter's
slice, a part has the exact word counts that the base score needs.

Levels stand for the mean of their counts, so the p(w | v) of one v sum to about 1, not to 1.

Edge cases: a null text is an empty text (one end token); empty training data give
N = V = 0 and scores of log10(1/1) = 0 for the base; repeated rows are scored and counted
once each; a null doc_id is never held out; further columns are kept by
``score``, a column `x` named like a new one as `x_before`.
Words are told apart by 64-bit hashes: with V words the expected number of merged pairs
is V * V / 2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .frames import apart, ddl
from .storage import Stored, read, shuffle_partitions

#: Base of the logarithm that counts are quantised by.
BASE = 1.5
#: Bits of the filter for each (n-gram, level), and bits set by each.
BITS_EACH, PROBES = 10, 4
#: Weight of the word model within the pair model, in words.
PRIOR = 400.0
#: Most bytes of one broadcast.
SHARD_BYTES = 32 << 20
#: A task sends what it has tallied at this many n-grams, and scores this many tokens at a time.
TALLY_ROOM, TOKEN_ROOM = 1_000_000, 300_000
#: Shards beyond which texts in one pass no longer grow: what a worker holds of them is bounded, too.
PASSES = 4

END = np.uint64(0xE9D_0F_7E47)

_COUNTS = "part int, words binary, word_counts binary, pairs binary, pair_counts binary"
_PARTS = "part int, words binary, word_counts binary, bits binary, n_words long, n_tokens long, n_bytes long"


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_values(levels: int = 120) -> np.ndarray:
    """The mean of the counts of each level; 0 for level 0."""
    low = np.ceil(BASE ** (np.arange(levels) - 1.0) - 1e-9)
    high = np.ceil(BASE ** np.arange(levels) - 1e-9) - 1
    out = (low + np.maximum(low, high)) / 2
    out[0] = 0
    return out


def _place(keys: np.ndarray, level: np.ndarray | int, n_words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of the filter and the bits in it, of each (key, level)."""
    h = A.mix(keys + np.asarray(level, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    word = ((h >> np.uint64(32)) * np.asarray(n_words, np.uint64)) >> np.uint64(32)
    bits = np.zeros(len(h), np.uint64)
    for k in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return word.astype(np.int64), bits


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    levels = level_of(counts)
    n_words = max(1, math.ceil(int(levels.sum()) * BITS_EACH / 64))
    out = np.zeros(n_words, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        at, bits = _place(keys[levels >= level], level, n_words)
        np.bitwise_or.at(out, at, bits)
    return out


def probe(words: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each key, by probing upwards; start and length: the key's slice of ``words``."""
    levels = np.zeros(len(keys), np.int64)
    live = np.flatnonzero(length > 0)
    level = 1
    while len(live):
        at, bits = _place(keys[live], level, length[live])
        live = live[(words[start[live] + at] & bits) == bits]
        levels[live] = level
        level += 1
    return levels


def tokens(chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and, after each text's words, its end; the token before each; the text of each."""
    data = A.LOWER[chunk.data]
    start, end = chunk.words()
    words = A.slice_hasher(data)(start, end)
    n = chunk.counts(chunk.doc_of(start)).astype(np.int64)
    last = np.cumsum(n + 1) - 1
    hashes = np.full(len(words) + chunk.n, END, np.uint64)
    body = np.ones(len(hashes), bool)
    body[last] = False
    hashes[body] = words
    before = np.concatenate(([END], hashes[:-1])) if len(hashes) else hashes
    return hashes, before, np.repeat(np.arange(chunk.n), n + 1)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _packed(words, pairs, parts: int) -> pa.RecordBatch:
    """One row for each part; keys are sorted, so a part is a slice."""
    edges = [np.searchsorted(part_of(k, parts), np.arange(parts + 1)) for k, _ in (words, pairs)]
    column = lambda a, at: pa.array([a[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(range(parts), pa.int32()), *(column(a, at) for (keys, counts), at in zip((words, pairs), edges) for a in (keys, counts.astype(np.uint32)))],
        ["part", "words", "word_counts", "pairs", "pair_counts"],
    )


def _count(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def merged():
            return [A.tally(np.concatenate([k for k, _ in x]), np.concatenate([c for _, c in x])) for x in held]

        for batch in batches:
            for chunk in A.chunks(batch.column(0), 2 << 20):
                hashes, before, _ = tokens(chunk)
                for x, keys in zip(held, (hashes, A.combine(before, hashes))):
                    x.append(A.tally(keys))
                if sum(len(k) for k, _ in held[1]) > TALLY_ROOM:
                    yield _packed(*merged(), parts)
                    held = [[], []]
        if held[0]:
            yield _packed(*merged(), parts)

    return run


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of each part that this task owns, summed, with the part's slice of the filter."""
    rows: dict[int, list] = {}
    for batch in batches:
        for part, *cells in zip(*(batch.column(i).to_pylist() for i in range(5))):
            rows.setdefault(part, []).append(cells)
    for part in sorted(rows):
        cells = list(zip(*rows.pop(part)))
        gather = lambda i, kind: np.frombuffer(b"".join(cells[i]), kind)
        words, word_counts = A.tally(gather(0, np.uint64), gather(1, np.uint32).astype(np.int64))
        pairs, pair_counts = A.tally(gather(2, np.uint64), gather(3, np.uint32).astype(np.int64))
        bits = build_filter(np.concatenate((words, pairs)), np.concatenate((word_counts, pair_counts)))
        out = [part, words.tobytes(), word_counts.astype(np.uint32 if word_counts.max(initial=0) < 1 << 32 else np.int64).tobytes(), bits.tobytes(), len(words), int(word_counts.sum())]
        out.append(sum(len(x) for x in out[1:4]))
        yield pa.RecordBatch.from_arrays([pa.array([x]) if i else pa.array([x], pa.int32()) for i, x in enumerate(out)], ["part", "words", "word_counts", "bits", "n_words", "n_tokens", "n_bytes"])


class Shard:
    """Some neighbouring parts: the filter's slices and the exact word counts."""

    def __init__(self, low: int, rows: list):
        self.low, self.high = low, low + len(rows)
        lengths = [len(r["bits"]) // 8 for r in rows]
        self.length = np.array(lengths, np.int64)
        self.start = np.cumsum([0, *lengths[:-1]])
        self.bits = np.concatenate([np.frombuffer(r["bits"], np.uint64) for r in rows])
        self.words = np.concatenate([np.frombuffer(r["words"], np.uint64) for r in rows])
        counts = [np.frombuffer(r["word_counts"], np.uint32 if len(r["word_counts"]) == 4 * r["n_words"] else np.int64) for r in rows]
        self.counts = np.concatenate(counts)

    def levels(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        return probe(self.bits, self.start[part - self.low], self.length[part - self.low], keys)

    def exact(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, keys), max(0, len(self.words) - 1))
        return np.where(self.words[at] == keys, self.counts[at], 0) if len(self.words) else np.zeros(len(keys), np.int64)


def _value(broadcast, keep: bool) -> Shard:
    """A broadcast's value; one of several isn't kept in the worker after its use."""
    value = broadcast.value
    if not keep:
        vars(broadcast).pop("_value", None)
    return value


class BloomLanguageModel:
    """Fit on texts, then score texts.

    ``fit`` takes any DataFrame with a string column; ``score`` adds n_tokens, n_known,
    base_score and score to the columns of a DataFrame.
    """

    def __init__(self, parts: int, shards: list, n_tokens: int, n_words: int):
        self.parts, self.shards, self.n_tokens, self.n_words = parts, shards, n_tokens, n_words

    @classmethod
    def fit(cls, texts: DataFrame, column: str = "text", shard_bytes: int = SHARD_BYTES) -> BloomLanguageModel:
        spark: SparkSession = texts.sparkSession
        n = shuffle_partitions(spark)
        parts = max(256, 4 * n)
        counted = texts.select(F.col(column)).mapInArrow(_count(parts), _COUNTS)
        stored = Stored(counted.repartition(n, "part").mapInArrow(_build, _PARTS), "lm-parts")
        sizes = stored.frame.select("part", "n_words", "n_tokens", "n_bytes").orderBy("part").collect()
        shards = []
        for low, high in _ranges([r["n_bytes"] for r in sizes], shard_bytes):
            rows = stored.frame.filter(F.col("part").between(sizes[low]["part"], sizes[high - 1]["part"])).collect()
            shards.append(spark.sparkContext.broadcast(Shard(low, sorted(rows, key=lambda r: r["part"]))))
            del rows
        stored.discard()
        return cls(parts, shards, sum(r["n_tokens"] for r in sizes), sum(r["n_words"] for r in sizes))

    def score(self, texts: DataFrame, column: str = "text") -> DataFrame:
        added = ["n_tokens long", "n_known long", "base_score double", "score double"]
        kept = apart(texts.drop(column), [a.split()[0] for a in added])
        keep, schema = kept.columns, ", ".join([*ddl(kept, kept.columns), *added])
        texts = texts.select(*(c for c in texts.columns if c != column), column)
        return texts.toDF(*keep, "text").mapInArrow(_score(self.parts, self.shards, self.n_tokens, self.n_words, len(keep)), schema)


def _ranges(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    low = total = 0
    for i, size in enumerate(sizes):
        if i > low and total + size > limit:
            yield low, i
            low, total = i, 0
        total += size
    if low < len(sizes):
        yield low, len(sizes)


def _score(parts: int, shards: list, n_tokens: int, n_words: int, n_keep: int):
    values = level_values()
    floor = n_tokens + n_words + 1

    def lookup(hashes: np.ndarray, before: np.ndarray):
        """Exact counts and levels of the words, levels of the pairs, by shard."""
        exact = np.zeros(len(hashes), np.int64)
        word_level, pair_level = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        words, index = np.unique(hashes, return_inverse=True)
        own_exact, own_level = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        pairs = A.combine(before, hashes)
        word_part, pair_part = part_of(words, parts), part_of(pairs, parts)
        for broadcast in shards:
            shard = _value(broadcast, len(shards) == 1)
            at = np.flatnonzero((word_part >= shard.low) & (word_part < shard.high))
            own_exact[at] = shard.exact(words[at])
            own_level[at] = shard.levels(words[at], word_part[at])
            at = np.flatnonzero((pair_part >= shard.low) & (pair_part < shard.high))
            pair_level[at] = shard.levels(pairs[at], pair_part[at])
            del shard
        exact, word_level = own_exact[index], own_level[index]
        return exact, word_level, pair_level

    def scored(group: list[A.Chunk]) -> list[np.ndarray]:
        found = [tokens(c) for c in group]
        shift = np.cumsum([0, *(c.n for c in group)])
        hashes, before = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        docs = np.concatenate([f[2] + s for f, s in zip(found, shift)])
        exact, word_level, pair_level = lookup(hashes, before)
        lower = (values[word_level] + 1) / floor
        level_before = np.concatenate((word_level[-1:], word_level[:-1]))
        level_before[before == END] = word_level[hashes == END][0]
        context = values[level_before]
        p = (np.minimum(values[pair_level], context) + PRIOR * lower) / (context + PRIOR)
        total = int(shift[-1])
        return [np.bincount(docs, w, total) for w in (None, (exact > 0) * 1.0, np.log10((exact + 1) / floor), np.log10(p))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group: list[A.Chunk] = []
            size, low = 0, 0
            out: list[list[np.ndarray]] = []

            for chunk in A.chunks(batch.column(n_keep), 2 << 20):
                group.append(chunk)
                size += len(chunk.data)
                if size > 5 * TOKEN_ROOM * min(len(shards), PASSES):
                    out.append(scored(group))
                    group, size = [], 0
            if group:
                out.append(scored(group))
            if not out:
                continue
            a, b, c, d = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_keep)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c), pa.array(d)],
                [*(batch.schema.names[:n_keep]), "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), "text")
    model = BloomLanguageModel.fit(docs.filter(~F.col("held_out")))
    return model.score(docs).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
