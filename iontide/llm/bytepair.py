"""Byte-pair merges of many pre-tokens at once, and the encoder around them.

Two engines apply the merges: ``segment_tree_merge`` (op2) and ``rank_synchronous_merge``
(op8, op4).  ``Encoder`` splits texts, looks pre-tokens up in a bounded cache and hands
the others to an engine.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cache

import numpy as np

from . import arrays as A
from . import pretokens

#: Rank of a pair that doesn't merge.
NEVER = np.uint32(0xFFFFFFFF)
#: Entries of the pre-token cache, and the most ids and bytes that it holds.
CACHE_SLOTS, POOL_ROOM = 1 << 20, 8 << 20
#: Most bytes of a batch of segment trees, and the least bytes of a pre-token that may be merged on its own.
TREE_BYTES, ALONE = 32 << 20, 1 << 10


class PairTable:
    """(left id, right id) -> (rank, merged id): open addressing, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        keys = self._key(left, right)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.rank, self.merged = np.full(1 << bits, NEVER), np.zeros(1 << bits, np.uint32)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slots[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slots[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]], self.rank[slots[put]], self.merged[slots[put]] = keys[put], rank[put], merged[put]
            left_over = np.ones(len(keys), bool)
            left_over[put] = False
            todo = todo[left_over[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def _key(left, right):
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, which has rank NEVER if the pair isn't there."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        wrong = np.flatnonzero((self.keys[slots] != keys) & (self.rank[slots] != NEVER))
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & self.mask
            at = slots[wrong]
            wrong = wrong[(self.keys[at] != keys[wrong]) & (self.rank[at] != NEVER)]
        return slots


class Vocabulary:
    """Ids of bytes, merges of pairs, and the bytes of each id."""

    def __init__(self, tokens: dict[bytes, int], pairs: PairTable, special: tuple[bytes, int] | None):
        self.byte_id = np.array([tokens[bytes([b])] for b in range(256)], np.uint32)
        self.pairs, self.special = pairs, special
        by_id = dict(zip(tokens.values(), tokens))
        if special:
            by_id[special[1]] = special[0]
        words = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum([0, *self.lengths[:-1]])
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return ragged(self.bytes, self.starts[ids], self.lengths[ids])


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], end to end."""
    at = np.cumsum(length)
    if not len(at):
        return values[:0]
    return values[np.repeat(start - (at - length), length) + np.arange(at[-1])]


@cache
def ranks_vocabulary(path: str) -> Vocabulary:
    """A rank file: a pair's rank is the rank of its bytes, which is also the id."""
    with open(path, "rb") as f:
        tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rows = [(tokens[w[:k]], tokens[w[k:]], i) for w, i in tokens.items() for k in range(1, len(w)) if w[:k] in tokens and w[k:] in tokens]
    left, right, rank = np.array(rows, np.uint32).T
    return Vocabulary(tokens, PairTable(left, right, rank, rank), None)


@cache
def merges_vocabulary(path: str) -> Vocabulary:
    """A tokenizer's JSON file: a pair's rank is its place in the list of merges."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    left, right, merged = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.uint32).T
    signs = _byte_signs()
    special = next(((t["content"].encode(), t["id"]) for t in whole["added_tokens"]), None)
    tokens = {bytes(signs[c] for c in w): i for w, i in vocab.items() if all(c in signs for c in w) and (special is None or i != special[1])}
    return Vocabulary(tokens, PairTable(left, right, np.arange(len(merged), dtype=np.uint32), merged), special)


def _byte_signs() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte.

    Bytes that print stand for themselves; the others, in order, for U+0100 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def rank_synchronous_merge(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pre-tokens as one ragged array; each round merges every pre-token's lowest-rank pair.

    Where the pair occurs several times in a pre-token, all its places merge in the round,
    from the left without overlap: later merges have higher ranks, so that is the order in
    which one-at-a-time merging takes them.  Pre-tokens of ALONE bytes have the same rounds on
    their own, so that the others need not wait for them.  Returns ids, and how many each has.
    """
    pairs = vocabulary.pairs
    length = end - start
    long = np.flatnonzero(length >= ALONE)
    if len(long):
        alone = [_synchronous_alone(vocabulary, data[start[i] : end[i]]) for i in long]
        short = np.flatnonzero(length < ALONE)
        ids, n = rank_synchronous_merge(vocabulary, data, start[short], end[short])
        counts = np.zeros(len(start), np.int64)
        counts[short], counts[long] = n, [len(x) for x in alone]
        owner = np.concatenate((np.repeat(short, n), np.repeat(long, counts[long])))
        return np.concatenate((ids, *alone))[np.argsort(owner, kind="stable")], counts
    ids = vocabulary.byte_id[ragged(data, start, length)]
    n = len(start)
    owner = np.repeat(np.arange(n), length)
    done_ids, done_owner = [], []
    while len(ids):
        inner = np.append(owner[1:] == owner[:-1], False)
        slot = pairs.find(ids, np.append(ids[1:], np.uint32(0)))
        rank = np.where(inner, pairs.rank[slot], NEVER)
        first = np.flatnonzero(np.append(True, ~inner[:-1]))
        lowest = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(ids)))
        live = np.repeat(lowest != NEVER, size)
        if not live.all():
            done_ids.append(ids[~live])
            done_owner.append(owner[~live])
        ids, owner, slot, rank = ids[live], owner[live], slot[live], rank[live]
        chosen = rank == np.repeat(lowest, size)[live]
        chosen &= rank != NEVER
        # Of neighbouring places, which overlap, the first, third, ... merge.
        at = np.flatnonzero(chosen)
        if not len(at):
            break
        fresh = np.append(True, (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]]))
        run = np.flatnonzero(fresh)
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[nth % 2 == 0]
        ids[at] = pairs.merged[slot[at]]
        left = np.ones(len(ids), bool)
        left[at + 1] = False
        ids, owner = ids[left], owner[left]
    ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=n).astype(np.int64)


def _synchronous_alone(vocabulary: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The rounds for one pre-token of many bytes: ranks are kept, and looked up anew next to merges only."""
    pairs = vocabulary.pairs
    symbol = vocabulary.byte_id[data]

    def linked(symbol):
        n = len(symbol)
        return np.append(symbol, np.uint32(0)), np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)

    def ranks(at):
        slot = pairs.find(symbol[at], symbol[following[at]])
        return np.where(following[at] < len(live), pairs.rank[slot], NEVER)

    symbol, following, preceding, live = linked(symbol)
    rank, left = ranks(np.arange(len(live))), len(live)
    while (lowest := rank.min()) != NEVER:
        at = np.flatnonzero(rank == lowest)
        run = np.flatnonzero(np.append(True, following[at[:-1]] != at[1:]))
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[nth % 2 == 0]
        gone = following[at]
        symbol[at] = pairs.merged[pairs.find(symbol[at[:1]], symbol[gone[:1]])[0]]
        following[at] = following[gone]
        preceding[following[gone]] = at
        live[gone], rank[gone] = False, NEVER
        before = preceding[at]
        changed = np.concatenate((at, before[before >= 0]))
        rank[changed] = ranks(changed)
        left -= len(at)
        if 2 * left < len(live):
            rank = rank[live]
            symbol, following, preceding, live = linked(symbol[:-1][live])
    return symbol[:-1][live]


def segment_tree_merge(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One segment tree over the byte positions of each pre-token, in batches of equal width.

    A leaf holds the rank of the pair that begins at its position, an inner node the lowest
    rank below it.  The root leads to the leftmost lowest pair in log(width) steps.  A merge
    changes three leaves: the merged pair's, that of the live neighbour before it and the
    swallowed one's; each change climbs to the root.  Returns ids, and how many each has.
    """
    length = end - start
    width = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
    counts = np.zeros(len(start), np.int64)
    ids: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        step = max(1, TREE_BYTES // int(8 * w))
        for low in range(0, len(rows), step):
            own = rows[low : low + step]
            if w >= ALONE and len(own) * 8 <= np.log2(w):
                parts = [_one_tree(vocabulary, data[start[r] : end[r]], int(w)) for r in own]
                found, n = np.concatenate(parts), np.array([len(p) for p in parts])
            else:
                found, n = _trees(vocabulary, data, start[own], length[own], int(w))
            counts[own] = n
            ids.append(found)
            owners.append(np.repeat(own, n))
    if not ids:
        return np.zeros(0, np.uint32), counts
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(ids)[order], counts


def _trees(vocabulary: Vocabulary, data, start, length, w: int) -> tuple[np.ndarray, np.ndarray]:
    pairs, n = vocabulary.pairs, len(start)
    place = np.arange(w)
    real = place < length[:, None]
    symbol = np.where(real, vocabulary.byte_id[data[np.minimum(start[:, None] + place, len(data) - 1)]], 0).astype(np.uint32)
    # Position w is beyond the end: the neighbour of the last and, for -1, of the first.
    following = np.where(place + 1 < length[:, None], place + 1, w).astype(np.int32)
    preceding = np.tile(np.arange(-1, w, dtype=np.int32), (n, 1))
    tree = np.full((n, 2 * w), NEVER)
    if w > 1:
        slot = pairs.find(symbol[:, :-1].ravel(), symbol[:, 1:].ravel())
        tree[:, w : 2 * w - 1] = np.where(real[:, 1:], pairs.rank[slot].reshape(n, w - 1), NEVER)
    level = w
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half

    def set_leaf(row, position, value):
        node = position + w
        tree[row, node] = value
        while w > 1 and node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def rank_at(row, position):
        """Rank of the live pair that begins there."""
        after = following[row, position]
        inside = after < w
        slot = pairs.find(symbol[row, position], symbol[row, np.minimum(after, w - 1)])
        return np.where(inside, pairs.rank[slot], NEVER)

    row = np.flatnonzero(tree[:, 1] != NEVER)
    while len(row):
        lowest = tree[row, 1]
        node = np.ones(len(row), np.int64)
        while node[0] < w:
            node = 2 * node
            node += tree[row, node] != lowest
        at = node - w
        gone = following[row, at]
        slot = pairs.find(symbol[row, at], symbol[row, gone])
        symbol[row, at] = pairs.merged[slot]
        after = following[row, gone]
        following[row, at] = after
        preceding[row, after] = at
        real[row, gone] = False
        set_leaf(row, gone, NEVER)
        set_leaf(row, at, rank_at(row, at))
        before = preceding[row, at].astype(np.int64)
        has = before >= 0
        if has.any():
            set_leaf(row[has], before[has], rank_at(row[has], before[has]))
        row = row[tree[row, 1] != NEVER]
    return symbol[real], real.sum(1)


def _one_tree(vocabulary: Vocabulary, data: np.ndarray, w: int) -> np.ndarray:
    """The same walk for one pre-token of many bytes, step by step: arrays of one element would be slower."""
    pairs, never = vocabulary.pairs, int(NEVER)
    ids = vocabulary.byte_id[data]
    leaves = np.full(w, NEVER)
    leaves[: len(ids) - 1] = pairs.rank[pairs.find(ids[:-1], ids[1:])]
    levels = [leaves]
    while len(levels[0]) > 1:
        levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
    tree = [never, *np.concatenate(levels).tolist()]
    symbol, n = ids.tolist(), len(ids)
    following, preceding = list(range(1, n + 1)), list(range(-1, n))
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def pair(left: int, right: int) -> tuple[int, int]:
        """Rank and merged id."""
        found = known.get((left, right))
        if found is None:
            slot = pairs.find(np.array([left], np.uint32), np.array([right], np.uint32))[0]
            found = known[left, right] = int(pairs.rank[slot]), int(pairs.merged[slot])
        return found

    def set_leaf(position: int, rank: int) -> None:
        node = position + w
        tree[node] = rank
        while node > 1:
            node >>= 1
            lowest = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == lowest:
                break
            tree[node] = lowest

    while tree[1] != never:
        lowest, node = tree[1], 1
        while node < w:
            node = 2 * node if tree[2 * node] == lowest else 2 * node + 1
        at = node - w
        gone = following[at]
        after, before = following[gone], preceding[at]
        symbol[at] = pair(symbol[at], symbol[gone])[1]
        symbol[gone] = -1
        following[at], preceding[after] = after, at
        set_leaf(gone, never)
        set_leaf(at, pair(symbol[at], symbol[after])[0] if after < n else never)
        if before >= 0:
            set_leaf(before, pair(symbol[before], symbol[at])[0])
    return np.array([s for s in symbol if s >= 0], np.uint32)


class Pool:
    """Values in the order they came, in an array that doubles as it fills."""

    def __init__(self, kind):
        self.values, self.used = np.zeros(1 << 16, kind), 0

    def keep(self, values: np.ndarray) -> int:
        """Where the values begin."""
        while self.used + len(values) > len(self.values):
            self.values = np.append(self.values, np.zeros_like(self.values))
        self.values[self.used : self.used + len(values)] = values
        self.used += len(values)
        return self.used - len(values)


class Encoder:
    """Texts to ids, with a bounded cache of pre-tokens: a slot for each of 2**20 hashes.

    A slot is found by the hash and taken by the bytes, which the cache holds too."""

    def __init__(self, vocabulary: Vocabulary, merge: Callable):
        self.vocabulary, self.merge = vocabulary, merge
        self._clear()

    def _clear(self) -> None:
        self.at, self.length, self.bytes_at = (np.zeros(CACHE_SLOTS, np.int64) for _ in range(3))
        self.n_bytes = np.full(CACHE_SLOTS, -1)
        self.ids, self.bytes = Pool(np.uint32), Pool(np.uint8)

    def _merged(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each pre-token begin in the pool, and how many it has."""
        ids, n = self.merge(self.vocabulary, data, start, end)
        return self.ids.keep(ids) + np.cumsum(n) - n, n

    def locate(self, chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pre-token: the text it is in, where its ids are in the pool, how many."""
        if self.ids.used > POOL_ROOM or self.bytes.used > POOL_ROOM:
            self._clear()
        vocabulary, data = self.vocabulary, chunk.data
        start, end, special = pretokens.split(chunk, vocabulary.special and vocabulary.special[0])
        n_bytes = end - start
        keys = A.slice_hasher(data)(start, end)
        slot = (keys >> np.uint64(64 - CACHE_SLOTS.bit_length() + 1)).astype(np.int64)
        at, length = self.at[slot], self.length[slot]
        hit = np.flatnonzero((self.n_bytes[slot] == n_bytes) & ~special)
        hit = hit[A.same_slices(data, start[hit], self.bytes.values[: self.bytes.used], self.bytes_at[slot[hit]], n_bytes[hit])]
        missed = ~special
        missed[hit] = False
        missed = np.flatnonzero(missed)
        if len(missed):
            _, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            one = missed[first]
            begin, n = self._merged(data, start[one], end[one])
            own = self.bytes.keep(ragged(data, start[one], n_bytes[one]))
            self.at[slot[one]], self.length[slot[one]], self.n_bytes[slot[one]] = begin, n, n_bytes[one]
            self.bytes_at[slot[one]] = own + np.cumsum(n_bytes[one]) - n_bytes[one]
            at[missed], length[missed] = begin[inverse], n[inverse]
            alike = one[inverse]
            odd = n_bytes[missed] != n_bytes[alike]
            odd[~odd] = ~A.same_slices(data, start[missed[~odd]], data, start[alike[~odd]], n_bytes[missed[~odd]])
            if odd.any():  # other bytes with the same hash
                odd = missed[odd]
                at[odd], length[odd] = self._merged(data, start[odd], end[odd])
        if special.any():
            at[special], length[special] = self.ids.keep(np.array([vocabulary.special[1]], np.uint32)), 1
        return chunk.doc_of(start), at, length

    def counts(self, chunk: A.Chunk) -> np.ndarray:
        """How many ids each text has."""
        doc, _, length = self.locate(chunk)
        return chunk.counts(doc, length).astype(np.int64)

    def encode(self, chunk: A.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, end to end, and where each text's begin and end (n + 1 places)."""
        doc, at, length = self.locate(chunk)
        edges = np.zeros(chunk.n + 1, np.int64)
        np.cumsum(chunk.counts(doc, length).astype(np.int64), out=edges[1:])
        return ragged(self.ids.values, at, length), edges
