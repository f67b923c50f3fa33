"""Whole-text processing as flat numpy arrays.

Python functions of this subpackage receive Arrow batches of texts.  The helpers
here lay the texts of a bounded chunk end to end in one byte array and find words,
lines and their hashes for all of them with a fixed number of numpy passes, so the
cost per byte is a few machine operations and memory is bounded by ``CHUNK_BYTES``
or by the longest single text, whichever is larger.

Hashes are 64 bits wide: every block of eight bytes is mixed with its place in the slice, and
the mixed blocks are summed with the length.  Equal blocks in other places so have unrelated
values, and no pattern of a text makes sums meet more often than chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at once.
CHUNK_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, on a uint64 array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_IDENTITY = np.arange(256, dtype=np.uint8)
#: ASCII A-Z to a-z, other bytes as they are.
LOWER = np.where((_IDENTITY >= 65) & (_IDENTITY <= 90), _IDENTITY + 32, _IDENTITY).astype(np.uint8)
#: The white space that ends words: space and \x09-\x0D.
SPACE = (_IDENTITY == 32) | ((_IDENTITY >= 9) & (_IDENTITY <= 13))
#: Letters and digits of ASCII and all bytes of longer code points.
WORDLIKE = (_IDENTITY >= 128) | np.array([chr(i).isalnum() and i < 128 for i in range(256)])

#: The bits of the last block of a slice that are its own, by its bytes modulo 8.
_REST = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
_SEED, _PLACE = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _mixed_blocks(blocks: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A value of each (block, place); the first steps keep a block and its place from trading bits."""
    h = (blocks ^ _SEED) * np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    h += place * _PLACE
    return mix(h)


def blocks_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    wide = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", wide.data, strides=(1,))


def _places(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of slices with whole blocks: which they are, the first place of each, the slice of each block and its number."""
    long = np.flatnonzero(length >> 3)
    n = length[long] >> 3
    first = np.cumsum(n) - n
    owner = np.repeat(long, n)
    return long, first, owner, np.arange(len(owner)) - np.repeat(first, n)


def slice_hasher(data: np.ndarray):
    """A function giving the hash of each slice data[start:end], for arrays of them."""
    blocks = blocks_at(data)

    def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, length = np.asarray(start, np.int64), np.asarray(end, np.int64) - start
        whole = length >> 3
        out = _mixed_blocks(blocks[start + 8 * whole] & _REST[length & 7], whole.astype(np.uint64))
        long, first, owner, number = _places(length)
        if len(long):
            out[long] += np.add.reduceat(_mixed_blocks(blocks[start[owner] + 8 * number], number.astype(np.uint64)), first)
        return mix(out ^ length.astype(np.uint64) * np.uint64(_BASE))

    return hashes


def same_slices(a: np.ndarray, start_a: np.ndarray, b: np.ndarray, start_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether a[start_a : start_a + length] equals b[start_b : ...], for arrays of slices."""
    blocks_a, blocks_b = blocks_at(a), blocks_at(b)
    whole = length & ~7
    out = ((blocks_a[start_a + whole] ^ blocks_b[start_b + whole]) & _REST[length & 7]) == 0
    long, first, owner, number = _places(length)
    if len(long):
        out[long] &= ~np.logical_or.reduceat(blocks_a[start_a[owner] + 8 * number] != blocks_b[start_b[owner] + 8 * number], first)
    return out


def combine(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several in order."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * np.uint64(_BASE) + h)
    return out


class Chunk:
    """Texts laid end to end, each followed by one line feed that isn't part of it."""

    def __init__(self, rows: range, texts: list[memoryview]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.rows = rows
        self.n = len(texts)
        self.starts = np.zeros(self.n, np.int64)
        np.cumsum(lengths[:-1] + 1, out=self.starts[1:])
        self.ends = self.starts + lengths
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if self.n else np.zeros(0, np.uint8)

    def runs(self, member: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes that member[byte] holds for."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = member[self.data if data is None else data]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACE)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1

    def counts(self, docs: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(docs, weights, self.n)


def texts_of(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return [memoryview(b"")] * len(column)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8).tolist()
    view = memoryview(data or b"")
    out = [view[a:b] for a, b in zip(at, at[1:])]
    if column.null_count:
        out = [t if ok else memoryview(b"") for t, ok in zip(out, column.is_valid().to_pylist())]
    return out


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """All texts of a column, in chunks of at most ``limit`` bytes or one text."""
    texts = texts_of(column)
    low, size = 0, 0
    for i, t in enumerate(texts):
        if i > low and size + len(t) > limit:
            yield Chunk(range(low, i), texts[low:i])
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield Chunk(range(low, len(texts)), texts[low:])


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts (or sums of the counts given)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)
