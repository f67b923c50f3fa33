"""Harmonic packing of documents into token sequences of bounded length.

Lengths fall into reciprocal-capacity classes: class k has the lengths in
(capacity / (k + 1), capacity / k], and a sequence of class k takes exactly k pieces.
Lengths below capacity / CLASSES share sequences in order of arrival until one doesn't fit.
A document is cut so that its pieces nearly fill their slots: whole sequences first, then,
while a slot of capacity / k would waste more than 1 / SLACK of itself, a piece of exactly
capacity / (k + 1).

Every task packs its own documents, without any exchange: a piece waits until its sequence
is full, and what is left in the end (fewer than CLASSES**2 / 2 pieces) is packed by
decreasing length into the first sequence with room.  Each task ends with about one
sequence that isn't full.

Edge cases: a null text is an empty document, which has only the end id; repeated rows are
packed once each; a very long document gives many whole sequences; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .bpe_encoding import tokenizer_path
from .bytepair import Encoder, merges_vocabulary, rank_synchronous_merge
from .frames import ddl
from .storage import read

CAPACITY, END_ID = 2048, 1
#: Classes with a fixed number of pieces, and the share of a slot that may be wasted.
CLASSES, SLACK = 32, 64
TOKENIZER = "byte_bpe_50k.json"


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(piece length, class) of a document's pieces, in order; class 0: shorter than all classes."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= CLASSES:
            out.append((rest, 0))
            break
        slot = capacity // k
        if (slot - rest) * SLACK <= slot:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1 if k + 1 < CLASSES else 0))
        rest -= piece
    return out


class HarmonicPacker:
    """Takes (length, class, row) and gives rows with their sequence and offset once that is settled."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next_id, self.capacity = first_id, capacity
        self.open: list[list] = [[] for _ in range(CLASSES)]
        self.filled = 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for length, row in pieces:
            yield (*row, self.next_id, offset)
            offset += length
        self.next_id += 1

    def add(self, length: int, k: int, row: tuple) -> Iterator[tuple]:
        pieces = self.open[k]
        if k == 0:
            if self.filled + length > self.capacity:
                yield from self._close(pieces)
                self.open[0] = pieces = []
                self.filled = 0
            self.filled += length
        pieces.append((length, row))
        if k and len(pieces) == k:
            yield from self._close(pieces)
            self.open[k] = []

    def finish(self) -> Iterator[tuple]:
        rest = sorted((p for pieces in self.open for p in pieces), key=lambda p: -p[0])
        bins: list[list] = []
        room: list[int] = []
        for p in rest:
            i = next((i for i, r in enumerate(room) if r >= p[0]), None)
            if i is None:
                bins.append([])
                room.append(self.capacity)
                i = len(bins) - 1
            bins[i].append(p)
            room[i] -= p[0]
        for pieces in bins:
            yield from self._close(pieces)


def pack(frame: DataFrame, path: str, key: str = "doc_id", column: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the ids themselves.

    sequence_id holds the number of the task in its upper bits, so that tasks need not agree.
    """
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    types = [None, *[pa.int64()] * 6]
    schema = ", ".join([*ddl(frame, [key]), *(f"{n} long" for n in names[1:])] + ["ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges_vocabulary(path), rank_synchronous_merge)
        packer = HarmonicPacker(TaskContext.get().partitionId() << 33, capacity)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            *columns, extra, sequence, offset = zip(*rows)
            columns = [*columns, sequence, offset]
            arrays = [pa.array(c, t) for c, t in zip(columns, [key_type, *types[1:]])]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(extra, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for chunk in A.chunks(batch.column(1)):
                found, edges = encoder.encode(chunk)
                rows: list[tuple] = []
                for i, row in enumerate(chunk.rows):
                    ids = np.append(found[edges[i] : edges[i + 1]], np.uint32(END_ID)).astype("<u4")
                    at = 0
                    for length, k in cut(len(ids), capacity):
                        piece = ids[at : at + length]
                        info = (keys[row], at, length, zlib.crc32(piece), len(ids), piece.tolist() if with_ids else None)
                        rows.extend(packer.add(length, k, info))
                        at += length
                if rows:
                    yield table(rows)
        if rows := list(packer.finish()):
            yield table(rows)

    return frame.select(key, column).mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))
