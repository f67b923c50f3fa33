"""Byte-level BPE encoding and decoding with segment trees.

``encode`` gives the ids of every text, as the library of the rank file would, and
``decode`` gives the bytes back.  Merges run on batches of segment trees
(``bytepair.segment_tree_merge``); pre-tokens that recur come from a bounded cache.
There is no shuffle: each task works through its own texts.

Edge cases: a null text is an empty text (no ids, the hash of nothing); texts of any
length are whole; repeated rows each give a row; further columns are kept by ``encode``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from .bytepair import Encoder, ranks_vocabulary, segment_tree_merge
from .frames import ddl, with_text_columns
from .storage import read

RANKS = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(frame: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """The frame with an array of ids in place of each text."""
    keep = [c for c in frame.columns if c not in (column, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_vocabulary(path), segment_tree_merge)
        for batch in batches:
            at = 0
            for chunk in A.chunks(batch.column(len(keep))):
                found, edges = encoder.encode(chunk)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, chunk.n) for c in batch.columns[: len(keep)]), lists], [*keep, ids])
                at += chunk.n

    return frame.select(*keep, column).mapInArrow(run, ", ".join([*ddl(frame, keep), f"`{ids}` array<int>"]))


def decode(frame: DataFrame, path: str, ids: str = "ids", column: str = "bytes") -> DataFrame:
    """The frame with the bytes of each array of ids; null stays null."""
    keep = [c for c in frame.columns if c not in (column, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks_vocabulary(path)
        for batch in batches:
            lists = batch.column(len(keep))
            out = [None if not x.is_valid else vocabulary.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, column])

    return frame.select(*keep, ids).mapInArrow(run, ", ".join([*ddl(frame, keep), f"`{column}` binary"]))


def digests(frame: DataFrame, path: str, column: str = "text") -> DataFrame:
    """n_tokens and the hashes of the ids and of the bytes that they decode to, for each text."""

    def make():
        encoder = Encoder(ranks_vocabulary(path), segment_tree_merge)
        vocabulary = encoder.vocabulary
        sha = lambda values, edges: [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(edges, edges[1:])]

        def values(chunk: A.Chunk) -> list:
            ids, edges = encoder.encode(chunk)
            back = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(vocabulary.lengths[ids], out=back[1:])
            return [np.diff(edges), sha(memoryview(ids.astype("<u4")), edges.tolist()), sha(memoryview(vocabulary.decode(ids)), back[edges].tolist())]

        return values

    return with_text_columns(frame, column, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, tokenizer_path(RANKS))
