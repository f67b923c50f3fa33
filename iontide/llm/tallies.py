"""Counts of integer keys over a whole DataFrame, summed in packed rows.

A task tallies the keys of its texts with numpy and sends each part (a range of keys) one
row of packed keys and counts; the task that owns a part sums them.  So the exchange holds
few large rows, every key is aggregated before it, and no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .storage import shuffle_partitions

#: A task sends what it has at this many distinct keys.
ROOM = 2_000_000


def packed_rows(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each part that has keys; keys are sorted and parts ascend with them."""
    low = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    high = np.append(low[1:], len(part))
    yield pa.RecordBatch.from_arrays(
        [pa.array(part[low], pa.int32()), pa.array([keys[i:j].tobytes() for i, j in zip(low, high)], pa.binary()), pa.array([counts[i:j].astype(np.uint32).tobytes() for i, j in zip(low, high)], pa.binary())],
        ["part", "keys", "counts"],
    )


def tallied(frame: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], part_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(part, keys, counts): each part in one row, with distinct uint64 keys and int64 counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for keys in keys_of(batch):
                held.append(A.tally(keys))
                if sum(len(k) for k, _ in held) > ROOM:
                    held = [A.tally(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) > ROOM // 2:
                        yield from packed_rows(*held[0], part_of(held[0][0]))
                        held = []
        if held:
            keys, counts = A.tally(*map(np.concatenate, zip(*held)))
            yield from packed_rows(keys, counts, part_of(keys))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for part, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows.setdefault(part, []).append((keys, counts))
        for part in sorted(rows):
            keys, counts = (b"".join(x) for x in zip(*rows.pop(part)))
            keys, counts = A.tally(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([keys.tobytes()]), pa.array([counts.tobytes()])], ["part", "keys", "counts"])

    schema = "part int, keys binary, counts binary"
    return frame.mapInArrow(count, schema).repartition(shuffle_partitions(frame.sparkSession), "part").mapInArrow(merge, schema)


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` documents of each of the labels 0 and 1.

    The rows are those whose doc_id has the least hashes, so the sample is the same in every
    run.  A document with several labels has the largest; null ids and labels are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    one = known.filter(F.col("label") == 1).orderBy(*order).limit(rows)
    none = known.filter(F.col("label") == 0).orderBy(*order).limit(rows)
    return one.unionByName(none)
