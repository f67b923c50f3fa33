"""Arrow functions over the rows of a DataFrame with texts: columns that are added, rows that stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from . import arrays as A


def ddl(frame: DataFrame, columns: list[str]) -> list[str]:
    return [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in columns]


def apart(frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame with its columns that are named like one of these (in any case) under a free name: `x` becomes `x_before`."""
    taken = {n.lower() for n in names}
    own = list(frame.columns)
    for i, c in enumerate(own):
        while own[i].lower() in taken or own[i] != c and own[i] in own[:i] + own[i + 1 :]:
            own[i] += "_before"
    return frame.toDF(*own)


def with_text_columns(frame: DataFrame, column: str, added: str, make: Callable[[], Callable[[A.Chunk], list]]) -> DataFrame:
    """Replaces the text column by new ones, row by row.

    make() is called in each task and gives the function from a chunk of texts to the
    values of the new columns.  Other columns stay; see ``apart`` for those named like a new one.
    """
    names = [x.split()[0] for x in added.split(",")]
    kept = apart(frame.drop(column), names)
    keep = kept.columns
    frame = frame.select(*(c for c in frame.columns if c != column), column).toDF(*keep, "text")
    types = _arrow_types(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in batches:
            parts = [values(chunk) for chunk in A.chunks(batch.column(len(keep)))]
            if parts:
                new = [pa.array(np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for p in x for v in p], t) for x, t in zip(zip(*parts), types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *names])

    return frame.mapInArrow(run, ", ".join([*ddl(kept, keep), added]))


def rows_where(frame: DataFrame, column: str, make: Callable[[], Callable[[A.Chunk], np.ndarray]]) -> DataFrame:
    """The rows whose text the function wants, with all their columns as they are, whatever their names."""
    place = frame.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = make()
        for batch in batches:
            parts = [wanted(chunk) for chunk in A.chunks(batch.column(place))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    return frame.mapInArrow(run, StructType([StructField(f.name, f.dataType, True, f.metadata) for f in frame.schema]))


def _arrow_types(added: str) -> list[pa.DataType]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return [kinds[x.split()[1]] for x in added.split(",")]
