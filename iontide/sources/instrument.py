"""Instrument files as DataFrames, and back.

Binary ion lists are read by byte ranges: each task of a file takes whole records of its own
range, so one large file is read by many tasks and ionIdx follows from the offset."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iontide.operators.ranging import small
from iontide.schema import EPOS, POS, with_units
from iontide.sources.ranges import byte_ranges, read_range
from iontide.sources.ranges import local as _local

#: Records of the binary lists: big-endian floats, in .epos followed by two unsigned integers.
RECORDS = {
    "pos": np.dtype([(n, ">f4") for n in ("x", "y", "z", "mc")]),
    "epos": np.dtype([*((n, ">f4") for n in ("x", "y", "z", "mc", "tof", "VDC", "VP", "detx", "dety")), ("deltaP", ">u4"), ("multi", ">u4")]),
}
#: Records of a task that writes.
CHUNK_RECORDS = 1_000_000


def decode(kind: str, content: bytes, first: int = 1) -> pd.DataFrame:
    """The records of a file's bytes; a last incomplete record is left out."""
    record = RECORDS[kind]
    rows = np.frombuffer(content, record, len(content) // record.itemsize)
    out = pd.DataFrame({"ionIdx": np.arange(first, first + len(rows), dtype=np.int64)})
    for name in record.names:
        out[name] = rows[name].astype(np.int64 if name in ("deltaP", "multi") else np.float64)
    if kind == "epos":
        out["atomNum"] = out["ionIdx"]
    return out


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All records of one or more .pos or .epos files; file names which one each comes from."""
    size = RECORDS[kind].itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ranges in batches:
            for name, first, n in zip(ranges["path"], ranges["first"], ranges["n"]):
                rows = decode(kind, read_range(name, int(first) * size, int(n) * size), int(first) + 1)
                rows.insert(0, "file", name)
                yield rows

    return with_units(byte_ranges(spark, path, size).mapInPandas(run, "file string, " + (POS if kind == "pos" else EPOS)))


def read_raw(spark: SparkSession, path: str, least_tof: float = 50.0, most_tof: float = 5000.0) -> DataFrame:
    """Raw detector data staged as Parquet (tof, VDC, VP, detx, dety in cm ...): centimetres become millimetres, impossible rows go, ionIdx is kept in order but no longer gapless."""
    from iontide.operators.calibration import clean_raw

    rows = spark.read.parquet(path)
    rows = rows.withColumns({c: F.col(c) * 10 for c in ("detx", "dety")})
    return with_units(clean_raw(rows, least_tof, most_tof))


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A list of ions by its file's ending, or by kind: pos, epos, apt, csv or parquet."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in RECORDS:
        return read_records(spark, path, kind)
    if kind == "apt":
        from iontide.sources.sections import read_sections

        return read_sections(spark, path)
    if kind == "csv":
        return with_units(spark.read.option("header", True).schema(EPOS).csv(path))
    if kind == "parquet":
        return with_units(spark.read.parquet(path))
    raise ValueError(f"no reader for {kind!r}")


def write_records(pos: DataFrame, path: str, kind: str = "pos") -> int:
    """A .pos or .epos file in the order of ionIdx; returns how many ions it has.

    The file lies on a disk that driver and executors share.  Rows are numbered and sorted by
    ranges, and every task writes its records at their own place, so a task that runs again
    writes the same bytes again."""
    record = RECORDS[kind]
    path = _local(path)
    rows = renumbered(pos.select("ionIdx", *record.names))
    n = rows.count()
    with open(path, "wb") as out:
        out.truncate(n * record.itemsize)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "r+b") as out:
            for part in batches:
                at = part["ionIdx"].to_numpy()
                values = np.empty(len(part), record)
                for name in record.names:
                    values[name] = part[name].to_numpy()
                for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(run):
                        out.seek((int(at[run[0]]) - 1) * record.itemsize)
                        out.write(values[run].tobytes())
                yield pd.DataFrame({"n": [len(part)]})

    parts = max(1, math.ceil(n / CHUNK_RECORDS))
    written = rows.repartitionByRange(parts, "ionIdx").sortWithinPartitions("ionIdx").mapInPandas(write, "n long").agg(F.sum("n")).first()[0]
    return int(written or 0)


def renumbered(pos: DataFrame, block: int = 1_000_000) -> DataFrame:
    """ionIdx made gapless, in its order, without sorting all rows in one task."""
    from pyspark.sql import Window

    rows = pos.withColumn("_block", F.floor(F.col("ionIdx") / block))
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_block", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_block").orderBy("ionIdx")) + F.col("_before")
    return rows.join(small(before), "_block").withColumn("ionIdx", number.cast("long")).drop("_block", "_before")


def volume_bytes(values: np.ndarray) -> bytes:
    """A voxel volume as raw bytes, scaled to 0 ... 255, the first axis fastest."""
    low, high = float(np.nanmin(values)), float(np.nanmax(values))
    scaled = np.nan_to_num((values - low) / (high - low or 1) * 255).round().astype(np.uint8)
    buffer = io.BytesIO()
    buffer.write(scaled.tobytes(order="F"))
    return buffer.getvalue()
