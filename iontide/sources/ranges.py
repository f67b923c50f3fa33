"""Byte ranges of files: many tasks read one file, each its own whole records."""

from __future__ import annotations

import math
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task reads, about.
RANGE_BYTES = 64 << 20


def local(path: str) -> str:
    """A path that open() takes, of one with or without the scheme file."""
    return urlparse(path).path if path.startswith("file:") else path


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and bytes of each file that a path, folder or pattern names, by any file system of Spark's."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    found = system.globStatus(where) or []
    if len(found) == 1 and found[0].isDirectory():
        found = system.listStatus(found[0].getPath())
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile())


def byte_ranges(spark: SparkSession, path: str, record: int, room: int = RANGE_BYTES) -> DataFrame:
    """(path, first, n): runs of whole records, one to a partition; bytes of a last broken record are left out.

    Only the files' names and sizes pass through the driver."""
    step = max(1, room // record)
    files = spark.createDataFrame([(name, size // record) for name, size in sizes(spark, path)], "path string, records long")
    parts = files.filter("records > 0").select("path", "records", F.explode(F.sequence(F.lit(0), F.col("records") - 1, F.lit(step))).alias("first"))
    ranges = parts.select("path", "first", F.least(F.lit(step), F.col("records") - F.col("first")).alias("n"))
    return ranges.repartition(max(1, sum(math.ceil(size / (step * record)) for _, size in sizes(spark, path))), "path", "first")


def read_range(path: str, offset: int, length: int) -> bytes:
    """The bytes of a range; other file systems than the local one by pyarrow."""
    if path.startswith("file:") or "://" not in path:
        with open(local(path), "rb") as f:
            f.seek(offset)
            return f.read(length)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        f.seek(offset)
        return f.read(length)
