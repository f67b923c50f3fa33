"""Structured Streaming forms: spectra that grow with the hits, windows, and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iontide.operators import bins


def growing_spectrum(stream: DataFrame, x: str, width: float) -> DataFrame:
    """The histogram so far; the state is one row per bin."""
    return bins.histogram(stream, x, width)


def rate_windows(stream: DataFrame, at: str, x: str, low: float, high: float, window: str, slide: str, late: str) -> DataFrame:
    """Hits in a mass window per sliding window of time; hits later than ``late`` are left out."""
    keyed = stream.withWatermark(at, late).groupBy(F.window(at, window, slide))
    return keyed.agg(F.count(F.lit(1)).alias("ions"), F.count_if(F.col(x).between(low, high)).alias("hits"))


def bursts(stream: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    """Runs of hits of one key that are no more than a gap apart."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n"))


def drained_spectrum(spark: SparkSession, path: str, x: str, width: float) -> DataFrame:
    """All of a Parquet source as a stream, taken once, as a table in memory (a spectrum's bins are few)."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    source = path if _is_folder(spark, path) else folder
    reader = spark.readStream.schema(schema)
    stream = (reader if source == path else reader.option("pathGlobFilter", name)).parquet(source)
    table = f"spectrum_{uuid.uuid4().hex}"
    running = growing_spectrum(stream, x, width).writeStream.outputMode("complete").format("memory").queryName(table).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(table)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
