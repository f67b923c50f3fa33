"""Text sources: metadata lists, sensor logs, atom positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iontide.operators.ranging import small

METADATA_LINE = r"^\s*([^\[\]=%]+?)\s*\[([^\]]*)\]\s*=\s*([^\[%]*?)\s*(?:\[([^\]]*)\])?\s*(?:%.*)?$"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, format, value, unit of lines ``name [format] = value [unit]``; NULL and nothing are null, % begins a comment."""
    return parse_metadata(spark.read.text(path))


def parse_metadata(lines: DataFrame) -> DataFrame:
    kept = lines.filter(F.col("value").rlike(METADATA_LINE))
    part = lambda k: F.regexp_extract("value", METADATA_LINE, k)
    value = F.when(~part(3).isin("", "NULL"), part(3))
    return kept.select(part(1).alias("path"), part(2).alias("format"), value.alias("value"), F.when(part(4) != "", part(4)).alias("unit"))


def typed(metadata: DataFrame) -> DataFrame:
    """The value as number, boolean, time or text, after its format; what doesn't fit is null."""
    f, v = F.col("format"), F.col("value")
    return metadata.withColumns({
        "number": F.when(f.rlike("^(float|u?int)"), F.expr("try_cast(value as double)")),
        "flag": F.when(f == "bool", F.expr("try_cast(value as boolean)")),
        "time": F.when(f == "dateTime", F.try_to_timestamp(v)),
    })


def search(metadata: DataFrame, file: str, attributes: Sequence[str]) -> DataFrame:
    """One row per file with a column for each attribute; null where a file has none."""
    return metadata.groupBy(file).pivot("path", list(attributes)).agg(F.first("value"))


def find_by_attribute(metadata: DataFrame, file: str, attribute: str, value: str) -> DataFrame:
    return metadata.filter((F.col("path") == attribute) & (F.col("value") == value)).select(file).distinct()


def read_sensor(spark: SparkSession, folder: str, columns: Sequence[str], date: str = "Date", time: str = "Time", form: str = "M/d/yyyy h:mm:ss a", skip: int = 2) -> DataFrame:
    """All logs below a folder as one table with a timestamp; the first lines of each file are skipped.

    Lines of one block are numbered one after the other, so the first lines are those with the least
    numbers in the block that begins the file, however the file is split."""
    rows = spark.read.option("recursiveFileLookup", True).text(folder)
    rows = rows.select("value", F.col("_metadata.file_path").alias("_file"), (F.col("_metadata.file_block_start") == 0).alias("_begins"), F.monotonically_increasing_id().alias("_n"))
    first = rows.filter("_begins").groupBy("_file").agg(F.min("_n").alias("_first"))
    body = rows.join(small(first), "_file").filter(~F.col("_begins") | (F.col("_n") >= F.col("_first") + skip))
    parts = body.select(F.split("value", ",").alias("p")).select(*(F.col("p")[i].alias(c) for i, c in enumerate(columns)))
    return parts.withColumn("timestamp", F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(form)))


def enrich(table: DataFrame, metadata: DataFrame, key: Column) -> DataFrame:
    """The table with the metadata of the same key, which is derived from its columns (a number in a file name, say).

    metadata: key and further columns; rows without any keep nulls."""
    return table.withColumn("key", key).join(small(metadata), "key", "left").drop("key")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """atom, x, y, z of lines with four fields."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter((F.size("p") >= 4) & F.col("p")[1].rlike(r"^-?[\d.]"))
    return rows.select(F.col("p")[0].alias("atom"), *(F.col("p")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")))
