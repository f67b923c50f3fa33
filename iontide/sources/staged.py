"""Datasets staged as Parquet: an ion list, its ranges, images and metadata below one folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iontide.schema import METADATA, with_units

PARTS = ("pos", "ranges", "metadata")


def save(folder: str, pos: DataFrame | None = None, ranges: DataFrame | None = None, metadata: DataFrame | None = None) -> None:
    """Writes the parts that are given; ions are clustered by ionIdx, so that filters on it skip row groups."""
    for name, frame in zip(PARTS, (pos, ranges, metadata)):
        if frame is not None:
            frame = frame.repartitionByRange("ionIdx").sortWithinPartitions("ionIdx") if name == "pos" else frame.coalesce(1)
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, part: str = "pos", skip_errors: bool = False) -> DataFrame:
    """A part of a dataset; skip_errors leaves out files that can't be read."""
    frame = spark.read.option("ignoreCorruptFiles", skip_errors).parquet(f"{folder}/{part}")
    return with_units(frame) if part == "pos" else frame


def metadata_rows(spark: SparkSession, values: dict[str, dict]) -> DataFrame:
    """Metadata from nested names: {group: {name: value or (value, unit)}}."""
    rows = []
    for group, own in values.items():
        for name, value in own.items():
            value, unit = value if isinstance(value, tuple) else (value, None)
            kind = {bool: "bool", int: "int64", float: "float64"}.get(type(value), "string")
            rows.append((f"/{group}/{name}", kind, None if value is None else str(value).lower() if kind == "bool" else str(value), unit))
    return spark.createDataFrame(rows, METADATA)


def save_image(spark: SparkSession, folder: str, name: str, pixels: np.ndarray) -> None:
    """An image as rows (name, row, values), added to those of the folder."""
    rows = [(name, i, [float(v) for v in line]) for i, line in enumerate(np.atleast_2d(pixels))]
    spark.createDataFrame(rows, "name string, row int, values array<double>").coalesce(1).write.mode("append").parquet(f"{folder}/images")


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(name, row, column, value) of all images of a folder."""
    return spark.read.parquet(f"{folder}/images").select("name", "row", F.posexplode("values").alias("column", "value"))
