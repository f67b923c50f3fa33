"""Voxel volumes as sparse rows (i, j, k, value)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iontide.functions.physics import rotate


def voxels(points: DataFrame, axes: Sequence[str], width: float, solute) -> DataFrame:
    """Counts of all and of solutes per voxel, and the share."""
    keys = [F.floor(F.col(c) / width).cast("long").alias(n) for c, n in zip(axes, "ijk")]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(solute).alias("solute")).withColumn("value", F.col("solute") / F.col("n"))


def downsample(volume: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of voxels."""
    return volume.groupBy(*(F.floor(F.col(n) / factor).cast("long").alias(n) for n in "ijk")).agg(F.avg("value").alias("value"))


def sample_linear(volume: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """value at fractional places (key, x, y, z in voxels): the eight corners by one equi-join, weighted.

    Missing and NaN corners are left out and the others' weights scaled up; null if all are missing."""
    corners = at
    for n, c in zip("ijk", "xyz"):
        low = F.floor(c).cast("long")
        share = F.col(c) - F.floor(c)
        corners = corners.select("*", F.explode(F.array(F.struct(low.alias(n), (1 - share).alias("w")), F.struct((low + 1).alias(n), share.alias("w")))).alias(f"_{n}"))
    weight = F.col("_i.w") * F.col("_j.w") * F.col("_k.w")
    rows = corners.select(key, *(F.col(f"_{n}.{n}").alias(n) for n in "ijk"), weight.alias("w")).filter("w > 0")
    met = rows.join(volume.filter(~F.isnan("value")).select("i", "j", "k", "value"), ["i", "j", "k"])
    found = met.groupBy(key).agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))
    return at.join(found, key, "left")


def resample(volume: DataFrame, shape: tuple[int, int, int], step: tuple[float, float, float], shift: tuple[float, float, float] = (0, 0, 0)) -> DataFrame:
    """The volume on another grid: new voxel (i, j, k) lies at index * step + shift of the old one."""
    spark = volume.sparkSession
    n = math.prod(shape)
    grid = spark.range(n).select("id", F.floor(F.col("id") / (shape[1] * shape[2])).alias("a"), (F.floor(F.col("id") / shape[2]) % shape[1]).alias("b"), (F.col("id") % shape[2]).alias("c"))
    places = grid.select("id", *(F.col(n_).alias(m) for n_, m in zip("abc", "ijk")), *((F.col(n_) * s + d).alias(c) for n_, s, d, c in zip("abc", step, shift, "xyz")))
    found = sample_linear(volume, places.select("id", "x", "y", "z"), "id")
    return places.select("id", "i", "j", "k").join(found.select("id", "value"), "id").select("i", "j", "k", "value")


def rotated(volume: DataFrame, shape: tuple[int, int, int], axis: Sequence[float], angle: float) -> DataFrame:
    """The volume turned about its middle, each new voxel looking back at the old ones."""
    spark = volume.sparkSession
    grid = spark.range(math.prod(shape)).select("id", F.floor(F.col("id") / (shape[1] * shape[2])).alias("i"), (F.floor(F.col("id") / shape[2]) % shape[1]).alias("j"), (F.col("id") % shape[2]).alias("k"))
    middle = [(s - 1) / 2 for s in shape]
    back = rotate(*(F.col(n) - m for n, m in zip("ijk", middle)), axis, -angle)
    places = grid.select("id", "i", "j", "k", *((b + m).alias(c) for b, m, c in zip(back, middle, "xyz")))
    found = sample_linear(volume, places.select("id", "x", "y", "z"), "id")
    return places.select("id", "i", "j", "k").join(found.select("id", "value"), "id").select("i", "j", "k", "value")
