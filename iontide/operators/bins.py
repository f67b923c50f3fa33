"""Bins in one to three dimensions, counts per bin, and binned composition in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(x: Column, width: float, low: float = 0.0) -> Column:
    """The number of the bin that holds x."""
    return F.floor((x - F.lit(low)) / F.lit(width)).cast("long")


def bounded(x: Column, low: float, high: float, width: float) -> Column:
    """Bins of low:width:high; a tail shorter than a bin is outside (null), the last edge is in the last bin."""
    n = int((high - low) / width + 1e-9)
    last = low + n * width
    return F.when((x >= low) & (x <= last), F.least(fixed(x, width, low), F.lit(n - 1)))


def centre(bin_: Column, width: float, low: float = 0.0) -> Column:
    return (bin_ + 0.5) * F.lit(width) + F.lit(low)


def histogram(frame: DataFrame, x: str, width: float, low: float = 0.0) -> DataFrame:
    """bin, mc (the bin's centre) and counts."""
    b = fixed(F.col(x), width, low)
    return frame.filter(F.col(x).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("counts")).select("bin", centre(F.col("bin"), width, low).alias("mc"), "counts")


def normalised(histogram_: DataFrame, width: float, total: int) -> DataFrame:
    """Counts per Dalton and ion."""
    return histogram_.withColumn("normalised", F.col("counts") / F.lit(width * total))


def filled(histogram_: DataFrame, width: float, low: float = 0.0) -> DataFrame:
    """With the empty bins between the first and the last."""
    span = histogram_.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(histogram_.select("bin", "counts"), "bin", "left").select("bin", centre(F.col("bin"), width, low).alias("mc"), F.coalesce("counts", F.lit(0)).alias("counts"))


def grid(frame: DataFrame, axes: Sequence[tuple[str, float]], *by: str) -> DataFrame:
    """Counts per cell of a grid (column, width) and group."""
    keys = [fixed(F.col(c), w).alias(f"bin_{c}") for c, w in axes]
    return frame.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n"))


def cell_composition(cells: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Each species' share of its cell."""
    total = F.sum(n).over(Window.partitionBy(*keys))
    return cells.withColumn("share", F.col(n) / total)


def equal_count(frame: DataFrame, size: int, order: Sequence[str], block: Column) -> DataFrame:
    """slice: rows numbered in order, ``size`` to a slice.

    block is a Column that never falls along the order; rows are numbered within blocks and
    blocks are summed up apart, so no task sorts all rows."""
    rows = frame.withColumn("_block", block)
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    return rows.join(before, "_block").withColumn("slice", F.floor((within + F.col("_before")) / size).cast("long")).drop("_block", "_before")


def half_overlapping(index: Column, size: int) -> Column:
    """The slices of ``size`` that an index is in, each beginning half a slice after the one before."""
    hop = size // 2
    s = F.floor(index / hop).cast("long")
    return F.explode(F.when(s > 0, F.array(s - 1, s)).otherwise(F.array(s)))


def voxel_similarity(frame: DataFrame, voxel: Sequence[str], bin_: str) -> DataFrame:
    """The cosine of each voxel's spectrum with the spectrum of all."""
    counts = frame.groupBy(*voxel, bin_).agg(F.count(F.lit(1)).alias("n"))
    whole = frame.groupBy(bin_).agg(F.count(F.lit(1)).alias("g"))
    norm = whole.agg(F.sqrt(F.sum(F.col("g").cast("double") * F.col("g"))).alias("norm"))
    joined = counts.join(whole, bin_)
    sums = joined.groupBy(*voxel).agg(F.sum("n").alias("atoms"), F.sum(F.col("n").cast("double") * F.col("g")).alias("dot"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("own"))
    return sums.join(F.broadcast(norm)).select(*voxel, "atoms", (F.col("dot") / (F.col("own") * F.col("norm"))).alias("similarity"))
