"""How good a dataset is: density, artefacts, spectrum resolution, and a rating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iontide.functions.geometry import angle_of
from iontide.operators.spatial import nearest


def density(points: DataFrame, axes: Sequence[str] = ("x", "y", "z"), width: float = 2.0) -> DataFrame:
    """One row: ions, box volume, mean density, and the variation of counts between occupied voxels.

    Voxels are half open, so ions on the upper faces of the box count in no voxel."""
    box = points.agg(F.count(F.lit(1)).alias("ions"), *(f(c).alias(f"{n}_{c}") for c in axes for n, f in (("low", F.min), ("high", F.max))))
    volume = F.lit(1.0)
    for c in axes:
        volume = volume * (F.col(f"high_{c}") - F.col(f"low_{c}"))
    inside = F.lit(True)
    for c in axes:
        inside = inside & (F.col(c) < F.col(f"high_{c}"))
    placed = points.join(F.broadcast(box)).filter(inside)
    cells = placed.groupBy(*(F.floor((F.col(c) - F.col(f"low_{c}")) / width).alias(f"c_{c}") for c in axes)).agg(F.count(F.lit(1)).alias("n"))
    spread = cells.agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.median("n").alias("median"))
    return box.join(F.broadcast(spread)).select("ions", volume.alias("volume"), (F.col("ions") / volume).alias("density"), (F.col("std") / F.col("mean")).alias("variation"), F.col("median").alias("voxel_median"))


def overlap(points: DataFrame, key: str, axes: Sequence[str], least: float, rows: int | None = None, seed: int = 0) -> DataFrame:
    """Share of ions whose nearest neighbour is closer than ``least``.

    sampled: how many ions were looked at.  rows: of so many sampled ions among themselves instead, a
    quick report whose distances are too long."""
    if rows is not None:
        points = points.orderBy(F.xxhash64(key, F.lit(seed))).limit(rows)
    near = nearest(points, key, axes, 1, least)
    return near.agg(F.count(F.lit(1)).alias("sampled"), F.avg((F.col("distance") < least).cast("double")).alias("overlapping"), F.avg("distance").alias("mean_distance"))


def multiplicity(ions: DataFrame, multi: str = "multi") -> DataFrame:
    """Hits by multiplicity, and their shares."""
    counts = ions.groupBy(multi).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def rate(score: float) -> str:
    """A word for a score of 0 to 100."""
    return next(word for least, word in ((80, "excellent"), (60, "good"), (40, "fair"), (0, "poor")) if score >= least)


def detector_maps(hits: DataFrame, size: int, half_width: float, pixels: int = 512) -> DataFrame:
    """Counts per half-overlapping slice and detector pixel."""
    from iontide.operators.bins import half_overlapping

    step = 2 * half_width / pixels
    inside = (F.abs(F.col("detx")) < half_width) & (F.abs(F.col("dety")) < half_width)
    rows = hits.filter(inside).select("detx", "dety", half_overlapping(F.col("ionIdx"), size).alias("slice"))
    return rows.groupBy("slice", *(F.floor((F.col(c) + half_width) / step).cast("int").alias(n) for c, n in (("detx", "px"), ("dety", "py")))).agg(F.count(F.lit(1)).alias("n"))


def outline(hits: DataFrame, sectors: int) -> DataFrame:
    """The radius of the outermost hit in each slice and sector of the detector: a polygon around each slice's hits."""
    angle = angle_of(F.col("detx"), F.col("dety"))
    sector = F.least(F.floor(F.degrees(angle) / (360 / sectors)), F.lit(sectors - 1)).cast("long")
    return hits.groupBy("slice", sector.alias("sector")).agg(F.max(F.sqrt(F.col("detx") * F.col("detx") + F.col("dety") * F.col("dety"))).alias("radius"))
