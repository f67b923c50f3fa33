"""Calibration of raw detector data: sums are aggregated, small systems solved, Columns applied."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iontide.functions.geometry import horner
from iontide.functions.physics import AMU, E_CHARGE, flight_length
from iontide.operators import bins
from iontide.storage import cut


def clean_raw(raw: DataFrame, least_tof: float = 50.0, most_tof: float = 5000.0) -> DataFrame:
    """Without impossible flights, negative voltages and empty hits."""
    empty = (F.col("tof") == 0) & (F.col("detx") == 0) & (F.col("dety") == 0)
    return raw.filter(F.col("tof").between(least_tof, most_tof) & (F.col("VDC") >= 0) & ~empty)


def least_squares(frame: DataFrame, terms: Sequence[Column], target: Column) -> np.ndarray:
    """Coefficients of the terms, from the normal equations; one aggregate, a system of few unknowns."""
    n = len(terms)
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)] + [F.sum(terms[i] * target).alias(f"b{i}") for i in range(n)]
    row = frame.agg(*sums).first().asDict()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)], float)
    b = np.array([row[f"b{i}"] or 0.0 for i in range(n)], float)
    return np.linalg.lstsq(a, b, rcond=None)[0]


def regression(frame: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept and r2."""
    return frame.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def length_and_t0(pos: DataFrame, peaks: Sequence[tuple[float, float, float]], length_mm: float) -> tuple[float, float, float]:
    """(flight length in mm, t0 in ns, r2) from peaks (mcLow, mcHigh, ideal mc).

    Flight time = t0 + distance / speed, with the distance scaled to the length sought."""
    ideal = F.lit(None).cast("double")
    for low, high, true in peaks:
        ideal = F.when(F.col("mc").between(low, high), F.lit(float(true))).otherwise(ideal)
    hits = pos.withColumn("_ideal", ideal).filter("_ideal is not null")
    speed = F.sqrt(F.col("VDC") * (2 * E_CHARGE) / (F.col("_ideal") * AMU))
    x = flight_length(F.col("detx"), F.col("dety"), length_mm) / speed * 1e9
    row = regression(hits.select(x.alias("x"), F.col("tof").alias("y")), "x", "y").first()
    return length_mm * row["slope"], row["intercept"], row["r2"]


def voltage_factor(pos: DataFrame, peak: tuple[float, float], sample: int = 1000) -> list[float] | None:
    """Quadratic in V (highest power first) of the peak's place over its mean, by groups of ions in order; None if there are too few.

    All groups count; the fit is one aggregate of sums over them."""
    hits = pos.filter(F.col("mc").between(*peak))
    if hits.limit(100).count() < 100:
        return None
    groups = bins.equal_count(hits, sample, ["ionIdx"], F.floor(F.col("ionIdx") / 1_000_000)).groupBy("slice").agg(F.median("mc").alias("mc"), F.avg("VDC").alias("v"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.filter(F.col("n") == sample))
    mean = groups.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), F.avg("mc").alias("mc")).first()
    if mean["n"] < 3:
        return None
    # In units of the mean voltage, the sums of powers are of one size.
    scaled = [F.pow(F.col("v") / mean["v"], F.lit(k)) for k in (2, 1, 0)]
    return (least_squares(groups, scaled, F.col("mc") / mean["mc"]) / mean["v"] ** np.array([2, 1, 0])).tolist()


def voltage_correction(pos: DataFrame, peak: tuple[float, float], sample: int = 1000) -> DataFrame:
    factor = voltage_factor(pos, peak, sample)
    return pos if factor is None else pos.withColumn("mc", F.col("mc") / F.sqrt(horner(F.col("VDC"), factor)))


def bowl_correction(pos: DataFrame, peak: tuple[float, float], cell: float = 2.0, least: int = 10) -> DataFrame:
    """mc over a quadratic surface of the detector position, fitted to the medians of cells."""
    hits = pos.filter(F.col("mc").between(*peak))
    if hits.limit(100).count() < 100:
        return pos
    grid = hits.groupBy(F.floor(F.col("detx") / cell).alias("i"), F.floor(F.col("dety") / cell).alias("j")).agg(F.median("mc").alias("m"), F.avg("detx").alias("x"), F.avg("dety").alias("y"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    if grid.limit(6).count() < 6:
        return pos
    x, y = F.col("x"), F.col("y")
    terms = lambda a, b: [F.lit(1.0), a, b, a * a, a * b, b * b]
    mean = grid.agg(F.avg("m")).first()[0]
    c = least_squares(grid, terms(x, y), F.col("m") / mean).tolist()
    surface = sum((t * k for t, k in zip(terms(F.col("detx"), F.col("dety")), c)), F.lit(0.0))
    return pos.withColumn("mc", F.col("mc") / surface)


def calibrate(pos: DataFrame, peak: tuple[float, float], rounds: int = 10, sample: int = 1000, cell: float = 2.0) -> DataFrame:
    """Voltage and bowl corrections in turn; each round is checkpointed, so that lineage stays short."""
    for _ in range(rounds):
        pos = cut(bowl_correction(voltage_correction(pos, peak, sample), peak, cell))
    return pos
