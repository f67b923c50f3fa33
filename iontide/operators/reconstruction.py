"""Positions in the specimen from detector hits."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iontide.functions.physics import launch_angle
from iontide.operators.ordered import prefix_sum

BLOCK = 1_000_000


def place(pos: DataFrame, radius: Column, length: float, icf: float) -> DataFrame:
    """x, y and the cap height under the apex of each hit, on a tip of the given radius (nm)."""
    r = F.sqrt(F.col("detx") * F.col("detx") + F.col("dety") * F.col("dety"))
    theta = launch_angle(r, length, icf)
    azimuth = F.atan2(F.col("dety"), F.col("detx"))
    out = pos.withColumn("_radius", radius).withColumn("_theta", theta).withColumn("_azimuth", azimuth)
    d = F.col("_radius") * F.sin("_theta")
    return out.withColumn("x", d * F.cos("_azimuth")).withColumn("y", d * F.sin("_azimuth")).withColumn("_cap", F.col("_radius") * (1 - F.cos("_theta"))).drop("_theta", "_azimuth")


def reconstruct(pos: DataFrame, radius: Column, volume: Column, area_mm2: float, length: float, icf: float, det_eff: float, block: int = BLOCK) -> DataFrame:
    """x, y, z with the depth summed along ionIdx.

    Each ion moves the surface by its volume over the efficiency and the analysed area, which is the
    detector's area scaled down by the magnification length / (icf * radius)."""
    placed = place(pos, radius, length, icf)
    magnification = F.lit(length) / F.lit(icf) / F.col("_radius")
    step = volume / F.lit(det_eff) / (F.lit(area_mm2) / (magnification * magnification))
    summed = prefix_sum(placed, step, "ionIdx", block, "_depth")
    return summed.withColumn("z", F.col("_depth") + F.col("_cap")).drop("_depth", "_cap", "_radius")


def voltage_radius(field: float, kf: float, vdc: Column | None = None) -> Column:
    """Radius from the voltage: V / (kf * F)."""
    return (F.col("VDC") if vdc is None else vdc) / F.lit(field * kf)


def constant_density(pos: DataFrame, length: float = 110.0, det_eff: float = 0.82, density: float = 60.2, field: float = 65.0, kf: float = 3.3, icf: float = 1.65, area_mm2: float = math.pi * 38**2) -> DataFrame:
    """Every ion has the volume 1 / density; the radius follows the voltage."""
    return reconstruct(pos, voltage_radius(field, kf), F.lit(1 / density), area_mm2, length, icf, det_eff)


def custom_radius(pos: DataFrame, function: Callable[[Column], Column], **options) -> DataFrame:
    """The radius as any Column of ionIdx."""
    return reconstruct(pos, function(F.col("ionIdx")), **options)


def shank_radii(start: float, shank_degrees: float, steps: np.ndarray) -> np.ndarray:
    """Radii of a cone with a spherical cap after each relative step (volume over the unit-radius area).

    dz = step / R**2 and dR = dz * k with k = sin a / (1 - sin a), so R**3 grows by 3 k step: the
    recurrence has a closed form."""
    k = math.sin(math.radians(shank_degrees)) / (1 - math.sin(math.radians(shank_degrees)))
    return np.cbrt(start**3 + 3 * k * np.cumsum(steps))


def shank_radius(pos: DataFrame, start: float, shank_degrees: float, step: Column, block: int = BLOCK) -> DataFrame:
    """The frame with radius, by the closed form of ``shank_radii`` on a prefix sum; no sequential pass."""
    k = math.sin(math.radians(shank_degrees)) / (1 - math.sin(math.radians(shank_degrees)))
    summed = prefix_sum(pos, step, "ionIdx", block, "_volume")
    return summed.withColumn("radius", F.cbrt(F.lit(start**3) + F.col("_volume") * (3 * k))).drop("_volume")


def in_triangles(points: DataFrame, corners: pd.DataFrame, x: str = "detx", y: str = "dety") -> DataFrame:
    """The points with new_x, new_y by the barycentric map of the triangle that holds them; null outside.

    corners: one row per triangle with ax, ay, bx, by, cx, cy and the images aX ... cY; a small table,
    which becomes one expression."""
    out = F.lit(None).cast("struct<new_x:double,new_y:double>")
    px, py = F.col(x), F.col(y)
    for t in corners.iloc[::-1].itertuples():
        det = (t.by - t.cy) * (t.ax - t.cx) + (t.cx - t.bx) * (t.ay - t.cy)
        if abs(det) < 1e-15:
            continue
        u = ((px - t.cx) * (t.by - t.cy) + (py - t.cy) * (t.cx - t.bx)) / det
        v = ((px - t.cx) * (t.cy - t.ay) + (py - t.cy) * (t.ax - t.cx)) / det
        w = 1 - u - v
        inside = (u >= -1e-12) & (v >= -1e-12) & (w >= -1e-12)
        image = F.struct((u * t.aX + v * t.bX + w * t.cX).alias("new_x"), (u * t.aY + v * t.bY + w * t.cY).alias("new_y"))
        out = F.when(inside, image).otherwise(out)
    return points.withColumn("_image", out).select("*", "_image.*").drop("_image")
