"""Orientations as 3 x 3 matrices: conversions, misorientation, inverse pole figure colours."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cubic_symmetries() -> np.ndarray:
    """The 24 proper rotations of the cube: signed permutations of determinant 1."""
    out = []
    for order in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            m = np.zeros((3, 3))
            m[range(3), order] = signs
            if np.linalg.det(m) > 0:
                out.append(m)
    return np.array(out)


def from_euler(phi1: float, phi: float, phi2: float) -> np.ndarray:
    """Bunge angles in radians to a matrix."""
    turn_z = lambda t: np.array([[np.cos(t), np.sin(t), 0], [-np.sin(t), np.cos(t), 0], [0, 0, 1]])
    turn_x = np.array([[1, 0, 0], [0, np.cos(phi), np.sin(phi)], [0, -np.sin(phi), np.cos(phi)]])
    return turn_z(phi2) @ turn_x @ turn_z(phi1)


def to_euler(m: np.ndarray) -> tuple[float, float, float]:
    phi = float(np.arccos(np.clip(m[2, 2], -1, 1)))
    if abs(np.sin(phi)) < 1e-12:
        return float(np.arctan2(m[0, 1], m[0, 0]) % (2 * np.pi)), phi, 0.0
    return float(np.arctan2(m[2, 0], -m[2, 1]) % (2 * np.pi)), phi, float(np.arctan2(m[0, 2], m[1, 2]) % (2 * np.pi))


def from_quaternion(q: np.ndarray) -> np.ndarray:
    w, x, y, z = np.asarray(q, float) / np.linalg.norm(q)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + 2 * w * k + 2 * k @ k


def to_quaternion(m: np.ndarray) -> np.ndarray:
    """(w, x, y, z) with w >= 0: the main eigenvector of a symmetric matrix of the entries."""
    a = np.array([
        [m[0, 0] + m[1, 1] + m[2, 2], m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]],
        [0, m[0, 0] - m[1, 1] - m[2, 2], m[0, 1] + m[1, 0], m[0, 2] + m[2, 0]],
        [0, 0, m[1, 1] - m[0, 0] - m[2, 2], m[1, 2] + m[2, 1]],
        [0, 0, 0, m[2, 2] - m[0, 0] - m[1, 1]],
    ])
    _, vectors = np.linalg.eigh(np.triu(a) + np.triu(a, 1).T)
    q = vectors[:, -1]
    return q if q[0] >= 0 else -q


def misorientation(a: np.ndarray, b: np.ndarray, symmetries: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """The least angle (degrees) between two orientations over all symmetric variants, and its axis."""
    s = cubic_symmetries() if symmetries is None else symmetries
    turns = np.einsum("nij,jk,mkl->nmil", s, b @ a.T, s).reshape(-1, 3, 3)
    angles = np.arccos(np.clip((np.trace(turns, axis1=1, axis2=2) - 1) / 2, -1, 1))
    best = turns[angles.argmin()]
    axis = np.array([best[2, 1] - best[1, 2], best[0, 2] - best[2, 0], best[1, 0] - best[0, 1]])
    n = np.linalg.norm(axis)
    return float(np.degrees(angles.min())), axis / n if n > 1e-12 else np.array([1.0, 0, 0])


def misorientation_column(a: Column, b: Column) -> Column:
    """Degrees between two ARRAY<DOUBLE> matrices of nine, by an Arrow function over whole batches."""

    @F.pandas_udf("double")
    def angle(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        p, q = (np.stack(v.to_numpy()).reshape(-1, 3, 3) for v in (x, y))
        turn = np.einsum("nij,nkj->nik", q, p)
        # The trace of s @ turn @ t over all pairs of symmetries, of which t @ s is again one.
        traces = np.einsum("mij,nji->nm", cubic_symmetries(), turn)
        return pd.Series(np.degrees(np.arccos(np.clip((traces.max(1) - 1) / 2, -1, 1))))

    return angle(a, b)


def coincidence(angle: float, axis: np.ndarray, sigmas: pd.DataFrame, tolerance: float = 2.0) -> int | None:
    """The sigma of a table (sigma, angle, h, k, l) that a misorientation is near in angle and axis."""
    own = np.sort(np.abs(axis))
    for r in sigmas.itertuples():
        ideal = np.sort(np.abs([r.h, r.k, r.l])) / np.linalg.norm([r.h, r.k, r.l])
        if abs(angle - r.angle) <= tolerance and np.degrees(np.arccos(np.clip(own @ ideal, -1, 1))) <= tolerance:
            return int(r.sigma)
    return None


def ipf_colour(x: Column, y: Column, z: Column) -> Column:
    """STRUCT<r, g, b> of a crystal direction in the cubic standard triangle.

    The direction is folded by sorting its absolute parts; red, green and blue are its nearness to
    [001], [011] and [111], scaled so that the strongest is 1."""
    folded = F.array_sort(F.array(F.abs(x), F.abs(y), F.abs(z)))
    low, middle, high = folded[0], folded[1], folded[2]
    red, green, blue = high - middle, (middle - low) * np.sqrt(2), low * np.sqrt(3)
    most = F.greatest(red, green, blue)
    return F.struct((red / most).alias("r"), (green / most).alias("g"), (blue / most).alias("b"))


def turned(matrix: np.ndarray, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """A direction in the frame of a crystal with that orientation."""
    return tuple(x * float(r[0]) + y * float(r[1]) + z * float(r[2]) for r in np.asarray(matrix))


def folded_angles(x: Column, y: Column, z: Column) -> Column:
    """STRUCT<theta, phi> in degrees of a direction folded into the cubic standard triangle: from [001], and about it."""
    folded = F.array_sort(F.array(F.abs(x), F.abs(y), F.abs(z)))
    low, middle, high = folded[0], folded[1], folded[2]
    return F.struct(F.degrees(F.atan2(F.sqrt(low * low + middle * middle), high)).alias("theta"), F.degrees(F.atan2(low, middle)).alias("phi"))


def ipf_histogram(rows, x: Column, y: Column, z: Column, width: float, weight: Column | None = None):
    """Bins (theta_bin, phi_bin) of folded directions with their number, weight and share of all weight."""
    from pyspark.sql import Window

    angles = rows.select(folded_angles(x, y, z).alias("a"), (F.lit(1.0) if weight is None else weight).alias("w"))
    bins = angles.groupBy(*(F.floor(F.col(f"a.{c}") / width).cast("long").alias(f"{c}_bin") for c in ("theta", "phi"))).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"))
    return bins.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))
