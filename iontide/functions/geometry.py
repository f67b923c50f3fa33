"""Geometry as Column expressions: regions of interest, hulls, and plane figures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(x: Column, y: Column, z: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    return x.between(low[0], high[0]) & y.between(low[1], high[1]) & z.between(low[2], high[2])


def in_sphere(x: Column, y: Column, z: Column, centre: Sequence[float], radius: float) -> Column:
    return distance2((x, y, z), centre) <= radius * radius


def in_cylinder(x: Column, y: Column, z: Column, centre: Sequence[float], radius: float, height: float) -> Column:
    """Upright, with the centre in the middle."""
    return (distance2((x, y), centre[:2]) <= radius * radius) & z.between(centre[2] - height / 2, centre[2] + height / 2)


def side_of_plane(x: Column, y: Column, z: Column, point: Sequence[float], normal: Sequence[float]) -> Column:
    """The signed distance from a plane."""
    n = np.asarray(normal, float) / np.linalg.norm(normal)
    return (x - point[0]) * float(n[0]) + (y - point[1]) * float(n[1]) + (z - point[2]) * float(n[2])


def distance2(at: Sequence[Column], to: Sequence[float | Column]) -> Column:
    total = None
    for a, b in zip(at, to):
        square = (a - b) * (a - b)
        total = square if total is None else total + square
    return total


def hull_planes(points: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """The planes (nx, ny, nz, offset) of a 3-D hull: n . p + offset >= 0 inside.

    Every triple of points gives a plane; those with all points on one side bound the hull.  For
    the vertices of a region of interest, of which there are few."""
    points, out = np.asarray(points, float), []
    n, middle = len(points), np.asarray(points, float).mean(0)
    scale = np.ptp(points, axis=0).max() * tolerance
    for i in range(n):
        for j in range(i + 1, n):
            normals = np.cross(points[j] - points[i], points[j + 1 :] - points[i])
            for v in normals:
                length = np.linalg.norm(v)
                if length <= scale:
                    continue
                v = v / length
                side = (points - points[i]) @ v
                if side.min() >= -scale or side.max() <= scale:
                    v = v if (middle - points[i]) @ v > 0 else -v
                    out.append(np.append(v, -v @ points[i]))
    return np.unique(np.round(np.array(out), 12), axis=0)


def in_hull(x: Column, y: Column, z: Column, points: np.ndarray, tolerance: float = 0.0) -> Column:
    """Within the convex hull of some points, the boundary included."""
    inside = F.lit(True)
    for a, b, c, d in hull_planes(points).tolist():
        inside = inside & (x * a + y * b + z * c + d >= -tolerance - 1e-12)
    return inside


def point_in_polygon(x: Column, y: Column, polygon: Sequence[tuple[float, float]]) -> Column:
    """Inside by the parity of crossings to the right."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y0 != y1:
            crosses = ((y < y0) != (y < y1)) & (x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0)
            crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def _pairs(polygon: Column) -> Column:
    """Neighbouring points of a closed polygon, ARRAY<STRUCT<x, y>>."""
    return F.arrays_zip(polygon.alias("a"), F.concat(F.slice(polygon, 2, F.size(polygon)), F.slice(polygon, 1, 1)).alias("b"))


def polygon_area(polygon: Column) -> Column:
    """The signed area; positive if the points run counter-clockwise."""
    term = lambda p: (p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]) / 2
    return F.aggregate(_pairs(polygon), F.lit(0.0), lambda s, p: s + term(p))


def polygon_perimeter(polygon: Column) -> Column:
    edge = lambda p: F.sqrt(F.pow(p["b"]["x"] - p["a"]["x"], 2) + F.pow(p["b"]["y"] - p["a"]["y"], 2))
    return F.aggregate(_pairs(polygon), F.lit(0.0), lambda s, p: s + edge(p))


def polygon_centroid(polygon: Column) -> Column:
    """STRUCT<x, y>, by area."""
    cross = lambda p: p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
    along = lambda c: F.aggregate(_pairs(polygon), F.lit(0.0), lambda s, p: s + (p["a"][c] + p["b"][c]) * cross(p)) / (polygon_area(polygon) * 6)
    return F.struct(along("x").alias("x"), along("y").alias("y"))


def line_distance(px: Column, py: Column, line: Sequence[float | Column]) -> Column:
    """From a point to the line (x0, y0, dx, dy)."""
    x0, y0, dx, dy = (c if isinstance(c, Column) else F.lit(float(c)) for c in line)
    return F.abs((px - x0) * dy - (py - y0) * dx) / F.sqrt(dx * dx + dy * dy)


def line_position(px: Column, py: Column, line: Sequence[float | Column]) -> Column:
    """The parameter of a point's projection on the line; 0 at its origin, 1 at origin + direction."""
    x0, y0, dx, dy = (c if isinstance(c, Column) else F.lit(float(c)) for c in line)
    return ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)


def edge_distance(px: Column, py: Column, edge: Sequence[float | Column]) -> Column:
    """From a point to the edge (x1, y1, x2, y2)."""
    x1, y1, x2, y2 = (c if isinstance(c, Column) else F.lit(float(c)) for c in edge)
    at = F.least(F.greatest(line_position(px, py, (x1, y1, x2 - x1, y2 - y1)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - x1 - at * (x2 - x1), 2) + F.pow(py - y1 - at * (y2 - y1), 2))


def lines_cross(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """STRUCT<x, y> where two lines (x0, y0, dx, dy) meet; null if they are parallel."""
    det = a[2] * b[3] - a[3] * b[2]
    t = ((b[0] - a[0]) * b[3] - (b[1] - a[1]) * b[2]) / det
    return F.when(F.abs(det) > 1e-14, F.struct((a[0] + t * a[2]).alias("x"), (a[1] + t * a[3]).alias("y")))


def circle_through(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    """STRUCT<x, y, r> of the circle through three points; null if they are on a line."""
    d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
    sq = lambda p: p[0] * p[0] + p[1] * p[1]
    x = (sq(a) * (b[1] - c[1]) + sq(b) * (c[1] - a[1]) + sq(c) * (a[1] - b[1])) / d
    y = (sq(a) * (c[0] - b[0]) + sq(b) * (a[0] - c[0]) + sq(c) * (b[0] - a[0])) / d
    return F.when(F.abs(d) > 1e-14, F.struct(x.alias("x"), y.alias("y"), F.sqrt(F.pow(a[0] - x, 2) + F.pow(a[1] - y, 2)).alias("r")))


def angle_of(dx: Column, dy: Column) -> Column:
    """The direction's angle in [0, 2 pi)."""
    return F.pmod(F.atan2(dy, dx), F.lit(2 * np.pi))


def horner(x: Column, coefficients: Sequence[float]) -> Column:
    """A polynomial, highest power first."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + float(c)
    return out
