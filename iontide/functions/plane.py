"""Plane figures in numpy, for outlines of regions and detectors: hulls, clipping, curves."""

from __future__ import annotations

import numpy as np


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, counter-clockwise from the leftmost lowest point."""
    order = np.unique(np.asarray(points, float), axis=0)
    if len(order) < 3:
        return order

    def chain(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(p - out[-2], 0))[2] <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(order) + chain(order[::-1]))


def area(polygon: np.ndarray) -> float:
    x, y = np.asarray(polygon, float).T
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def centroid(polygon: np.ndarray) -> np.ndarray:
    p = np.asarray(polygon, float)
    q = np.roll(p, -1, 0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    return ((p + q) * cross[:, None]).sum(0) / (3 * cross.sum())


def second_moments(polygon: np.ndarray) -> tuple[float, float, float]:
    """Ixx, Iyy and Ixy about the centroid."""
    p = np.asarray(polygon, float) - centroid(polygon)
    q = np.roll(p, -1, 0)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    xx, yy = ((p * p + p * q + q * q) * cross[:, None]).sum(0) / 12
    xy = ((p[:, 0] * q[:, 1] + 2 * p[:, 0] * p[:, 1] + 2 * q[:, 0] * q[:, 1] + q[:, 0] * p[:, 1]) * cross).sum() / 24
    return float(xx), float(yy), float(xy)


def clip(polygon: np.ndarray, point: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The part of a convex polygon left of a directed line."""
    p = np.asarray(polygon, float)
    side = direction[0] * (p[:, 1] - point[1]) - direction[1] * (p[:, 0] - point[0])
    out = []
    for a, b, s, t in zip(p, np.roll(p, -1, 0), side, np.roll(side, -1)):
        if s >= 0:
            out.append(a)
        if s * t < 0:
            out.append(a + s / (s - t) * (b - a))
    return np.array(out).reshape(-1, 2)


def clip_to_box(polygon: np.ndarray, low: tuple[float, float], high: tuple[float, float]) -> np.ndarray:
    for point, direction in ((low, (1, 0)), ((high[0], low[1]), (0, 1)), (high, (-1, 0)), ((low[0], high[1]), (0, -1))):
        polygon = clip(polygon, np.array(point, float), np.array(direction, float))
    return polygon


def simplify(line: np.ndarray, tolerance: float) -> np.ndarray:
    """A polyline without points closer than the tolerance to the simpler line (farthest point first)."""
    p = np.asarray(line, float)
    keep, todo = np.zeros(len(p), bool), [(0, len(p) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along = p[b] - p[a]
        t = np.clip((p[a + 1 : b] - p[a]) @ along / max(along @ along, 1e-300), 0, 1)
        gap = np.linalg.norm(p[a + 1 : b] - p[a] - t[:, None] * along, axis=1)
        if gap.max() > tolerance:
            k = a + 1 + int(gap.argmax())
            keep[k] = True
            todo += [(a, k), (k, b)]
    return p[keep]


def resampled(line: np.ndarray, n: int) -> np.ndarray:
    """n points at equal distances along a polyline."""
    p = np.asarray(line, float)
    at = np.concatenate(([0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))))
    places = np.linspace(0, at[-1], n)
    return np.stack([np.interp(places, at, c) for c in p.T], 1)


def crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points where the edges of two polylines cross."""
    p, r = a[:-1, None], np.diff(a, axis=0)[:, None]
    q, s = b[None, :-1], np.diff(b, axis=0)[None]
    det = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    gap = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * s[..., 1] - gap[..., 1] * s[..., 0]) / det
        u = (gap[..., 0] * r[..., 1] - gap[..., 1] * r[..., 0]) / det
    i, j = np.nonzero((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    return p[i, 0] + t[i, j][:, None] * r[i, 0]


class Curve:
    """A plane curve whose coordinates are polynomials of a parameter, lowest power first."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.polynomial.Polynomial(x), np.polynomial.Polynomial(y)

    @classmethod
    def fit(cls, points: np.ndarray, degree: int) -> Curve:
        """Least squares, the parameter growing with the distance along the points from 0 to 1."""
        p = np.asarray(points, float)
        t = np.concatenate(([0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))))
        t /= t[-1] or 1
        return cls(*(np.polynomial.Polynomial.fit(t, c, degree).convert().coef for c in p.T))

    def __call__(self, t):
        return np.stack((self.x(t), self.y(t)), -1)

    def tangent(self, t):
        return np.stack((self.x.deriv()(t), self.y.deriv()(t)), -1)

    def curvature(self, t):
        dx, dy, ex, ey = self.x.deriv()(t), self.y.deriv()(t), self.x.deriv(2)(t), self.y.deriv(2)(t)
        return (dx * ey - dy * ex) / (dx * dx + dy * dy) ** 1.5

    def length(self, a: float = 0.0, b: float = 1.0, n: int = 64) -> float:
        nodes, weights = np.polynomial.legendre.leggauss(n)
        t = (b - a) / 2 * nodes + (a + b) / 2
        return float((np.linalg.norm(self.tangent(t), axis=-1) * weights).sum() * (b - a) / 2)

    def nearest(self, point: np.ndarray, a: float = 0.0, b: float = 1.0) -> float:
        """The parameter of the nearest point: the ends or a root of the distance's derivative."""
        gap = (self.x - float(point[0])) * self.x.deriv() + (self.y - float(point[1])) * self.y.deriv()
        roots = gap.roots()
        t = np.concatenate(([a, b], roots[np.abs(roots.imag) < 1e-9].real))
        t = t[(t >= a) & (t <= b)]
        return float(t[np.linalg.norm(self(t) - point, axis=-1).argmin()])
