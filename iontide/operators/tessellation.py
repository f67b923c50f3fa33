"""Delaunay and Voronoi: of small point sets in numpy, of ion lists by blocks with a halo."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iontide.operators.spatial import connected_components


def circumspheres(points: np.ndarray, simplices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and squared radii."""
    first = points[simplices[:, 0]]
    edges = points[simplices[:, 1:]] - first[:, None]
    half = (edges**2).sum(-1) / 2
    centre = np.linalg.solve(edges, half[..., None])[..., 0]
    return first + centre, (centre**2).sum(1)


def settled(points: np.ndarray, jitter: float = 1e-6) -> np.ndarray:
    """The points moved by a tiny fixed jitter, so that no five (four) of them are on a common sphere."""
    span = float(np.ptp(points, axis=0).max()) or 1.0 if len(points) else 1.0
    return points + np.random.default_rng(0).uniform(-1, 1, points.shape) * span * jitter


def delaunay(points: np.ndarray) -> np.ndarray:
    """Simplices of a point set in two or three dimensions, by adding one point at a time.

    Equal points must not occur.  The points are ``settled`` first."""
    n, d = points.shape
    if n <= d:
        return np.zeros((0, d + 1), int)
    span = float(np.ptp(points, axis=0).max()) or 1.0
    moved = settled(points)
    middle = points.mean(0)
    corners = middle + 1000 * span * np.vstack((np.eye(d) * (d + 1) - 1, -np.ones(d)))
    every = np.vstack((moved, corners))
    simplices = np.arange(n, n + d + 1)[None]
    centre, radius = circumspheres(every, simplices)
    for i in range(n):
        hit = ((every[i] - centre) ** 2).sum(1) < radius
        faces = np.concatenate([np.delete(simplices[hit], k, 1) for k in range(d + 1)])
        faces = np.sort(faces, 1)
        faces, count = np.unique(faces, axis=0, return_counts=True)
        fresh = np.column_stack((faces[count == 1], np.full((count == 1).sum(), i)))
        c, r = circumspheres(every, fresh)
        simplices, centre, radius = np.vstack((simplices[~hit], fresh)), np.vstack((centre[~hit], c)), np.concatenate((radius[~hit], r))
    return simplices[(simplices < n).all(1)] if n else simplices[:0]


def edges_of(simplices: np.ndarray) -> np.ndarray:
    """Distinct edges, the smaller end first."""
    d = simplices.shape[1]
    pairs = [np.sort(simplices[:, [i, j]], 1) for i in range(d) for j in range(i + 1, d)]
    return np.unique(np.concatenate(pairs), axis=0) if len(simplices) else np.zeros((0, 2), int)


def simplex_volumes(points: np.ndarray, simplices: np.ndarray) -> np.ndarray:
    own = points[simplices]
    return np.abs(np.linalg.det(own[:, 1:] - own[:, :1])) / math.factorial(points.shape[1])


def boundary(simplices: np.ndarray) -> np.ndarray:
    """Faces of one simplex only."""
    faces = np.concatenate([np.sort(np.delete(simplices, k, 1), 1) for k in range(simplices.shape[1])])
    faces, count = np.unique(faces, axis=0, return_counts=True)
    return faces[count == 1]


def alpha_shape(points: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Simplices with a circumsphere of at most alpha, their boundary, and their volume (area)."""
    simplices = delaunay(points)
    if len(simplices):
        simplices = simplices[circumspheres(settled(points), simplices)[1] <= alpha * alpha]
    return simplices, boundary(simplices) if len(simplices) else np.zeros((0, points.shape[1]), int), float(simplex_volumes(points, simplices).sum())


def cell_volumes(points: np.ndarray, simplices: np.ndarray | None = None) -> np.ndarray:
    """Volumes (areas) of Voronoi cells; NaN for points on the hull, whose cells have no end.

    A cell is the pyramids from its point over the faces to its neighbours; a face's corners are
    the centres of the simplices around the edge."""
    n, d = points.shape
    simplices = delaunay(points) if simplices is None else simplices
    out = np.zeros(n)
    if not len(simplices):
        return np.full(n, np.nan)
    centre, _ = circumspheres(settled(points), simplices)
    around: dict[tuple[int, int], list[int]] = {}
    for s, corners in enumerate(simplices.tolist()):
        for i in range(d + 1):
            for j in range(i + 1, d + 1):
                around.setdefault((min(corners[i], corners[j]), max(corners[i], corners[j])), []).append(s)
    for (i, j), own in around.items():
        along = points[j] - points[i]
        height = float(np.linalg.norm(along)) / 2
        c = centre[own]
        if d == 2:
            size = float(np.linalg.norm(c[0] - c[-1])) if len(own) > 1 else np.nan
        else:
            if len(own) < 3:
                size = np.nan
            else:
                u = np.cross(along, [1.0, 0, 0] if abs(along[0]) < 0.9 * np.linalg.norm(along) else [0, 1.0, 0])
                u /= np.linalg.norm(u)
                v = np.cross(along, u) / np.linalg.norm(along)
                flat = (c - c.mean(0)) @ np.stack((u, v), 1)
                flat = flat[np.argsort(np.arctan2(flat[:, 1], flat[:, 0]))]
                x, y = flat.T
                size = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
        out[i] += size * height / d
        out[j] += size * height / d
    out[np.unique(boundary(simplices))] = np.nan
    out[np.setdiff1d(np.arange(n), simplices)] = np.nan
    return out


def tessellate(points: DataFrame, key: str, axes: Sequence[str], block: float, halo: float) -> tuple[DataFrame, DataFrame]:
    """(key, volume) and Delaunay edges (src, dst) of an ion list, block by block.

    Each block of space gets the ions of a halo around it and keeps what belongs to its own; a
    halo of a few mean distances makes the inner cells complete.  Volumes of ions on the
    outside of all are null."""
    steps = F.array(*(F.lit(k) for k in (-1, 0, 1)))
    rows, keep = points.select(F.col(key).alias("key"), *axes), F.lit(True)
    for k, c in enumerate(axes):
        home = F.floor(F.col(c) / block).cast("long")
        rows = rows.withColumn(f"h{k}", home).select("*", F.explode(steps).alias("_s")).withColumn(f"b{k}", F.col(f"h{k}") + F.col("_s")).drop("_s")
        keep = keep & F.col(c).between(F.col(f"b{k}") * block - halo, (F.col(f"b{k}") + 1) * block + halo)
    names = [f"b{k}" for k in range(len(axes))]
    own = F.lit(True)
    for k in range(len(axes)):
        own = own & (F.col(f"h{k}") == F.col(f"b{k}"))
    rows = rows.filter(keep).select("key", *axes, *names, own.alias("own"))
    kind = points.schema[key].dataType.simpleString()

    def run(block_rows: pd.DataFrame) -> pd.DataFrame:
        block_rows = block_rows.sort_values("key").drop_duplicates(list(axes))
        if not block_rows["own"].any():
            return pd.DataFrame({"key": [], "other": [], "volume": []})
        p, keys, mine = block_rows[list(axes)].to_numpy(float), block_rows["key"].to_numpy(), block_rows["own"].to_numpy()
        simplices = delaunay(p)
        volume = cell_volumes(p, simplices)
        e = edges_of(simplices)
        e = e[mine[e[:, 0]] | mine[e[:, 1]]]
        cells = pd.DataFrame({"key": keys[mine], "other": keys[mine], "volume": volume[mine]})
        return pd.concat((cells, pd.DataFrame({"key": keys[e[:, 0]], "other": keys[e[:, 1]], "volume": np.nan})), ignore_index=True)

    found = rows.groupBy(*names).applyInPandas(run, f"key {kind}, other {kind}, volume double")
    volumes = found.filter("key = other").select(F.col("key").alias(key), F.when(~F.isnan("volume"), F.col("volume")).alias("volume"))
    edges = found.filter("key <> other").select(F.least("key", "other").alias("src"), F.greatest("key", "other").alias("dst")).distinct()
    return volumes, edges


def volume_cutoff(experiment: DataFrame, random: DataFrame, width: float, volume: str = "volume") -> tuple[float, float]:
    """The volume below which the experiment exceeds the random points most, and that excess as a share.

    Both are counted in the same bins."""
    bins = lambda frame, name: frame.filter(F.col(volume).isNotNull()).groupBy(F.floor(F.col(volume) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias(name))
    both = bins(experiment, "e").join(bins(random, "r"), "bin", "full").na.fill(0)
    w = Window.partitionBy(F.lit(0)).orderBy("bin")
    total = Window.partitionBy(F.lit(0))
    summed = both.withColumn("gap", F.sum("e").over(w) / F.sum("e").over(total) - F.sum("r").over(w) / F.sum("r").over(total))
    row = summed.agg(F.max_by("bin", F.struct("gap", -F.col("bin"))).alias("bin"), F.max("gap").alias("gap")).first()
    return (row["bin"] + 1) * width, row["gap"]


def voronoi_clusters(volumes: DataFrame, edges: DataFrame, key: str, cutoff: float, least: int) -> DataFrame:
    """(key, cluster): ions of small cells, connected by Delaunay edges, in groups of at least ``least``."""
    small = volumes.filter(F.col("volume") <= cutoff).select(key)
    inner = edges.join(small.select(F.col(key).alias("src")), "src").join(small.select(F.col(key).alias("dst")), "dst")
    loops = small.select(F.col(key).alias("src"), F.col(key).alias("dst"))
    found = connected_components(inner.select("src", "dst").unionByName(loops))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return found.join(sizes, "component").select(F.col("node").alias(key), F.col("component").alias("cluster"))


def significance_limit(n: int) -> float:
    """The excess that random points reach with little probability."""
    return 1.92 / math.sqrt(n)


def noise_filter(points: pd.DataFrame, limit: float = 0.05) -> pd.Series:
    """Of points in a plane: true for those whose cell is among the smallest share 1 - limit; cells without end are noise."""
    area = cell_volumes(points[["x", "y"]].to_numpy(float))
    return pd.Series(area <= np.nanquantile(area, 1 - limit), index=points.index)
