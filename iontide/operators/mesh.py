"""Meshes as tables of vertices and faces: distances, normals, maps, proxigrams, excess."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iontide.operators.ordered import prefix_sum
from iontide.operators.ranging import small
from iontide.operators.spatial import connected_components, nearest_anchor, within


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid and the three corner positions a, b, c of each face."""
    out = faces
    for k, name in enumerate("abc"):
        own = vertices.select(F.col("vid").alias(f"v{k}"), F.struct("x", "y", "z").alias(name))
        out = out.join(own, f"v{k}")
    return out


def _vector(p, q):
    return [F.col(f"{q}.{c}") - F.col(f"{p}.{c}") for c in "xyz"]


def _cross(u, v):
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _norm(u):
    return F.sqrt(u[0] * u[0] + u[1] * u[1] + u[2] * u[2])


def face_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, v0, v1, v2, area and the unit normal nx, ny, nz."""
    normal = _cross(_vector("a", "b"), _vector("a", "c"))
    size = _norm(normal)
    return corners(vertices, faces).select("fid", "v0", "v1", "v2", (size / 2).alias("area"), *((n / size).alias(f"n{c}") for n, c in zip(normal, "xyz")))


def vertex_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A third of each adjoining face's area for each vertex."""
    rows = face_areas(vertices, faces).select("area", F.explode(F.array("v0", "v1", "v2")).alias("vid"))
    return rows.groupBy("vid").agg((F.sum("area") / 3).alias("area"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normals of vertices: the faces' normals weighted by their angles there."""
    placed = corners(vertices, faces)
    normal = _cross(_vector("a", "b"), _vector("a", "c"))
    size = _norm(normal)

    def angle(p, q, r):
        u, v = _vector(p, q), _vector(p, r)
        cosine = (u[0] * v[0] + u[1] * v[1] + u[2] * v[2]) / (_norm(u) * _norm(v))
        return F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))

    parts = F.array(*(F.struct(F.col(f"v{k}").alias("vid"), angle(*order).alias("w")) for k, order in enumerate(("abc", "bca", "cab"))))
    rows = placed.select(*((n / size).alias(f"n{c}") for n, c in zip(normal, "xyz")), F.explode(parts).alias("p")).select("nx", "ny", "nz", "p.*")
    sums = rows.groupBy("vid").agg(*(F.sum(F.col(f"n{c}") * F.col("w")).alias(f"n{c}") for c in "xyz"))
    total = _norm([F.col("nx"), F.col("ny"), F.col("nz")])
    return sums.select("vid", *((F.col(f"n{c}") / total).alias(f"n{c}") for c in "xyz"))


def snapped(vertices: DataFrame, normals: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Vertices moved along their normals by the mean offset of the points within a radius; alone they stay."""
    near = within(vertices, points.select(F.monotonically_increasing_id().alias("vid"), "x", "y", "z", *(F.col(c).alias(f"p{c}") for c in "xyz")), "vid", ["x", "y", "z"], radius, ["px", "py", "pz"])
    own = vertices.join(normals, "vid")
    offset = sum(((F.col(f"p{c}") - F.col(c)) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    shift = near.select("vid", "px", "py", "pz").join(own, "vid").groupBy("vid").agg(F.avg(offset).alias("_shift"), F.count(F.lit(1)).alias("n"))
    moved = own.join(shift, "vid", "left")
    return moved.select("vid", *((F.col(c) + F.col(f"n{c}") * F.coalesce("_shift", F.lit(0.0))).alias(c) for c in "xyz"), F.coalesce("n", F.lit(0)).alias("n"))


def polyline_distance(points: DataFrame, line: Sequence[Sequence[float]]) -> DataFrame:
    """The points with distance, to the nearest of a few joined segments in space (one expression)."""
    gaps = []
    for a, b in zip(line, line[1:]):
        along = [q - p for p, q in zip(a, b)]
        length = sum(v * v for v in along)
        t = sum(((F.col(c) - p) * (v / length) for c, p, v in zip("xyz", a, along)), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        gaps.append(F.sqrt(sum((F.pow(F.col(c) - p - t * v, 2) for c, p, v in zip("xyz", a, along)), F.lit(0.0))))
    return points.withColumn("distance", F.least(*gaps) if len(gaps) > 1 else gaps[0])


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges (src, dst) of one face only."""
    return _edges(faces).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("src", "dst")


def _edges(faces: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return faces.select("fid", F.explode(pairs).alias("e")).select("fid", "e.*")


def pieces(faces: DataFrame) -> DataFrame:
    """fid and the piece of the mesh it belongs to, named by the piece's least vertex."""
    found = connected_components(_edges(faces).select("src", "dst"))
    return faces.join(found.select(F.col("node").alias("v0"), F.col("component").alias("piece")), "v0").select("fid", "piece")


def delocalise(values: DataFrame, faces: DataFrame, value: str) -> DataFrame:
    """The mean of each vertex's value and its neighbours'."""
    edges = _edges(faces).select("src", "dst").distinct()
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(values.select(F.col("vid").alias("src"), F.col("vid").alias("dst")))
    met = both.join(values.select(F.col("vid").alias("dst"), value), "dst")
    return met.groupBy(F.col("src").alias("vid")).agg(F.avg(value).alias(value))


def signed_distance(points: DataFrame, vertices: DataFrame, normals: DataFrame, key: str = "ionIdx") -> DataFrame:
    """closest vertex and signed distance along its normal, of each point."""
    near = nearest_anchor(points, vertices, ["x", "y", "z"], "vid", key)
    own = vertices.join(normals, "vid").select(F.col("vid").alias("closest"), *(F.col(c).alias(f"v{c}") for c in "xyz"), "nx", "ny", "nz")
    along = sum(((F.col(c) - F.col(f"v{c}")) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))
    return near.join(small(own), "closest").select(*near.columns, along.alias("signed"))


def proxigram(distances: DataFrame, species: str, width: float, distance: str = "signed") -> DataFrame:
    """Counts and shares of species by distance from a surface."""
    rows = distances.groupBy(F.floor(F.col(distance) / width).cast("long").alias("bin"), F.coalesce(F.col(species), F.lit("unranged")).alias("species")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("distance", (F.col("bin") + 0.5) * width).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("bin")))


def surface_map(distances: DataFrame, solute, low: float, high: float, distance: str = "signed") -> DataFrame:
    """Per vertex, among ions whose signed distance is within bounds: all, the solutes, and their share."""
    near = distances.filter(F.col(distance).between(min(low, high), max(low, high)))
    return near.groupBy(F.col("closest").alias("vid")).agg(F.count(F.lit(1)).alias("n"), F.count_if(solute).alias("solute")).withColumn("share", F.col("solute") / F.col("n"))


def excess_map(distances: DataFrame, solute, limit: float, areas: DataFrame, distance: str = "signed") -> DataFrame:
    """Solutes within a distance over the area of each vertex."""
    counts = distances.filter(solute & (F.abs(F.col(distance)) <= limit)).groupBy(F.col("closest").alias("vid")).agg(F.count(F.lit(1)).alias("n"))
    return areas.join(counts, "vid", "left").select("vid", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("area")).alias("excess"))


def interfacial_excess(ions: DataFrame, solute, rank: str, limits: tuple[int, int], interface: int, area: float, block: int = 1_000_000) -> float:
    """Excess per area from the cumulative solute count against the cumulative count of all.

    rank numbers ions by distance; lines are fitted below limits[0] and above limits[1], and differ by
    the excess at the interface."""
    rows = prefix_sum(ions, F.when(solute, 1).otherwise(0), rank, block, "solutes")
    fits = rows.withColumn("side", F.when(F.col(rank) <= limits[0], 0).when(F.col(rank) >= limits[1], 1)).filter("side is not null")
    found = {r["side"]: r for r in fits.groupBy("side").agg(F.regr_slope("solutes", rank).alias("slope"), F.regr_intercept("solutes", rank).alias("start")).collect()}
    at = [found[k]["slope"] * interface + found[k]["start"] for k in (0, 1)]
    return float(at[1] - at[0]) / area


def point_triangle(points: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every point and triangle: distance, nearest point, and where it lies (0: inside, 1-3: edges ab, bc, ca, 4-6: corners a, b, c)."""
    p = points[:, None]
    ab, ac, ap = b - a, c - a, p - a
    d1, d2 = (ab * ap).sum(-1), (ac * ap).sum(-1)
    bb, bc_, cc = (ab * ab).sum(-1), (ab * ac).sum(-1), (ac * ac).sum(-1)
    det = np.maximum(bb * cc - bc_ * bc_, 1e-300)
    v, w = (cc * d1 - bc_ * d2) / det, (bb * d2 - bc_ * d1) / det
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)
    nearest = a + v[..., None] * ab + w[..., None] * ac
    where = np.zeros(v.shape, int)
    gap = np.where(inside, ((p - nearest) ** 2).sum(-1), np.inf)
    for k, (s, e, corner_s, corner_e) in enumerate(((a, b, 4, 5), (b, c, 5, 6), (c, a, 6, 4))):
        along = e - s
        t = np.clip(((p - s) * along).sum(-1) / np.maximum((along * along).sum(-1), 1e-300), 0, 1)
        q = s + t[..., None] * along
        d = ((p - q) ** 2).sum(-1)
        better = ~inside & (d < gap - 1e-15)
        gap = np.where(better, d, gap)
        nearest = np.where(better[..., None], q, nearest)
        where = np.where(better, np.where(t <= 0, corner_s, np.where(t >= 1, corner_e, k + 1)), where)
    return np.sqrt(gap), nearest, where


def point_to_mesh(points: DataFrame, mesh: pd.DataFrame, key: str = "ionIdx", step: int = 2048) -> DataFrame:
    """Distance, sign by the face's normal, and place on the closest face, of each point.

    mesh: fid and ax ... cz of each face, which goes to the workers as a broadcast.  A mesh of more than
    MESH_FACES is cut along x; each part is a broadcast and a pass of its own, and a point's nearest of
    all parts is aggregated.  Faces are pruned by their bounding spheres before the exact test."""
    if len(mesh) > MESH_FACES:
        by_x = mesh.sort_values("ax", kind="stable")
        parts = [by_x.iloc[low : low + MESH_FACES] for low in range(0, len(mesh), MESH_FACES)]
        passes = [point_to_mesh(points, part, key, step) for part in parts]
        whole = passes[0]
        for other in passes[1:]:
            whole = whole.unionByName(other)
        names = [c for c in whole.columns if c != key]
        best = F.min(F.struct("distance", "fid", *(c for c in names if c not in ("distance", "fid")))).alias("_best")
        return whole.groupBy(key).agg(best).select(key, *(F.col(f"_best.{c}").alias(c) for c in names))
    tri = {n: mesh[[f"{n}x", f"{n}y", f"{n}z"]].to_numpy(float) for n in "abc"}
    fid = mesh["fid"].to_numpy()
    middle = (tri["a"] + tri["b"] + tri["c"]) / 3
    reach = np.sqrt(np.max([((tri[n] - middle) ** 2).sum(1) for n in "abc"], axis=0))
    normal = np.cross(tri["b"] - tri["a"], tri["c"] - tri["a"])
    shared = points.sparkSession.sparkContext.broadcast((tri, fid, middle, reach, normal))
    del tri, fid, middle, reach, normal

    def solve(own: np.ndarray):
        tri, fid, middle, reach, normal = shared.value
        n = len(own)
        best, where, face = np.empty(n), np.zeros(n, int), np.zeros(n, int)
        nearest = np.empty((n, 3))
        for low in range(0, n, 64):
            part = own[low : low + 64]
            centre = np.sqrt(((part[:, None] - middle) ** 2).sum(-1))
            most = (centre + reach).min(1)
            near = np.flatnonzero((centre - reach <= most[:, None] + 1e-12).any(0))
            d, q, w = point_triangle(part, *(tri[x][near] for x in "abc"))
            k = d.argmin(1)
            r = np.arange(len(part))
            best[low : low + 64], nearest[low : low + 64], where[low : low + 64], face[low : low + 64] = d[r, k], q[r, k], w[r, k], near[k]
        sign = np.where(((own - nearest) * normal[face]).sum(1) < 0, -1.0, 1.0)
        return best, sign * best, nearest, where, fid[face]

    def run(batches):
        for rows in batches:
            for low in range(0, len(rows), step):
                part = rows.iloc[low : low + step]
                d, signed, q, where, face = solve(part[["x", "y", "z"]].to_numpy(float))
                yield pd.DataFrame({key: part[key], "distance": d, "signed": signed, "qx": q[:, 0], "qy": q[:, 1], "qz": q[:, 2], "location": where, "fid": face})

    kind = points.schema[key].dataType.simpleString()
    return points.select(key, "x", "y", "z").mapInPandas(run, f"`{key}` {kind}, distance double, signed double, qx double, qy double, qz double, location int, fid bigint")


#: Most faces of a broadcast.
MESH_FACES = 200_000


def icosphere(radius: float, subdivisions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and faces of a sphere, from the icosahedron by halving edges."""
    g = (1 + 5**0.5) / 2
    v = [(s * a, t * b, 0.0) for s in (1, -1) for t in (1, -1) for a, b in ((1.0, g),)]
    points = np.array([p for q in v for p in (q, (q[2], q[0], q[1]), (q[1], q[2], q[0]))])
    edge = np.sqrt(((points[:, None] - points) ** 2).sum(-1))
    near = np.abs(edge - 2) < 1e-9
    faces = [(i, j, k) for i in range(12) for j in range(i + 1, 12) if near[i, j] for k in range(j + 1, 12) if near[i, k] and near[j, k]]
    faces = [f if np.dot(np.cross(points[f[1]] - points[f[0]], points[f[2]] - points[f[0]]), points[f[0]]) > 0 else (f[0], f[2], f[1]) for f in faces]
    points = list(points / np.linalg.norm(points[0]))
    for _ in range(subdivisions):
        middle: dict[tuple, int] = {}

        def half(a: int, b: int) -> int:
            edge_ = (min(a, b), max(a, b))
            if edge_ not in middle:
                m = points[a] + points[b]
                points.append(m / np.linalg.norm(m))
                middle[edge_] = len(points) - 1
            return middle[edge_]

        faces = [t for a, b, c in faces for ab, bc, ca in ((half(a, b), half(b, c), half(c, a)),) for t in ((a, ab, ca), (b, bc, ab), (c, ca, bc), (ab, bc, ca))]
    return np.array(points) * radius, np.array(faces)
