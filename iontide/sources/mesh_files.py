"""Mesh and crystal files, small enough for the driver: OBJ, STL, PLY, CIF."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from iontide.schema import FACES, VERTICES

Mesh = tuple[np.ndarray, np.ndarray]


def parse_obj(text: str) -> Mesh:
    """Vertices and triangles; polygons become fans, negative indices count from the end."""
    vertices, faces = [], []
    for line in text.splitlines():
        words = line.split()
        if words[:1] == ["v"]:
            vertices.append([float(w) for w in words[1:4]])
        elif words[:1] == ["f"]:
            own = [int(w.split("/")[0]) for w in words[1:]]
            own = [i - 1 if i > 0 else len(vertices) + i for i in own]
            faces += [(own[0], own[k], own[k + 1]) for k in range(1, len(own) - 1)]
    return np.array(vertices, float).reshape(-1, 3), np.array(faces, int).reshape(-1, 3)


def format_obj(vertices: np.ndarray, faces: np.ndarray, groups: dict[str, np.ndarray] | None = None) -> str:
    lines = ["v {:.9g} {:.9g} {:.9g}".format(*v) for v in vertices]
    for name, rows in (groups or {"mesh": np.arange(len(faces))}).items():
        lines += [f"g {name}", *("f {} {} {}".format(*(faces[r] + 1)) for r in rows)]
    return "\n".join(lines) + "\n"


def parse_stl(content: bytes) -> Mesh:
    """Binary or text; equal corners become one vertex."""
    n = int.from_bytes(content[80:84], "little") if len(content) >= 84 else -1
    if n >= 0 and len(content) == 84 + 50 * n:
        corners = np.frombuffer(content, np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("_", "<u2")]), n, 84)["corner"].reshape(-1, 3)
    else:
        corners = np.array(re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", content)).astype(float).reshape(-1, 3)
    vertices, index = np.unique(corners.astype(float), axis=0, return_inverse=True)
    return vertices, index.reshape(-1, 3)


def format_stl(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    rows = np.zeros(len(faces), np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("_", "<u2")]))
    corner = vertices[faces]
    normal = np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])
    rows["normal"], rows["corner"] = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300), corner
    return b"\0" * 80 + len(faces).to_bytes(4, "little") + rows.tobytes()


def format_ply(vertices: np.ndarray, faces: np.ndarray, colors: np.ndarray | None = None) -> str:
    """Text PLY; colors: 0 ... 255 per vertex."""
    extra = [f"property uchar {c}" for c in ("red", "green", "blue")] if colors is not None else []
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in "xyz"), *extra, f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    tail = [""] * len(vertices) if colors is None else [" {} {} {}".format(*map(int, c)) for c in colors]
    body = ["{:.9g} {:.9g} {:.9g}".format(*v) + t for v, t in zip(vertices, tail)]
    return "\n".join([*head, *body, *("3 {} {} {}".format(*f) for f in faces)]) + "\n"


def parse_cif(text: str) -> dict:
    """Cell lengths and angles, and atom sites (label, x, y, z as fractions)."""
    number = lambda t: float(re.sub(r"\(.*\)", "", t))
    cell = {k: number(v) for k, v in re.findall(r"_cell_(length_[abc]|angle_(?:alpha|beta|gamma))\s+(\S+)", text)}
    sites = []
    for block in re.split(r"\bloop_", text)[1:]:
        lines = [s.strip() for s in block.strip().splitlines()]
        names = [s for s in lines if s.startswith("_atom_site_")]
        if "_atom_site_fract_x" not in names:
            continue
        for row in lines[len(names) :]:
            words = row.split()
            if len(words) < len(names) or row.startswith(("_", "#", "loop_")):
                break
            values = dict(zip(names, words))
            label = values.get("_atom_site_type_symbol") or values.get("_atom_site_label", "")
            sites.append((label, *(number(values[f"_atom_site_fract_{c}"]) for c in "xyz")))
    return {"cell": cell, "sites": sites}


def mesh_frames(spark: SparkSession, mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    vertices, faces = mesh
    v = [(i, *map(float, p)) for i, p in enumerate(vertices)]
    f = [(i, *map(int, t)) for i, t in enumerate(faces)]
    return spark.createDataFrame(v, VERTICES), spark.createDataFrame(f, FACES)
