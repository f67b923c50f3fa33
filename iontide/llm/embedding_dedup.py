"""Near-duplicate embeddings: exact cosine pairs by dual traversal of cover trees.

On the unit sphere a cosine of at least MIN_COSINE is a distance of at most sqrt(2 - 2 * MIN_COSINE).

1. Equal vectors are one class with a weight, so a vector that a third of the rows share is
   one point.
2. The upper level of the tree: up to CENTERS centers are spread over a bounded sample
   (SAMPLE rows; farthest first).  Every class goes to its nearest center, and the covering
   radius of each center is measured over all its classes.
3. Each center's classes are cut into blocks of at most about BLOCK, and each block becomes a
   cover tree: nested levels with halving radii, every node with the true covering radius
   of what is below it.
4. Pairs of centers survive if the distance of the centers is within both radii and the link
   distance.  Blocks are numbered along a path from center to near center, and TILE neighbours by
   number make a tile; a task has all surviving pairs of blocks of two tiles and gets each block of
   them once, so a block isn't sent with every pair.  The dual traversal descends both
   trees: for a pair of nodes the distances of all their children are one matrix product,
   and pairs of children beyond the bound are dropped with all below them.
5. Surviving pairs of points are decided by the cosine in double precision.  Only counts and
   roots leave a task; ``components`` connects the roots.

In unstructured data of many dimensions no bound prunes, and the traversal comes down to
matrix products over all pairs of blocks; that is the price of exact pairs.

Edge cases: vectors that are null, empty, zero or have a null or non-finite component link
with nothing (component_id is their own vec_id); vectors of different lengths never link;
copies count in n_links; rows may repeat; a null vec_id takes part but is never kept; further
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .storage import Stored, bound_batches, read, shuffle_partitions

MIN_COSINE = 0.9
#: Rows of the sample that centers are taken from, and most centers.
SAMPLE, CENTERS = 16_384, 1_024
#: Classes of a block, about; points of a tree's leaf; blocks of a tile.
BLOCK, LEAF, TILE = 2_048, 24, 8
#: For float32 rounding: pairs this much beyond the bound are still looked at.
SLACK = 1e-3


def units(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    scale = np.abs(wide).max(1, keepdims=True)
    wide /= scale
    return wide / np.sqrt((wide * wide).sum(1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nodes as arrays: center (a point), covering radius, and the range of the node's children.

    Node 0 is the root.  A node without children is its center alone.
    """

    def __init__(self, points: np.ndarray):
        self.center, self.radius, self.first, self.count = [0], [0.0], [0], [0]
        todo = [(0, np.arange(len(points)), 2.0)]
        while todo:
            node, members, radius = todo.pop()
            center = self.center[node]
            self.radius[node] = float(distances(points[members], points[center : center + 1]).max())
            if len(members) == 1:
                continue
            groups = [members[i : i + 1] for i in range(len(members))]
            if len(members) > LEAF and self.radius[node] > 1e-6:
                while len(members) > 1 and radius > self.radius[node]:
                    radius /= 2
                groups = self._net(points, members, max(radius / 2, 1e-7))
            self.first[node], self.count[node] = len(self.center), len(groups)
            for g in groups:
                todo.append((len(self.center), g, radius / 2))
                self.center.append(int(g[0]))
                self.radius.append(0.0)
                self.first.append(0)
                self.count.append(0)
        self.center, self.first, self.count = (np.array(x, np.int64) for x in (self.center, self.first, self.count))
        self.radius = np.array(self.radius, np.float32)

    @staticmethod
    def _net(points: np.ndarray, members: np.ndarray, radius: float) -> list[np.ndarray]:
        """Members grouped around centers more than a radius apart, each within the radius of its center."""
        left, groups = members, []
        while len(left):
            # Centers are chosen from the first rows that are left, a batch of distances at a time.
            head = left[:1024]
            near = distances(points[head], points[left]) <= radius
            free = np.ones(len(left), bool)
            for i in range(len(head)):
                if free[i]:
                    own = np.flatnonzero(near[i] & free)
                    own = np.append(i, own[own != i])
                    free[own] = False
                    groups.append(left[own])
            left = left[free]
        return groups

    def children(self, node: int) -> np.ndarray:
        if not self.count[node]:
            return np.array([node])
        return np.arange(self.first[node], self.first[node] + self.count[node])


def dual_traversal(a: CoverTree, b: CoverTree, pa_: np.ndarray, pb: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of points of two trees that may be within the limit; of a tree with itself, each pair once."""
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        left, right = a.children(x), b.children(y)
        for low in range(0, len(left), 512):
            part = left[low : low + 512]
            gap = distances(pa_[a.center[part]], pb[b.center[right]])
            i, j = np.nonzero(gap <= a.radius[part][:, None] + b.radius[right] + limit)
            i, j = part[i], right[j]
            inner = (a.count[i] > 0) | (b.count[j] > 0)
            if a is b and x == y:
                keep = i <= j
                i, j, inner = i[keep], j[keep], inner[keep]
            todo.extend(zip(i[inner].tolist(), j[inner].tolist()))
            if not inner.all():
                yield a.center[i[~inner]], b.center[j[~inner]]


def _links(block_a: tuple, block_b: tuple, same: bool) -> pa.RecordBatch:
    """(node, n_links, root) of the points of two blocks that have links between them."""
    tree_a, nodes_a, weights_a, vectors_a = block_a
    tree_b, nodes_b, weights_b, vectors_b = block_a if same else block_b
    exact_a = units(vectors_a)
    exact_b = exact_a if same else units(vectors_b)
    n = len(nodes_a)
    count = np.zeros(n + len(nodes_b), np.int64)
    edges: list[np.ndarray] = []
    limit = float(np.sqrt(2 - 2 * MIN_COSINE)) + SLACK
    small_a = exact_a.astype(np.float32)
    for i, j in dual_traversal(tree_a, tree_b, small_a, small_a if same else exact_b.astype(np.float32), limit):
        if same:
            i, j = np.minimum(i, j), np.maximum(i, j)
            i, j = i[i != j], j[i != j]
        for low in range(0, len(i), 1 << 17):
            p, q = i[low : low + (1 << 17)], j[low : low + (1 << 17)]
            real = np.einsum("ij,ij->i", exact_a[p], exact_b[q]) >= MIN_COSINE
            p, q = p[real], q[real]
            q = q if same else q + n
            weights = weights_a if same else np.concatenate((weights_a, weights_b))
            np.add.at(count, p, weights[q])
            np.add.at(count, q, weights[p])
            edges.append(np.stack((p, q)))
    nodes = np.concatenate((nodes_a, nodes_b))
    label = np.arange(len(nodes))
    if edges:
        p, q = np.concatenate(edges, 1)
        while True:
            before = label.copy()
            np.minimum.at(label, p, label[q])
            np.minimum.at(label, q, label[p])
            label = label[label]
            if (label == before).all():
                break
    linked = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(count[linked]), pa.array(nodes[label[linked]])], ["node", "n_links", "root"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _spread(vectors: np.ndarray, k: int) -> np.ndarray:
    """k vectors, each the farthest from those before it."""
    chosen, gap = [0], distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(k, len(vectors)) and gap.max() > 1e-6:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def link(frame: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """n_links, component_id and kept for each row of (key, vector)."""
    spark = frame.sparkSession
    bound_batches(spark, 32 << 20)
    n = shuffle_partitions(spark)
    rows = frame.select(F.col(key).alias("vec_id"), F.col(column).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(valid, F.col("embedding")))
    kind = np.dtype(np.float32 if "float" in rows.schema["embedding"].dataType.simpleString() else np.float64)
    grouped = rows.filter(F.col("embedding").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = Stored(grouped.select(F.monotonically_increasing_id().alias("node"), F.size("embedding").alias("dims"), "*"), "embedding-classes").frame

    found = None
    for dims, total in classes.groupBy("dims").count().collect():
        own = classes.filter(F.col("dims") == dims).select("node", "weight", "embedding")
        part = _linked(spark, own, total, kind, n)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "node long, n_links long, root long")
    found = Stored(found, "embedding-links").frame
    labels = components(found.select("node", F.col("root").alias("group")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("group")))).frame
    counts = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    named = classes.join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return rows.join(named, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(spark: SparkSession, classes: DataFrame, total: int, kind: np.dtype, n: int) -> DataFrame:
    sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    centers = _spread(units(_matrix(sample)).astype(np.float32), int(np.clip(total // BLOCK, 1, CENTERS)))
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                gap = distances(units(_matrix(batch.column(2))).astype(np.float32), shared.value)
                cell = gap.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap[np.arange(len(cell)), cell].astype(np.float64))], [*batch.schema.names, "cell", "gap"])

    element = "float" if kind == np.float32 else "double"
    placed = Stored(classes.mapInArrow(assign, f"node long, weight long, embedding array<{element}>, cell int, gap double"), "embedding-cells").frame
    cells = placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).collect()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            cell, block = (batch.column(k).to_numpy() for k in (3, 4))
            for c, b in set(zip(cell.tolist(), block.tolist())):
                at = np.flatnonzero((cell == c) & (block == b))
                held.setdefault((c, b), []).append((batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], _matrix(batch.column(2))[at]))
        for c, b in sorted(held):
            nodes, weights, vectors = (np.concatenate(x) for x in zip(*held.pop((c, b))))
            tree = CoverTree(units(vectors).astype(np.float32))
            packed = pickle.dumps((tree, nodes, weights, vectors.astype(kind)))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([b], pa.int32()), pa.array([packed], pa.binary())], ["cell", "block", "packed"])

    sizes = spark.createDataFrame([(r["cell"], r["blocks"]) for r in cells], "cell int, blocks int")
    blocked = placed.join(F.broadcast(sizes), "cell").select("node", "weight", "embedding", "cell", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    trees = Stored(blocked.repartition(n, "cell", "block").mapInArrow(build, "cell int, block int, packed binary"), "embedding-trees").frame

    limit = float(np.sqrt(2 - 2 * MIN_COSINE)) + SLACK
    radius, blocks = {r["cell"]: r["radius"] for r in cells}, {r["cell"]: r["blocks"] for r in cells}
    gap = distances(centers, centers)
    path = _path(gap, sorted(radius))
    first = dict(zip(path, np.cumsum([0, *(blocks[c] for c in path)]).tolist()))
    # Cells whose points may be linked: at most CENTERS squared, known on the driver by their centers.
    near = [(first[a], first[b], blocks[a], blocks[b]) for a in path for b in path if first[a] <= first[b] and gap[a, b] <= radius[a] + radius[b] + limit]
    pairs = spark.createDataFrame(near, "first_a long, first_b long, blocks_a int, blocks_b int")
    number = lambda s: F.explode(F.sequence(F.col(f"first_{s}"), F.col(f"first_{s}") + F.col(f"blocks_{s}") - 1)).alias(s)
    pairs = pairs.select("*", number("a")).select("a", number("b")).filter("a <= b")
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    pairs = pairs.select("a", "b", F.xxhash64(tile("a"), tile("b")).alias("task"))
    plan = pairs.groupBy("task").agg(F.collect_list(F.struct("a", "b")).alias("pairs")).select("task", F.lit(-1).cast("long").alias("number"), F.lit(None).cast("binary").alias("packed"), "pairs")
    starts = F.broadcast(spark.createDataFrame(list(first.items()), "cell int, first long"))
    numbered = trees.join(starts, "cell").select((F.col("first") + F.col("block")).alias("number"), "packed")
    needed = pairs.select("task", F.explode(F.array("a", "b")).alias("number")).distinct()
    sent = needed.join(numbered, "number").select("task", "number", "packed", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("pairs"))
    tasks = plan.unionByName(sent).repartition(n, "task").sortWithinPartitions("task", "number")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(held: dict, own: list) -> Iterator[pa.RecordBatch]:
            for pair in own:
                yield _links(held[pair["a"]], held[pair["b"]], pair["a"] == pair["b"])

        task, held, own = None, {}, []
        for batch in batches:
            for i in range(len(batch)):
                now, block, packed, pairs_ = (batch.column(k)[i].as_py() for k in range(4))
                if now != task:
                    yield from solved(held, own)
                    task, held, own = now, {}, []
                if packed is None:
                    own = pairs_
                else:
                    held[block] = pickle.loads(packed)
        yield from solved(held, own)

    return tasks.mapInArrow(traverse, "node long, n_links long, root long")


def _path(gap: np.ndarray, cells: list[int]) -> list[int]:
    """The cells in order of a walk that goes on to the nearest one left."""
    left, path = set(cells), []
    while left:
        now = min(left, key=lambda c: (gap[path[-1], c] if path else 0, c))
        path.append(now)
        left.remove(now)
    return path


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "embeddings"))


OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}
), reached(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.dst FROM reached r JOIN links l ON r.other = l.src
), least AS (
  SELECT node, min(other) AS component_id FROM reached GROUP BY node
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE src = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON node = e.vec_id
"""
