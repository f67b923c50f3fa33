"""Neighbours in space: joins over grid cells, statistics of distances, and clusters.

Cells are as wide as the radius, so all neighbours of a point are in its own or an adjoining
cell.  One side is dealt to those cells and met by an equi-join; no cross join is made."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iontide.operators.ordered import prefix_sum
from iontide.operators.ranging import small
from iontide.storage import cut


def _cell(axes: Sequence[str], width: float) -> list[Column]:
    return [F.floor(F.col(c) / width).cast("long").alias(f"_c{k}") for k, c in enumerate(axes)]


def within(left: DataFrame, right: DataFrame, key: str, axes: Sequence[str], radius: float, extra: Sequence[str] = ()) -> DataFrame:
    """(key, other, distance, extra of the other) of all pairs within a radius, a point with itself included.

    Of one table with itself, each pair of cells is met once and its pairs are turned round."""
    if left is right and not extra:
        met = _met(left, right, key, axes, radius, half=True)
        turned = met.filter("_turn").select(F.col("other").alias(key), F.col(key).alias("other"), "distance")
        return met.select(key, "other", "distance").unionByName(turned)
    return _met(left, right, key, axes, radius, extra)


def _met(left: DataFrame, right: DataFrame, key: str, axes: Sequence[str], radius: float, extra: Sequence[str] = (), half: bool = False) -> DataFrame:
    """The left points are dealt to the cells around theirs; half: to their own and the half that follows it, with _turn for the latter."""
    steps = list(itertools.product((-1, 0, 1), repeat=len(axes)))
    if half:
        steps = [s for s in steps if s >= (0,) * len(axes)]
    names = [f"_c{k}" for k in range(len(axes))]
    around = F.explode(F.array(*(F.struct(*((c + s).alias(n) for c, s, n in zip(_cell(axes, radius), step, names)), F.lit(any(step)).alias("_turn")) for step in steps)))
    a = left.select(F.col(key), *axes, around.alias("_at")).select(key, *axes, "_at.*")
    b = right.select(F.col(key).alias("other"), *(F.col(c).alias(f"_{c}") for c in axes), *extra, *(c.alias(n) for c, n in zip(_cell(axes, radius), names)))
    square = sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in axes), F.lit(0.0))
    found = a.join(b, names).withColumn("distance", F.sqrt(square)).filter(F.col("distance") <= radius)
    return found.select(key, "other", "distance", *extra, *(["_turn"] if half else []))


def nearest(points: DataFrame, key: str, axes: Sequence[str], k: int, start: float) -> DataFrame:
    """(key, other, distance, rank) of the k nearest others; the radius doubles for points that have too few.

    Ties go to the smaller key.  Points with fewer than k others in all have fewer rows."""
    return _nearest(points, points, key, axes, k, start, True)


def nearest_between(points: DataFrame, others: DataFrame, key: str, axes: Sequence[str], k: int, start: float) -> DataFrame:
    """As nearest, among the rows of another table with the same columns, a point with the same key included."""
    return _nearest(points, others, key, axes, k, start, False)


def _nearest(points: DataFrame, others: DataFrame, key: str, axes: Sequence[str], k: int, start: float, apart: bool) -> DataFrame:
    """The points that are left are dealt to the cells around them, so after the first round the few of them
    are the small side of the join, broadcast if they are few, and the others are neither dealt nor shuffled."""
    needed = min(k, others.count() - apart)
    todo, radius, found = points, start, None
    while True:
        met = _met(todo, others, key, axes, radius)
        met = met.filter(F.col(key) != F.col("other")) if apart else met
        rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "other"))
        best = met.withColumn("rank", rank).filter(F.col("rank") <= k)
        enough = best.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= needed)
        best = cut(best.join(enough, key).drop("_n"))
        found = best if found is None else found.unionByName(best)
        todo = cut(todo.join(best.select(key).distinct(), key, "left_anti"))
        if needed < 1 or not todo.limit(1).count():
            return found
        todo = small(todo)
        radius *= 2


def nearest_statistics(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("rank").agg(F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("std"), F.median("distance").alias("median"), F.min("distance").alias("min"), F.max("distance").alias("max"))


def clustering_index(mean_nearest: float, density: float) -> float:
    """Above 1 where neighbours are closer than in a random arrangement of that density."""
    return 0.554 * density ** (-1 / 3) / mean_nearest


def pair_correlation(points: DataFrame, key: str, axes: Sequence[str], most: float, width: float, density: float, reference: DataFrame | None = None) -> DataFrame:
    """bin, r, pairs and g(r) in shells; the density is that of the points counted around each."""
    pairs = within(points, points if reference is None else reference, key, axes, most).filter(F.col(key) != F.col("other"))
    shells = pairs.filter(F.col("distance") < most).groupBy(F.floor(F.col("distance") / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))
    n = points.agg(F.count(F.lit(1)).alias("_n"))
    low, high = F.col("bin") * F.lit(width), (F.col("bin") + 1) * F.lit(width)
    volume = (F.pow(high, 3) - F.pow(low, 3)) * (4 / 3 * math.pi)
    return shells.join(F.broadcast(n)).select("bin", ((F.col("bin") + 0.5) * width).alias("r"), "pairs", (F.col("pairs") / (F.col("_n") * density * volume)).alias("g"))


def inner(points: DataFrame, axes: Sequence[str], low: Sequence[float], high: Sequence[float], margin: float) -> DataFrame:
    """Points at least a margin inside a box.

    As the centres of pair_correlation (all points being its reference) they have whole shells: the edges of
    the box need no other correction."""
    deep = F.lit(True)
    for c, a, b in zip(axes, low, high):
        deep = deep & F.col(c).between(a + margin, b - margin)
    return points.filter(deep)


def ripley(points: DataFrame, key: str, axes: Sequence[str], radii: Sequence[float], volume: float) -> DataFrame:
    """K and L of each radius, L being (3 K / 4 pi)^(1/3) - r."""
    radii = sorted(radii)
    pairs = within(points, points, key, axes, radii[-1]).filter(F.col(key) != F.col("other"))
    counted = pairs.agg(*(F.count_if(F.col("distance") <= r).alias(f"_{i}") for i, r in enumerate(radii)))
    n = points.agg(F.count(F.lit(1)).alias("_n"))
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.col(f"_{i}").alias("pairs")) for i, r in enumerate(radii)))).alias("_row")
    k = F.col("pairs") * F.lit(float(volume)) / (F.col("_n") * F.col("_n"))
    return counted.join(F.broadcast(n)).select("_n", rows).select("_n", "_row.*").select("r", "pairs", k.alias("K"), (F.pow(k * (3 / 4 / math.pi), 1 / 3) - F.col("r")).alias("L"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (src, dst) in either direction; component is the least node.

    A round gives each node its least neighbour as parent and follows parents to the roots, each
    step doubling the way.  Edges between nodes of one root vanish, the others are drawn between
    roots, so their number falls from round to round.  Every round is checkpointed."""
    pairs = edges.select("src", "dst")
    both = cut(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    while True:
        roots = both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("root"))
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            farther = cut(roots.join(above, "root").select("node", "root", "next"))
            roots = farther.select("node", F.col("next").alias("root"))
            if not farther.filter("next != root").limit(1).count():
                break
        labels = labels.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
        both = cut(both.join(end("src"), "src").join(end("dst"), "dst").filter("_src != _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
        if not both.limit(1).count():
            return cut(labels)


def dbscan(points: DataFrame, key: str, axes: Sequence[str], epsilon: float, min_points: int) -> DataFrame:
    """key (an integer), cluster (1, 2, ... in order of the clusters' least core key; -1: noise) and is_core.

    Clusters are numbered by sums of blocks of keys, so no task gets all of them.  A point counts among its own neighbours.  A border point goes to the cluster whose number is least."""
    pairs = cut(within(points, points, key, axes, epsilon).select(key, "other"))
    core = cut(pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points).select(key))
    from_core = pairs.join(core, key)
    links = from_core.join(core.select(F.col(key).alias("other")), "other").select(F.col(key).alias("src"), F.col("other").alias("dst"))
    labels = connected_components(links)
    number = prefix_sum(labels.select("component").distinct(), F.lit(1), "component", NUMBER_BLOCK, "cluster").select("component", F.col("cluster").cast("long"))
    cores = labels.join(number, "component").select(F.col("node").alias(key), "cluster")
    border = from_core.join(cores, key).select(F.col("other").alias(key), "cluster").join(cores.select(key), key, "left_anti").groupBy(key).agg(F.min("cluster").alias("cluster"))
    found = cores.withColumn("is_core", F.lit(True)).unionByName(border.withColumn("is_core", F.lit(False)))
    return points.join(found, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))


def cluster_statistics(clustered: DataFrame, axes: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """size, centroid and root-mean-square radius of each cluster."""
    real = clustered.filter(F.col(cluster) > 0)
    spread = sum((F.var_pop(c) for c in axes[1:]), F.var_pop(axes[0]))
    return real.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *(F.avg(c).alias(f"centre_{c}") for c in axes), F.sqrt(spread).alias("rms_radius"))


def size_distribution(experiment: DataFrame, random: DataFrame, size: str = "size") -> DataFrame:
    """How often each cluster size occurs, per width of the gap to its neighbours, in both sets; ratio of the two."""

    def spread(frame: DataFrame, name: str) -> DataFrame:
        counts = frame.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
        w = Window.orderBy(size)
        before, after = F.lag(size).over(w), F.lead(size).over(w)
        width = (F.coalesce(after, F.col(size) + 1) - F.coalesce(before, F.col(size) - 1)) / 2
        return counts.select(size, (F.col("n") / width).alias(name))

    both = spread(experiment, "experiment").join(spread(random, "random"), size, "full").na.fill(0.0, ["experiment", "random"])
    return both.withColumn("ratio", F.when(F.col("random") > 0, F.col("experiment") / F.col("random")))


def smallest_significant(distribution: DataFrame, factor: float = 2.0, size: str = "size") -> int | None:
    """One above the first size that is more than ``factor`` times as frequent as by chance."""
    row = distribution.filter((F.col("ratio") > factor) | (F.col("ratio").isNull() & (F.col("experiment") > 0))).agg(F.min(size)).first()
    return None if row[0] is None else int(row[0]) + 1


def nearest_anchor(points: DataFrame, anchors: DataFrame, axes: Sequence[str], anchor: str, key: str) -> DataFrame:
    """closest and distance of each point to a table of anchors (mesh vertices); ties go to the smaller anchor.

    At most ANCHORS of them are one broadcast array, searched in generated code.  More are met
    by cells, as wide at first as the anchors' mean spacing; keys of points must then be unique."""
    size = anchors.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{m}_{c}") for c in axes for m, f in (("low", F.min), ("high", F.max)))).first()
    if size["n"] > ANCHORS:
        sides = [size[f"high_{c}"] - size[f"low_{c}"] for c in axes]
        spacing = max(sides) / size["n"] ** (1 / len(axes)) or 1.0
        others = anchors.select(F.col(anchor).alias(key), *(F.col(c).cast("double").alias(c) for c in axes))
        found = nearest_between(points.select(key, *axes), others, key, axes, 1, spacing)
        return points.join(found.select(key, F.col("other").alias("closest"), "distance"), key).select(*points.columns, "closest", "distance")
    table = anchors.agg(F.sort_array(F.collect_list(F.struct(F.col(anchor).alias("id"), *(F.col(c).cast("double").alias(c) for c in axes)))).alias("_anchors"))
    gap = lambda a: F.sqrt(sum((F.pow(F.col(c) - a[c], 2) for c in axes), F.lit(0.0)))
    best = F.array_min(F.transform("_anchors", lambda a: F.struct(gap(a).alias("distance"), a["id"].alias("id"))))
    found = points.join(F.broadcast(table)).withColumn("_best", best)
    return found.select(*points.columns, F.col("_best.id").alias("closest"), F.col("_best.distance").alias("distance"))


#: Most anchors that every point is compared with, and the keys of a block of cluster numbers.
ANCHORS, NUMBER_BLOCK = 256, 1_000_000
