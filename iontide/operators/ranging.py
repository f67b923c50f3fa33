"""Labelling ions by mass-to-charge ranges, and the algebra of range tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side with at most so many rows is broadcast; beyond it the join shuffles by bucket.
BROADCAST_ROWS = 20_000


def small(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if a count shows that it has few rows, else as it is."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def interval_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float, how: str = "left", closed: bool = True) -> DataFrame:
    """Points with the ranges that they are in, bounds included if closed.

    Ranges are dealt to buckets of a fixed width, so that the join is an equi-join on the
    bucket (hashed, in generated code) with a filter, not a nested loop."""
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(first, last)))
    inside = (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)) if closed else (F.col(at) > F.col(low)) & (F.col(at) < F.col(high))
    keyed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return keyed.join(small(dealt).alias("_r"), (keyed["_bucket"] == F.col("_r._bucket")) & inside, how).drop("_bucket")


def allocate(pos: DataFrame, ranges: DataFrame, at: str = "mc", width: float = 1.0, order: str = "rangeIdx") -> DataFrame:
    """Each row once, with the columns of its range; of overlapping ranges the last counts; null outside all.

    Ranges are gathered by bucket, the last ones first, and joined on the bucket of the row: the first
    that holds the row is its range.  Rows aren't grouped, so equal ones stay apart, and are shuffled
    only where the ranges are too many to broadcast."""
    extra = [c for c in ranges.columns if c not in pos.columns]
    dealt = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("mcbegin") / width), F.floor(F.col("mcend") / width))))
    own = F.struct(order, *(c for c in dict.fromkeys(["mcbegin", "mcend", *extra]) if c != order))
    gathered = dealt.groupBy("_bucket").agg(F.reverse(F.array_sort(F.collect_list(own), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0))).alias("_ranges"))
    joined = pos.withColumn("_bucket", F.floor(F.col(at) / width)).join(small(gathered), "_bucket", "left")
    held = F.filter("_ranges", lambda r: (F.col(at) >= r["mcbegin"]) & (F.col(at) <= r["mcend"]))
    best = joined.withColumn("_best", F.get(held, F.lit(0)))
    return best.select(*pos.columns, *(F.col(f"_best.{c}").alias(c) for c in extra))


def allocate_disjoint(pos: DataFrame, ranges: DataFrame, at: str = "mc", width: float = 1.0) -> DataFrame:
    """As allocate, for ranges that don't overlap: one join and no exchange of ions."""
    return interval_join(pos, at, ranges, "mcbegin", "mcend", width)


def decompose(ranged: DataFrame, atoms: str = "ion") -> DataFrame:
    """A row for each atom of an ion, with atom, isotope and ionComplexity; unranged ions keep one row."""
    rows = ranged.withColumn("ionComplexity", F.when(F.col(atoms).isNotNull(), F.size(atoms))).select("*", F.explode_outer(atoms).alias("_atom"))
    return rows.withColumn("atom", F.col("_atom.element")).withColumn("isotope", F.col("_atom.isotope")).drop("_atom")


def undecompose(rows: DataFrame, key: str = "ionIdx") -> DataFrame:
    """One row for each ion again, without the atom columns."""
    return rows.drop("atom", "isotope", "ionComplexity").dropDuplicates([key])


def unranged(pos: DataFrame, ranges: DataFrame, at: str = "mc", width: float = 1.0) -> DataFrame:
    """Ions in no range, by an anti-join on the bucket with the bounds as its condition."""
    dealt = ranges.select("mcbegin", "mcend", F.explode(F.sequence(F.floor(F.col("mcbegin") / width), F.floor(F.col("mcend") / width))).alias("_bucket"))
    keyed = pos.withColumn("_bucket", F.floor(F.col(at) / width))
    right = small(dealt).alias("_r")
    return keyed.join(right, (keyed["_bucket"] == F.col("_r._bucket")) & keyed[at].between(F.col("_r.mcbegin"), F.col("_r.mcend")), "left_anti").drop("_bucket")


def extents(ranged: DataFrame, *by: str, at: str = "mc") -> DataFrame:
    """The range table that a labelled list of ions implies."""
    return ranged.na.drop(subset=list(by)).groupBy(*by).agg(F.min(at).alias("mcbegin"), F.max(at).alias("mcend"), F.count(F.lit(1)).alias("n"))


def overlaps(ranges: DataFrame, key: str = "rangeName", width: float = 1.0) -> DataFrame:
    """Pairs of ranges that overlap, with the kind: cover (one holds the other) or partial."""
    a = ranges.select(F.col(key).alias("a"), F.col("mcbegin").alias("a_low"), F.col("mcend").alias("a_high"))
    a = a.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a_low") / width), F.floor(F.col("a_high") / width))))
    b = ranges.select(F.col(key).alias("b"), F.col("mcbegin").alias("b_low"), F.col("mcend").alias("b_high"))
    b = b.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("b_low") / width), F.floor(F.col("b_high") / width))))
    met = a.join(b, "_bucket").filter((F.col("a") < F.col("b")) & (F.col("a_low") <= F.col("b_high")) & (F.col("b_low") <= F.col("a_high"))).drop("_bucket").distinct()
    cover = ((F.col("a_low") <= F.col("b_low")) & (F.col("a_high") >= F.col("b_high"))) | ((F.col("b_low") <= F.col("a_low")) & (F.col("b_high") >= F.col("a_high")))
    return met.withColumn("kind", F.when(cover, "cover").otherwise("partial"))


def clip_new_range(begin: float, end: float, taken: list[tuple[float, float]], bin_width: float) -> tuple[float, float]:
    """A new range made to fit between those that exist; raises ValueError if one covers it or it covers one."""
    for low, high in sorted(taken):
        if begin >= low and end <= high or begin <= low and end >= high:
            raise ValueError(f"range {begin}-{end} overlaps {low}-{high} totally")
        if low <= begin <= high:
            begin = high + bin_width
        elif low <= end <= high:
            end = low - bin_width
    return begin, end


def nearest_within(left: DataFrame, at: str, right: DataFrame, to: str, tolerance: float, by: list[str]) -> DataFrame:
    """For each left row the nearest right row within a tolerance, if any; ties go to the smaller value."""
    dealt = right.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(to) / tolerance) + k for k in (-1, 0, 1)))))
    keyed = left.withColumn("_bucket", F.floor(F.col(at) / tolerance))
    gap = F.abs(F.col(at) - F.col(to))
    met = keyed.join(small(dealt), "_bucket").filter(gap <= tolerance).withColumn("_gap", gap)
    extra = [c for c in right.columns]
    best = met.groupBy(*by).agg(F.min(F.struct("_gap", to, *(c for c in extra if c != to))).alias("_best"))
    return left.join(best, by, "left").select(*left.columns, *(F.col(f"_best.{c}").alias(c) for c in extra), F.col("_best._gap").alias("gap"))


def interpolate(x: Column, curve: list[tuple[float, float]]) -> Column:
    """Linear interpolation on a small sorted curve; null outside."""
    out = F.lit(None).cast("double")
    for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
        out = F.when((x >= x0) & (x <= x1), F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out
