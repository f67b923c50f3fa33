"""Operators along an order: prefix sums, moving windows, gaps, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sum(frame: DataFrame, value: Column, order: str, block_size: int, name: str = "prefix") -> DataFrame:
    """The running sum along an integer order, in two passes.

    Blocks of the order are summed, the sums of blocks (few rows) are run up, and each block
    runs up its own rows from there: no task sorts all rows."""
    rows = frame.withColumn("_value", value).withColumn("_block", F.floor(F.col(order) / block_size).cast("long"))
    sums = rows.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, "_block").withColumn(name, F.sum("_value").over(own) + F.col("_before")).drop("_value", "_block", "_before")


def running_minimum(frame: DataFrame, value: str, order: str, block_size: int, name: str = "envelope") -> DataFrame:
    """The least value up to each row along an integer order (a monotone envelope), in two passes like ``prefix_sum``."""
    rows = frame.withColumn("_block", F.floor(F.col(order) / block_size).cast("long"))
    lows = rows.groupBy("_block").agg(F.min(value).alias("_low"))
    before = lows.select("_block", F.min("_low").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(before, "_block").withColumn(name, F.least(F.min(value).over(own), "_before")).drop("_block", "_before")


def moving(bins: DataFrame, value: str, half: int, order: str, by: Sequence[str] = (), quantile: float = 0.5) -> DataFrame:
    """Moving minimum, mean, median, quantile and median absolute deviation over 2 * half + 1 rows; shorter at the ends."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(-half, half)
    out = bins.withColumn("moving_min", F.min(value).over(w)).withColumn("moving_mean", F.avg(value).over(w))
    out = out.withColumn("moving_median", F.percentile(value, F.lit(0.5)).over(w)).withColumn("moving_quantile", F.percentile(value, F.lit(quantile)).over(w))
    return out.withColumn("moving_mad", F.percentile(F.abs(F.col(value) - F.col("moving_median")), F.lit(0.5)).over(w))


def merge_gaps(frame: DataFrame, at: str, gap: Column | float, by: Sequence[str], pick: str | None = None) -> DataFrame:
    """Neighbours closer than a gap form a run; each run's extent, size and, with pick, where pick is greatest."""
    w = Window.partitionBy(*by).orderBy(at)
    apart = F.col(at) - F.lag(at).over(w) > gap
    runs = frame.withColumn("run", F.sum(F.when(apart, 1).otherwise(0)).over(w))
    aggs = [F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")]
    if pick:
        aggs.append(F.max_by(at, F.struct(F.col(pick), -F.col(at))).alias("peak"))
    return runs.groupBy(*by, "run").agg(*aggs)


def local_extrema(bins: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """is_min and is_max of each row against its neighbours."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return bins.withColumn("is_min", (F.col(value) < before) & (F.col(value) <= after)).withColumn("is_max", (F.col(value) > before) & (F.col(value) >= after))


def fill_linear(bins: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Null values between known ones by linear interpolation."""
    keys = by or [F.lit(0)]
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    out = bins.withColumn("_a", F.last(known, True).over(back)).withColumn("_b", F.first(known, True).over(ahead))
    slope = (F.col("_b.y") - F.col("_a.y")) / (F.col("_b.x") - F.col("_a.x"))
    return out.withColumn(value, F.coalesce(F.col(value), F.col("_a.y") + (F.col(order) - F.col("_a.x")) * slope)).drop("_a", "_b")


def asof(left: DataFrame, right: DataFrame, by: str, at: str, to: str, values: Sequence[str]) -> DataFrame:
    """For each left row the values of the last right row of the same key at or before it: one union, one window."""
    kept = [c for c in left.columns if c not in (by, at)]
    a = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*kept).alias("_row"), *(F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values))
    b = right.select(F.col(by).alias("_by"), F.col(to).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values)
    w = Window.partitionBy("_by").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_side") == 0, F.struct(*values)), True).over(w)
    both = a.unionByName(b).withColumn("_found", found).filter("_side = 1")
    return both.select(F.col("_by").alias(by), F.col("_at").alias(at), "_row.*", *(F.col(f"_found.{v}").alias(v) for v in values))


def between_mean(spans: DataFrame, key: str, begin: str, end: str, sensor: DataFrame, at: str, value: str, seconds: int = 86_400) -> DataFrame:
    """The mean of sensor rows within each span, both ends included; null where there are none.

    Spans are dealt to buckets of time, so the join is an equi-join."""
    bucket = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    dealt = spans.withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    met = dealt.join(sensor.select(F.col(at), F.col(value), bucket(at).alias("_bucket")), "_bucket").filter(F.col(at).between(F.col(begin), F.col(end)))
    means = met.groupBy(key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return spans.join(means, key, "left").na.fill(0, ["n"])


def background_trend(blocks: DataFrame) -> DataFrame:
    """slope, intercept and r2 of the background rate along the blocks of ``background_blocks``."""
    return blocks.agg(F.regr_slope("rate", "block").alias("slope"), F.regr_intercept("rate", "block").alias("intercept"), F.regr_r2("rate", "block").alias("r2"))


def background_blocks(ions: DataFrame, at: str, index: str, low: float, high: float, size: int) -> DataFrame:
    """Background rate along the experiment: counts in a window per block of ions, with Poisson errors."""
    block = F.floor(F.col(index) / size).cast("long").alias("block")
    inside = F.count_if(F.col(at).between(low, high))
    out = ions.groupBy(block).agg(F.count(F.lit(1)).alias("ions"), inside.alias("hits"))
    return out.withColumn("rate", F.col("hits") / (F.col("ions") * (high - low))).withColumn("error", F.sqrt("hits") / (F.col("ions") * (high - low)))
