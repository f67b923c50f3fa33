"""Shares of ions whose peaks overlap: fractions per range, components, and solvers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iontide.functions.stats import chi2_cdf
from iontide.operators.ranging import allocate, interval_join
from iontide.operators.spatial import connected_components

SOLUTION = "component long, ion string, amount double, sigma double, chi2 double, p_value double, detectable boolean"


def fractions(peaks: DataFrame, ranges: DataFrame, first_only: bool = True) -> DataFrame:
    """(ion, rangeIdx, fraction): the share of an ion's isotopes in each range.

    peaks: ion, mc, abundance; ranges: rangeIdx, mcbegin, mcend.  With first_only a peak counts in
    the first of overlapping ranges, else in each."""
    met = interval_join(peaks, "mc", ranges.select("rangeIdx", "mcbegin", "mcend"), "mcbegin", "mcend", 1.0, "inner")
    if first_only:
        met = met.groupBy("ion", "mc", "abundance").agg(F.min("rangeIdx").alias("rangeIdx"))
    return met.groupBy("ion", "rangeIdx").agg(F.sum("abundance").alias("fraction"))


def overlap_components(fractions_: DataFrame) -> DataFrame:
    """The fractions with the component of ions and ranges that they belong to."""
    ranges = fractions_.select(F.concat(F.lit("r"), F.col("rangeIdx").cast("string")).alias("dst"), F.concat(F.lit("i"), F.col("ion")).alias("src"))
    found = connected_components(ranges).select("node", F.xxhash64("component").alias("component"))
    keyed = fractions_.withColumn("node", F.concat(F.lit("i"), F.col("ion")))
    return keyed.join(found, "node").drop("node")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares without negative amounts, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    slack = 1e-12 * max(1.0, np.abs(a.T @ b).max(initial=0))
    for _ in range(10 * n + 10):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        if not len(gradient) or gradient.max() <= slack:
            break
        free[gradient.argmax()] = True
        while True:
            trial = np.zeros(n)
            trial[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (trial <= 0)
            if not low.any():
                x = trial
                break
            step = (x[low] / (x[low] - trial[low])).min()
            x = x + step * (trial - x)
            free &= x > 1e-14
            x[~free] = 0
    return x


def solve(a: np.ndarray, counts: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Amounts, their standard errors, chi squared and its p value; rows weigh by 1 / sqrt(count)."""
    weight = 1 / np.sqrt(np.maximum(counts, 1))
    scaled, target = a * weight[:, None], counts * weight
    if ridge:
        scaled = np.vstack((scaled, np.sqrt(ridge) * np.eye(a.shape[1])))
        target = np.concatenate((target, np.zeros(a.shape[1])))
    x = nnls(scaled, target)
    covariance = np.linalg.pinv(scaled.T @ scaled)
    rest = (counts - a @ x) * weight
    chi2, free = float(rest @ rest), a.shape[0] - int((x > 0).sum())
    return x, np.sqrt(np.maximum(np.diag(covariance), 0)), chi2, 1 - chi2_cdf(chi2, free) if free > 0 else 1.0


def likelihood(a: np.ndarray, counts: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """The multinomial maximum-likelihood amounts, by expectation and maximisation."""
    x = np.full(a.shape[1], counts.sum() / max(1, a.shape[1]))
    seen = np.maximum(a.sum(0), 1e-300)
    for _ in range(rounds):
        model = np.maximum(a @ x, 1e-300)
        new = x * (a.T @ (counts / model)) / seen
        if np.abs(new - x).max(initial=0) <= 1e-10 * max(1.0, counts.sum()):
            return new
        x = new
    return x


def local_likelihood(a: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """``likelihood`` of many rows of counts at once."""
    x = np.repeat(counts.sum(1, keepdims=True) / max(1, a.shape[1]), a.shape[1], 1)
    seen = np.maximum(a.sum(0), 1e-300)
    moving = np.arange(len(x))
    for _ in range(rounds):
        own = x[moving]
        new = own * ((counts[moving] / np.maximum(own @ a.T, 1e-300)) @ a) / seen
        x[moving] = new
        moving = moving[np.abs(new - own).max(1, initial=0) > 1e-10 * np.maximum(1.0, counts[moving].sum(1))]
        if not len(moving):
            break
    return x


def deconvolve(fractions_: DataFrame, counts: DataFrame, method: str = "nnls", ridge: float = 0.0) -> DataFrame:
    """Amounts of all ions, each component solved by itself in one Arrow group.

    fractions_: component, ion, rangeIdx, fraction; counts: rangeIdx, count."""

    def run(key, rows):
        table = rows.pivot_table(index="rangeIdx", columns="ion", values="fraction", aggfunc="sum", fill_value=0.0)
        target = rows.groupby("rangeIdx")["count"].first().reindex(table.index).to_numpy(float)
        a = table.to_numpy(float)
        if method == "mle":
            x = likelihood(a, target)
            _, sigma, chi2, p = solve(a, target)
        else:
            x, sigma, chi2, p = solve(a, target, ridge)
        return pd.DataFrame({"component": key[0], "ion": table.columns, "amount": x, "sigma": sigma, "chi2": chi2, "p_value": p, "detectable": x > 3 * sigma})

    joined = fractions_.join(counts, "rangeIdx", "left").na.fill(0, ["count"])
    return joined.groupBy("component").applyInPandas(run, SOLUTION)


def range_counts(pos: DataFrame, ranges: DataFrame, key: str = "ionIdx") -> DataFrame:
    """Ions in each range; an ion counts in every range that it is in, once."""
    met = interval_join(pos.select(key, "mc"), "mc", ranges.select("rangeIdx", "mcbegin", "mcend"), "mcbegin", "mcend", 1.0, "inner")
    return met.groupBy("rangeIdx").agg(F.count_distinct(key).alias("count"))


def local_identities(pos: DataFrame, ranges: DataFrame, fractions_: DataFrame, radius: float, seed: int, key: str = "ionIdx") -> DataFrame:
    """key, ion: each ranged ion's identity, drawn by the composition of its neighbourhood.

    The counts of ranges among an ion's neighbours give local amounts by maximum likelihood; of the
    ions that its own range may hold, one is drawn by amount times fraction.  The draw is a hash
    of the key and the seed, so results repeat.  fractions_: ion, rangeIdx, fraction (a small table)."""
    from iontide.operators.spatial import within

    table = fractions_.select("ion", "rangeIdx", "fraction").toPandas()
    matrix = table.pivot_table(index="rangeIdx", columns="ion", values="fraction", aggfunc="sum", fill_value=0.0)
    places, names, a = {int(r): k for k, r in enumerate(matrix.index)}, list(matrix.columns), matrix.to_numpy(float)
    first = ranges.select("rangeIdx", "mcbegin", "mcend")
    ranged = allocate(pos.select(key, "x", "y", "z", "mc"), first).filter("rangeIdx is not null").select(key, "x", "y", "z", "rangeIdx")
    near = within(ranged, ranged, key, ["x", "y", "z"], radius, ["rangeIdx"])
    counts = near.groupBy(key, "rangeIdx").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rangeIdx", "n"))).alias("counts"))
    rows = ranged.select(key, "rangeIdx").join(counts, key).withColumn("draw", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))

    def run(batches):
        for batch in batches:
            seen = np.zeros((len(batch), len(places)))
            for k, n in enumerate(batch["counts"]):
                for r, c in dict(n).items():
                    if int(r) in places:
                        seen[k, places[int(r)]] = c
            own = np.array([places.get(int(r), -1) for r in batch["rangeIdx"]], int)
            alone = a[own]
            share = local_likelihood(a, seen, 200) * alone
            share = np.where(share.sum(1, keepdims=True) > 0, share, alone)
            ladder = np.cumsum(share, 1)
            drawn = (batch["draw"].to_numpy()[:, None] > ladder / np.maximum(ladder[:, -1:], 1e-300)).sum(1).clip(0, len(names) - 1)
            yield pd.DataFrame({key: batch[key], "ion": [names[d] if o >= 0 else None for d, o in zip(drawn, own)]})

    kind = pos.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, ion string")
