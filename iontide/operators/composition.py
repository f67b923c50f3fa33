"""Composition with counting statistics, in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iontide.functions.physics import efficiency, evaporation_field
from iontide.functions.stats import clopper_pearson_columns, normal_quantile

UNRANGED = "unranged"


def composition(frame: DataFrame, species: str, det_eff: float = 1.0, exclude: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """species, count, concentration and variance, per group of ``by``.

    Ions without a species count as 'unranged'.  Shares are of those not excluded; an excluded
    species has share 0.  The variance is c (1 - c) / n (1 - efficiency), n being the species' count."""
    label = F.coalesce(F.col(species), F.lit(UNRANGED))
    counts = frame.groupBy(*by, label.alias("species")).agg(F.count(F.lit(1)).alias("count"))
    taken = ~F.col("species").isin(list(exclude)) if exclude else F.lit(True)
    total = F.sum(F.when(taken, F.col("count"))).over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    share = F.when(taken, F.col("count") / total).otherwise(0.0)
    out = counts.withColumn("concentration", share)
    c = F.col("concentration")
    return out.withColumn("variance", c * (1 - c) / F.col("count") * (1 - efficiency(det_eff)))


def with_zero_categories(counts: DataFrame, categories: DataFrame, species: str = "species") -> DataFrame:
    """All categories, those without a row with count 0."""
    return categories.select(species).distinct().join(counts, species, "left").na.fill(0)


def wide(long: DataFrame, by: Sequence[str], value: str = "concentration", species: Sequence[str] | None = None) -> DataFrame:
    """A column for each species; only for output."""
    return long.groupBy(*by).pivot("species", list(species) if species else None).agg(F.first(value))


def charge_state_ratio(frame: DataFrame, element: str, charge: str, states: Sequence) -> DataFrame:
    """For each element the share of each charge state among all its ions."""
    total = F.count(F.lit(1))
    return frame.groupBy(element).agg(total.alias("n"), *((F.count_if(F.col(charge) == s) / total).alias(f"ratio_{s}") for s in states))


def uncertainty(count: Column, total: Column, method: str = "poisson", confidence: float = 0.95, background: Column | None = None) -> Column:
    """STRUCT<share, sigma, low, high> of a counted share; method poisson, binomial or clopper-pearson."""
    net = count - (F.lit(0) if background is None else background)
    share = net / total
    z = normal_quantile((1 + confidence) / 2)
    if method == "clopper-pearson":
        exact = clopper_pearson_columns(count, total, confidence)
        sigma = F.sqrt(share * (1 - share) / total)
        return F.struct(share.alias("share"), sigma.alias("sigma"), exact["low"].alias("low"), exact["high"].alias("high"))
    if method == "poisson":
        spread = count if background is None else count + background
        sigma = F.sqrt(spread) / total
    elif method == "binomial":
        sigma = F.sqrt(share * (1 - share) / total)
    else:
        raise ValueError(f"method {method!r}: poisson, binomial or clopper-pearson")
    return F.struct(share.alias("share"), sigma.alias("sigma"), F.greatest(share - z * sigma, F.lit(0.0)).alias("low"), F.least(share + z * sigma, F.lit(1.0)).alias("high"))


def background_removed(ranged: DataFrame, ranges: DataFrame, amplitude: float) -> DataFrame:
    """Counts of each range less the integral of a background amplitude / sqrt(mc), and their shares.

    ranged: ions with rangeName; ranges: rangeName, mcbegin, mcend."""
    counts = ranged.groupBy("rangeName").agg(F.count(F.lit(1)).alias("count"))
    expected = (F.sqrt("mcend") - F.sqrt("mcbegin")) * (2.0 * amplitude)
    out = ranges.select("rangeName", expected.alias("background")).join(counts, "rangeName", "left").na.fill(0, ["count"])
    out = out.withColumn("corrected", F.greatest(F.col("count") - F.col("background"), F.lit(0.0)))
    return out.withColumn("concentration", F.col("corrected") / F.sum("corrected").over(Window.partitionBy(F.lit(0))))


def species_groups(frame: DataFrame, base: str, isotope: str | None = None, charge: str | None = None) -> DataFrame:
    """Counts per species, split by isotope and charge where they are given."""
    keys = [F.coalesce(F.col(base), F.lit(UNRANGED)).alias(base), *(F.col(c) for c in (isotope, charge) if c)]
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(frame: DataFrame, species: str, amounts: dict[str, float], key: str, seed: int = 0) -> DataFrame:
    """Rows of each species by a draw from their key: amounts up to 1 are shares, above 1 counts (as shares of the species' size)."""
    sizes = {r[0]: r[1] for r in frame.filter(F.col(species).isin(list(amounts))).groupBy(species).count().collect()}
    keep = F.lit(False)
    draw = drawn(key, seed)
    for name, amount in amounts.items():
        share = amount if amount <= 1 else min(1.0, amount / max(1, sizes.get(name, 1)))
        keep = keep | ((F.col(species) == name) & (draw < share))
    return frame.filter(keep)


def drawn(key: str, seed: int = 0) -> Column:
    """A number in [0, 1) that a row's key and a seed decide: the first 32 bits of an MD5 sum."""
    text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def sample(frame: DataFrame, rows: int, key: str, seed: int = 0) -> DataFrame:
    """So many rows, those with the least draws; the same in every run."""
    return frame.orderBy(drawn(key, seed), key).limit(rows)


def field_by_species(ratios: DataFrame, constants: DataFrame) -> DataFrame:
    """Field strengths of species by the constants of the same element and charge state.

    ratios: element, charge, ratio; constants: element, charge, a, b; species without constants are left out."""
    met = ratios.join(F.broadcast(constants), ["element", "charge"])
    return met.select("element", "charge", evaporation_field(F.col("ratio"), F.col("a"), F.col("b")).alias("field"))


def with_weights(atoms: DataFrame, isotopes: DataFrame) -> DataFrame:
    """Atoms (atom, isotope) with weight: of the isotope, or the element's mean by abundance where it isn't known."""
    mean = isotopes.groupBy("element").agg((F.sum(F.col("weight") * F.col("abundance")) / F.sum("abundance")).alias("_mean"))
    table = isotopes.select("element", "isotope", "weight").join(mean, "element", "right")
    own = F.broadcast(table.select(F.col("element").alias("atom"), "isotope", F.col("weight").alias("_own")))
    means = F.broadcast(mean.withColumnRenamed("element", "atom"))
    return atoms.join(own, ["atom", "isotope"], "left").join(means, "atom", "left").withColumn("weight", F.coalesce("_own", F.when(F.col("isotope").isNull(), F.col("_mean")))).drop("_own", "_mean")
