"""Species tables against each other: matching policies, tracers, isotope stems, range edits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iontide.functions.ions import compose, parse
from iontide.operators.spectrum import isotope_list


def resolve(saved: DataFrame, present: DataFrame, key: str, policy: str = "expand") -> DataFrame:
    """Saved settings for the species that are present: status matched, new or missing.

    expand keeps all, intersection the matched, strict raises ValueError unless all match."""
    left = saved.withColumn("_saved", F.lit(True))
    both = left.join(present.select(key).distinct().withColumn("_present", F.lit(True)), key, "full")
    status = F.when(F.col("_saved").isNull(), "new").when(F.col("_present").isNull(), "missing").otherwise("matched")
    out = both.withColumn("status", status).drop("_saved", "_present")
    if policy == "strict" and out.filter("status != 'matched'").limit(1).count():
        raise ValueError("saved and present species differ")
    return out.filter("status = 'matched'") if policy == "intersection" else out


def tracer_abundances(table: DataFrame, element: str = "element", abundance: str = "abundance") -> DataFrame:
    """Abundances that sum to 1 per element; sums above 1 are taken as percent."""
    total = F.sum(abundance).over(Window.partitionBy(element))
    share = F.when(total > 1 + 1e-6, F.col(abundance) / 100).otherwise(F.col(abundance))
    shares = table.withColumn(abundance, share)
    return shares.withColumn(abundance, F.col(abundance) / F.sum(abundance).over(Window.partitionBy(element)))


def stems(name: str, isotopes: pd.DataFrame, height: float = 1.0) -> pd.DataFrame:
    """mc and relative height of an ion's isotopic combinations, the tallest at ``height``."""
    atoms, charge = parse(name)
    found = isotope_list(atoms, isotopes)
    found["mc"] = found.weight / max(1, abs(charge))
    found["height"] = found.abundance / found.abundance.max() * height
    return found


def unique_ion_at(ions: pd.DataFrame, begin: float, end: float) -> str | None:
    """The ion with a peak strictly inside a range, if there is just one (ions: ion, mc)."""
    inside = ions[(ions.mc > begin) & (ions.mc < end)].ion.unique()
    return inside[0] if len(inside) == 1 else None


def extend_to_neighbour(ranges: DataFrame, order: str = "mcbegin", gap: float = 0.0) -> DataFrame:
    """Each range's end moved up to its right neighbour's begin, less a gap; the last one stays."""
    after = F.lead("mcbegin").over(Window.partitionBy(F.lit(0)).orderBy(order))
    return ranges.withColumn("mcend", F.coalesce(after - gap, F.col("mcend")))


def automatic_ranges(mc: np.ndarray, counts: np.ndarray, peaks: pd.DataFrame, share: float = 0.05) -> pd.DataFrame:
    """Bounds where a peak has fallen to a share of its height or meets the valley to its neighbour."""
    rows, places = [], np.searchsorted(mc, np.sort(peaks.mc.to_numpy())).clip(0, len(mc) - 1)
    for k, i in enumerate(places):
        low = places[k - 1] if k else 0
        high = places[k + 1] if k + 1 < len(places) else len(mc) - 1
        a = low + int(counts[low : i + 1].argmin()) if k else low
        b = i + int(counts[i : high + 1].argmin()) if k + 1 < len(places) else high
        left = np.flatnonzero(counts[a : i + 1] <= share * counts[i])
        right = np.flatnonzero(counts[i : b + 1] <= share * counts[i])
        rows.append((mc[i], mc[a + left[-1]] if len(left) else mc[a], mc[i + right[0]] if len(right) else mc[b]))
    return pd.DataFrame(rows, columns=["mc", "mcbegin", "mcend"])


def field_from_curves(ratio: float, curve_a: pd.DataFrame, curve_b: pd.DataFrame) -> float | None:
    """The field where two charge states' curves (field, share) have a ratio; None outside them."""
    fields = np.union1d(curve_a.field, curve_b.field)
    a, b = (np.interp(fields, c.field, c.share) for c in (curve_a, curve_b))
    good = b > 0
    ratios, fields = (a[good] / b[good]), fields[good]
    order = np.argsort(ratios)
    ratios, fields = ratios[order], fields[order]
    if not len(ratios) or not ratios[0] <= ratio <= ratios[-1]:
        return None
    return float(np.interp(ratio, ratios, fields))


def species_label(element: str, isotope: int | None, charge: int) -> str:
    return compose([(element, isotope)], charge)
