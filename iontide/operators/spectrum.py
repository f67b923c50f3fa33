"""Mass spectra as small histograms: peaks, automatic ranges, backgrounds, isotopes, assignment.

A spectrum has some 10^4 bins however many ions it counts, so these functions take its arrays;
``per_spectrum`` runs them on many spectra at once, each in one Arrow group."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from iontide.operators.ranging import interval_join

PEAKS = "mc double, height double, prominence double, snr double, width_bins double, width_da double, left_mc double, right_mc double, area double"


def per_spectrum(histograms: DataFrame, by: str, function: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """function(mc, counts) of each group's histogram."""

    def run(key, rows):
        rows = rows.sort_values("mc")
        out = function(rows["mc"].to_numpy(), rows["counts"].to_numpy(float))
        out.insert(0, by, key[0])
        return out

    kind = histograms.schema[by].dataType.simpleString()
    return histograms.groupBy(by).applyInPandas(run, f"`{by}` {kind}, {schema}")


def windows(values: np.ndarray, half: int) -> np.ndarray:
    """Each place's neighbourhood as a row, NaN beyond the ends."""
    padded = np.concatenate((np.full(half, np.nan), values, np.full(half, np.nan)))
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1)


def smooth(values: np.ndarray, half: int = 3, degree: int = 2) -> np.ndarray:
    """Least-squares polynomial smoothing; the ends use the first and last full window."""
    n = 2 * half + 1
    if len(values) < n:
        return values.astype(float)
    x = np.arange(-half, half + 1)
    design = np.vander(x, degree + 1, increasing=True)
    hat = design @ np.linalg.pinv(design)
    out = np.convolve(values, hat[half][::-1], "same")
    out[:half] = hat[:half] @ values[:n]
    out[-half:] = hat[half + 1 :] @ values[-n:]
    return out


def prominences(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far each peak stands above the higher of the two lowest points before higher ground."""
    out = np.empty(len(at))
    for k, i in enumerate(at):
        left, right = y[:i][::-1], y[i + 1 :]
        a = np.flatnonzero(left > y[i])
        b = np.flatnonzero(right > y[i])
        low_left = left[: a[0] if len(a) else len(left)].min(initial=y[i])
        low_right = right[: b[0] if len(b) else len(right)].min(initial=y[i])
        out[k] = y[i] - max(low_left, low_right)
    return out


def find_peaks(mc: np.ndarray, counts: np.ndarray, min_snr: float = 4.0, baseline_da: float = 2.0, quantile: float = 0.2, half: int = 2) -> pd.DataFrame:
    """Peaks above a moving-quantile baseline, by prominence over the local noise (MAD)."""
    names = [c.split()[0] for c in PEAKS.split(",")]
    if len(mc) < 5:
        return pd.DataFrame(columns=names, dtype=float)
    width = float(np.median(np.diff(mc)))
    span = max(2, int(baseline_da / width / 2))
    base = np.nanquantile(windows(counts, span), quantile, axis=1)
    y = smooth(counts, half)
    middle = np.nanmedian(windows(counts, span), axis=1)
    noise = 1.4826 * np.nanmedian(np.abs(windows(counts, span) - middle[:, None]), axis=1)
    noise = np.maximum(noise, np.sqrt(np.maximum(base, 1)))
    inner = (y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] > base[1:-1])
    at = np.flatnonzero(inner) + 1
    tall = prominences(y, at)
    keep = tall >= min_snr * noise[at]
    rows = []
    for i, p in zip(at[keep], tall[keep]):
        level = y[i] - p / 2
        a = i - int(np.argmax(y[: i + 1][::-1] < level)) if (y[:i] < level).any() else 0
        b = i + int(np.argmax(y[i:] < level)) if (y[i:] < level).any() else len(y) - 1
        left = np.interp(level, [y[a], y[min(a + 1, i)]], [mc[a], mc[min(a + 1, i)]]) if a < i else mc[a]
        right = np.interp(-level, [-y[max(b - 1, i)], -y[b]], [mc[max(b - 1, i)], mc[b]]) if b > i else mc[b]
        area = float(np.maximum(counts[a : b + 1] - base[a : b + 1], 0).sum())
        rows.append((mc[i], y[i], p, p / noise[i], (right - left) / width, right - left, left, right, area))
    return pd.DataFrame(rows, columns=names, dtype=float)


def sqrt_background(mc: np.ndarray, counts: np.ndarray, free: np.ndarray) -> float:
    """The amplitude A of a background A / sqrt(mc) per bin, least squares on bins outside all ranges."""
    x = 1 / np.sqrt(mc[free])
    return float((x * counts[free]).sum() / (x * x).sum()) if free.any() else 0.0


def gap_background(mc: np.ndarray, counts: np.ndarray, ranges: Sequence[tuple[float, float]]) -> np.ndarray:
    """The counts outside ranges, and inside them a line between the means beside each range."""
    out = counts.astype(float).copy()
    inside = np.zeros(len(mc), bool)
    for a, b in ranges:
        inside |= (mc >= a) & (mc <= b)
    free = np.flatnonzero(~inside)
    if len(free):
        out[inside] = np.interp(mc[inside], mc[free], smooth(counts[free].astype(float), 3))
    return out


def peak_counts(mc: np.ndarray, counts: np.ndarray, region: tuple[float, float, float, float], method: str = "linear") -> dict[str, float]:
    """Raw, background and corrected counts of a peak between region[1] and [2], the background beside it."""
    a, p, q, b = region
    peak = (mc >= p) & (mc <= q)
    side = ((mc >= a) & (mc < p)) | ((mc > q) & (mc <= b))
    x, y = mc[side], counts[side]
    if method == "exponential" and (y > 0).sum() >= 2:
        fit = np.polyfit(x[y > 0], np.log(y[y > 0]), 1)
        under = np.exp(np.polyval(fit, mc[peak]))
    elif method == "constant" or len(x) < 2:
        under = np.full(peak.sum(), y.mean() if len(y) else 0.0)
    else:
        under = np.polyval(np.polyfit(x, y, 1), mc[peak])
    raw, background = float(counts[peak].sum()), float(under.sum())
    top = int(np.argmax(np.where(peak, counts, -np.inf)))
    return {"location": float(mc[top]), "raw": raw, "background": background, "corrected": raw - background, "signal_to_background": (raw - background) / background if background else math.inf}


def range_counts_corrected(histogram: DataFrame, ranges: DataFrame, margin: float, ions: int) -> DataFrame:
    """Per range: raw, background and corrected counts, ppm of all ions, and the share of all corrected counts.

    histogram: bin, mc, counts with the empty bins; the background is the line fitted to the bins of a
    margin on both sides.  Bins are few, so ranges are met by buckets as wide as a Dalton."""
    wide = ranges.select("rangeName", "mcbegin", "mcend", (F.col("mcbegin") - margin).alias("_low"), (F.col("mcend") + margin).alias("_high"))
    met = interval_join(histogram, "mc", wide, "_low", "_high", 1.0, "inner")
    inside = F.col("mc").between(F.col("mcbegin"), F.col("mcend"))
    side = lambda c: F.when(~inside, F.col(c))
    sums = met.groupBy("rangeName").agg(
        F.coalesce(F.sum(F.when(inside, F.col("counts"))), F.lit(0)).alias("raw"),
        F.count_if(inside).alias("_n"),
        F.sum(F.when(inside, F.col("mc"))).alias("_mc"),
        F.regr_slope(side("counts"), side("mc")).alias("_slope"),
        F.regr_intercept(side("counts"), side("mc")).alias("_start"),
    )
    background = F.col("_slope") * F.col("_mc") + F.col("_start") * F.col("_n")
    out = sums.withColumn("background", background).withColumn("corrected", F.col("raw") - F.col("background"))
    total = F.sum("corrected").over(Window.partitionBy(F.lit(0)))
    return out.select("rangeName", "raw", "background", "corrected", (F.col("corrected") / F.lit(float(ions)) * 1e6).alias("ppm"), (F.col("corrected") / total).alias("share"))


def resolution(histogram: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per range: the place and height of its highest bin, the full width at half that height, and place over width.

    The width lies between the nearest bins of the range, on either side, that are below the half."""
    met = interval_join(histogram, "mc", ranges.select("rangeName", "mcbegin", "mcend"), "mcbegin", "mcend", 1.0, "inner")
    top = met.groupBy("rangeName").agg(F.max(F.struct("counts", -F.col("mc"))).alias("t")).select("rangeName", F.col("t.counts").alias("height"), (-F.col("t.col2")).alias("place"))
    below = met.join(F.broadcast(top), "rangeName").filter(F.col("counts") * 2 < F.col("height"))
    sides = below.groupBy("rangeName", "place", "height").agg(F.max(F.when(F.col("mc") < F.col("place"), F.col("mc"))).alias("left"), F.min(F.when(F.col("mc") > F.col("place"), F.col("mc"))).alias("right"))
    width = F.col("right") - F.col("left")
    return sides.select("rangeName", "place", "height", width.alias("fwhm"), (F.col("place") / width).alias("resolution"))


def equal_error_range(mc: np.ndarray, counts: np.ndarray, peak: float, background: np.ndarray, purity: float = 1.0) -> tuple[float, float]:
    """Bounds of a peak's range where the signal left out is ``purity`` times the background let in."""
    i = int(np.abs(mc - peak).argmin())
    out = []
    for step in (-1, 1):
        net = (counts - background)[i::step]
        under = background[i::step]
        valley = np.flatnonzero(net <= 0)
        end = valley[0] if len(valley) else len(net) - 1
        signal = np.maximum(net[: end + 1], 0)
        missed = signal.sum() - np.cumsum(signal)
        let_in = purity * np.cumsum(under[: end + 1])
        crossed = np.flatnonzero(missed <= let_in)
        k = int(crossed[0]) if len(crossed) else end
        place = mc[i::step]
        if k:
            d0, d1 = missed[k - 1] - let_in[k - 1], missed[k] - let_in[k]
            share = d0 / (d0 - d1) if d0 != d1 else 1.0
            out.append(place[k - 1] + share * (place[k] - place[k - 1]))
        else:
            out.append(place[0])
    return float(out[0]), float(out[1])


def isotope_list(atoms: Sequence[tuple[str, int | None]], isotopes: pd.DataFrame, least: float = 0.0) -> pd.DataFrame:
    """All isotope combinations of an ion with their weight and abundance; isotopes: element, isotope, weight, abundance (shares)."""
    table: dict[tuple, list[float]] = {(): [0.0, 1.0]}
    for element, isotope in atoms:
        own = isotopes[isotopes.element == element]
        own = own if isotope is None else own[own.isotope == isotope]
        shares = own.abundance if isotope is None else np.ones(len(own))
        new: dict[tuple, list[float]] = {}
        for key, (weight, share) in table.items():
            for i, w, s in zip(own.isotope, own.weight, shares):
                k = tuple(sorted((*key, (element, int(i)))))
                new.setdefault(k, [weight + w, 0.0])[1] += share * s
        table = new
    rows = [(k, w, s) for k, (w, s) in table.items() if s >= least]
    return pd.DataFrame(rows, columns=["isotopes", "weight", "abundance"]).sort_values("weight", ignore_index=True)


def complex_ions(elements: Sequence[str], most: int, isotopes: pd.DataFrame, charges: Sequence[int] = (1, 2)) -> pd.DataFrame:
    """Isotopic ions of up to ``most`` atoms in each charge state, with mc."""
    rows = []
    for n in range(1, most + 1):
        for atoms in itertools.combinations_with_replacement(sorted(elements), n):
            found = isotope_list([(e, None) for e in atoms], isotopes)
            for c in charges:
                rows += [(" ".join(atoms), c, r.isotopes, r.weight / c, r.abundance) for r in found.itertuples()]
    return pd.DataFrame(rows, columns=["ion", "charge", "isotopes", "mc", "abundance"])


def merge_peaks(weights: np.ndarray, abundances: np.ndarray, margin: float) -> pd.DataFrame:
    """Neighbouring weights closer than a margin become one, at the mean by abundance."""
    order = np.argsort(weights)
    w, a = weights[order], abundances[order]
    group = np.concatenate(([0], np.cumsum(np.diff(w) > margin)))
    total = np.bincount(group, a)
    return pd.DataFrame({"weight": np.bincount(group, w * a) / total, "abundance": total})


def assign(peaks: pd.DataFrame, candidates: pd.DataFrame, tolerance: float, least: float = 0.3) -> pd.DataFrame:
    """Ions for peaks, greedily by score = matched abundance * cosine of the pattern with the areas.

    candidates: ion, charge, mc, abundance."""
    rows = []
    for (ion, charge), own in candidates.groupby(["ion", "charge"]):
        place = np.abs(peaks.mc.to_numpy()[:, None] - own.mc.to_numpy()).argmin(0) if len(peaks) else np.zeros(0, int)
        gap = np.abs(peaks.mc.to_numpy()[place] - own.mc.to_numpy()) if len(peaks) else np.zeros(0)
        hit = gap <= tolerance
        if not hit.any():
            continue
        areas, share = np.where(hit, peaks.area.to_numpy()[place], 0), own.abundance.to_numpy()
        cosine = float(areas @ share / (np.linalg.norm(areas) * np.linalg.norm(share) + 1e-300))
        rows.append((ion, charge, float(share[hit].sum() / share.sum()) * cosine, frozenset(place[hit].tolist())))
    used: set[int] = set()
    out = []
    for ion, charge, score, place in sorted(rows, key=lambda r: (-r[2], len(r[0].split()), r[0], r[1])):
        if score >= least and not place <= used:
            out += [(ion, charge, score, float(peaks.mc.iloc[p])) for p in sorted(place - used)]
            used |= place
    return pd.DataFrame(out, columns=["ion", "charge", "score", "mc"])


def compare(frame: DataFrame, dataset: str, x: str, width: float) -> DataFrame:
    """Normalised spectra of several datasets in one aggregate."""
    bins = frame.groupBy(dataset, F.floor(F.col(x) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("counts"))
    return bins.withColumn("share", F.col("counts") / F.sum("counts").over(Window.partitionBy(dataset)))
