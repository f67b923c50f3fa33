"""End-to-end plans: files to composition, profiles, raw data to a reconstruction, automatic analysis."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iontide.functions.physics import tof_to_mc
from iontide.operators import bins, calibration, composition, profiles, ranging, reconstruction, spectrum
from iontide.sources import instrument


def compositions_of_files(spark: SparkSession, path: str, kind: str, ranges: DataFrame, det_eff: float = 1.0, atomic: bool = True) -> DataFrame:
    """Composition of every file below a path, in one job; the file is a column."""
    ranged = ranging.allocate_disjoint(instrument.read_records(spark, path, kind), ranges)
    if atomic:
        ranged, species = ranging.decompose(ranged), "atom"
    else:
        species = "rangeName"
    return composition.composition(ranged, species, det_eff, [composition.UNRANGED], ["file"])


def concentration_profile(ranged: DataFrame, distance, width: float, species: str = "ion") -> DataFrame:
    """Shares of species along a distance, in one aggregate."""
    cells = bins.grid(ranged.withColumn("distance", distance), [("distance", width)], species)
    return bins.cell_composition(cells, ["bin_distance"])


def reconstruct_raw(raw: DataFrame, peak: tuple[float, float], length_mm: float, t0: float, rounds: int = 3, **options) -> DataFrame:
    """Clean, convert, calibrate, and place raw hits."""
    mc = tof_to_mc(F.col("tof"), F.col("VDC"), F.col("detx"), F.col("dety"), length_mm, t0)
    calibrated = calibration.calibrate(calibration.clean_raw(raw).withColumn("mc", mc), peak, rounds)
    return reconstruction.constant_density(calibrated, **options)


def automatic(pos: DataFrame, candidates: pd.DataFrame, width: float = 0.02, tolerance: float = 0.1) -> tuple[pd.DataFrame, DataFrame]:
    """Peaks, ions for them, ranges around them, and the composition that follows.

    The histogram (some 10**4 rows) is all that reaches the driver."""
    h = bins.filled(bins.histogram(pos, "mc", width), width).orderBy("bin").toPandas()
    peaks = spectrum.find_peaks(h["mc"].to_numpy(), h["counts"].to_numpy(float))
    named = spectrum.assign(peaks, candidates, tolerance)
    bounds = profiles.automatic_ranges(h["mc"].to_numpy(), h["counts"].to_numpy(float), peaks)
    table = bounds.merge(named.drop_duplicates("mc"), on="mc", how="inner").sort_values("mcbegin", ignore_index=True)
    table.insert(0, "rangeIdx", range(len(table)))
    rows = [(int(r.rangeIdx), r.ion, float(r.mcbegin), float(r.mcend)) for r in table.itertuples()]
    ranges = pos.sparkSession.createDataFrame(rows, "rangeIdx int, rangeName string, mcbegin double, mcend double")
    return table, composition.composition(ranging.allocate(pos, ranges), "rangeName", exclude=[composition.UNRANGED])


def each_file(spark: SparkSession, paths: list[str], analysis: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """analysis(path, content) of many files at once; a file that fails gives one row with its error.

    The result has file, error and seconds before the analysis' own columns.  Empty files give no row."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        import time

        for files in batches:
            for path, content in zip(files["path"], files["content"]):
                began, error = time.perf_counter(), None
                try:
                    out = analysis(path, content)
                except Exception as e:  # noqa: BLE001  recorded, as one bad file shouldn't end a batch
                    error, out = f"{type(e).__name__}: {e}", pd.DataFrame([dict.fromkeys(names)])
                yield out.reindex(columns=names).assign(file=path, error=error, seconds=time.perf_counter() - began)[["file", "error", "seconds", *names]]

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "file string, error string, seconds double, " + schema)
