"""Column types of the engine's tables. Row order is never implied: ``ionIdx`` carries it."""

from __future__ import annotations

from pyspark.sql import DataFrame

ATOM = "struct<element:string,isotope:int>"
POS = "ionIdx bigint, x double, y double, z double, mc double"
EPOS = POS + ", tof double, VDC double, VP double, detx double, dety double, deltaP bigint, multi bigint, atomNum bigint"
RAW = "ionIdx bigint, tof double, VDC double, VP double, detx double, dety double, laserIntensity double, startCounter double"
RANGES = f"rangeName string, chargeState int, mcbegin double, mcend double, volume double, ion array<{ATOM}>, color array<double>"
ISOTOPES = "element string, isotope int, weight double, abundance double, atomicNumber int"
VERTICES = "vid bigint, x double, y double, z double"
FACES = "fid bigint, v0 bigint, v1 bigint, v2 bigint"
METADATA = "path string, format string, value string, unit string"

UNITS = {"ionIdx": "1", "x": "nm", "y": "nm", "z": "nm", "mc": "Da", "tof": "ns", "VDC": "V", "VP": "V", "detx": "mm", "dety": "mm", "deltaP": "1", "multi": "1", "atomNum": "1"}


def with_units(frame: DataFrame) -> DataFrame:
    """The frame with each known column's unit in its metadata."""
    for name in frame.columns:
        if name in UNITS:
            frame = frame.withMetadata(name, {"unit": UNITS[name]})
    return frame
