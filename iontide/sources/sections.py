"""Sectioned ion files (.apt): a file header, then named sections with their own headers.

All numbers are little-endian.  A section says how long its data are, so unknown ones are passed
over.  Columns that a file lacks are zero."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from iontide.schema import with_units

#: The layout of the two headers.
FILE_HEADER = np.dtype([("signature", "S4"), ("size", "<i4"), ("version", "<i4"), ("name", "<u2", 256), ("created", "<u8"), ("ions", "<u8")])
SECTION_HEADER = np.dtype([
    ("signature", "S4"), ("size", "<i4"), ("version", "<i4"), ("type", "<u2", 32), ("section_version", "<i4"), ("relationship", "<u4"), ("record_type", "<u4"),
    ("data_type", "<u4"), ("bits", "<i4"), ("record_size", "<i4"), ("unit", "<u2", 16), ("records", "<u8"), ("bytes", "<u8"),
])
#: Sections that aren't 32-bit floats.
OTHER_TYPES = {"tstage": "<u2", "FractureGuard": "<u2", "pulseDelta": "<i2", "xstage": "<i4", "ystage": "<i4", "zstage": "<i4", "z": "<u8", "Multiplicity": "<i4", "DetectorCoordinates": "<i4"}
#: Columns of the result and the sections that they come from.
COLUMNS = {"mc": "Mass", "tof": "tof", "VDC": "Voltage", "VP": "Vap", "detx": "XDet_mm", "dety": "YDet_mm"}
SCHEMA = "file string, ionIdx bigint, x double, y double, z double, mc double, tof double, VDC double, VP double, detx double, dety double"
#: Bounds of the positions (six floats) stand before them.
POSITION, BOUNDS_BYTES = "Position", 24
ROWS = 1_000_000


def _text(units: np.ndarray) -> str:
    return units.astype("<u2").tobytes().decode("utf-16-le").split("\0")[0]


def sections(content: bytes) -> tuple[int, dict[str, np.ndarray]]:
    """How many ions, and the data of each section as rows of its elements."""
    head = np.frombuffer(content, FILE_HEADER, 1)[0]
    if head["signature"] != b"APT":
        raise ValueError("not a sectioned ion file")
    at, found = max(int(head["size"]), FILE_HEADER.itemsize), {}
    while at + SECTION_HEADER.itemsize <= len(content):
        own = np.frombuffer(content, SECTION_HEADER, 1, at)[0]
        if own["signature"] != b"SEC":
            break
        name, size = _text(own["type"]), int(own["bytes"])
        at += max(int(own["size"]), SECTION_HEADER.itemsize)
        kind = np.dtype(OTHER_TYPES.get(name, "<f4"))
        elements = max(1, int(own["record_size"]) // kind.itemsize)
        need = int(own["records"]) * elements * kind.itemsize
        # The bounds may or may not be counted in the section's header or bytes.
        if name == POSITION and own["size"] < SECTION_HEADER.itemsize + BOUNDS_BYTES:
            at += BOUNDS_BYTES
            size = need
        found[name] = np.frombuffer(content, kind, need // kind.itemsize, at).reshape(-1, elements)
        at += max(size, need)
    return int(head["ions"]), found


def decode(content: bytes) -> Iterator[pd.DataFrame]:
    n, found = sections(content)
    place = found.get(POSITION, np.zeros((n, 3), np.float32))
    for low in range(0, n, ROWS):
        part = slice(low, min(low + ROWS, n))
        out = pd.DataFrame({"ionIdx": np.arange(part.start + 1, part.stop + 1, dtype=np.int64), **{c: place[part, k].astype(float) for k, c in enumerate("xyz")}})
        for column, name in COLUMNS.items():
            out[column] = found[name][part, 0].astype(float) if name in found else 0.0
        yield out


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """All ions of one or more files, with the file's path."""

    def run(batches):
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                for rows in decode(content):
                    rows.insert(0, "file", name)
                    yield rows

    return with_units(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA))
