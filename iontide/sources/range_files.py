"""Range definitions: small text files, parsed on the driver into range tables."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from iontide.functions.ions import canonical, compose
from iontide.schema import RANGES

Range = dict


def _number(text: str) -> float:
    return float(text.replace(",", "."))


def _range(low: float, high: float, atoms: Iterable[tuple[str, int | None]], color: list[float], volume: float = 0.0, charge: int | None = None, name: str | None = None) -> Range:
    atoms = canonical(atoms)
    return {"rangeName": name or compose(atoms) or "unknown", "chargeState": charge, "mcbegin": low, "mcend": high, "volume": volume, "ion": [{"element": e, "isotope": i} for e, i in atoms], "color": color}


def parse_rrng_line(line: str) -> Range | None:
    """``Range3=26.9 27.1 Vol:0.016 Al:1 Color:33FFFF``; None for other lines."""
    m = re.match(r"\s*Range\d+\s*=\s*([\d.,]+)\s+([\d.,]+)(.*)", line)
    if not m:
        return None
    fields = dict(re.findall(r"(\w+):(\S+)", m[3]))
    volume, color, name = _number(fields.pop("Vol", "0")), fields.pop("Color", "000000"), fields.pop("Name", None)
    atoms = [(e, None) for e, n in fields.items() for _ in range(int(n))]
    return _range(_number(m[1]), _number(m[2]), atoms, [int(color[k : k + 2], 16) / 256 for k in (0, 2, 4)], volume, name=name)


def parse_rrng(text: str) -> list[Range]:
    return sorted(filter(None, map(parse_rrng_line, text.splitlines())), key=lambda r: r["mcbegin"])


def format_rrng(ranges: list[Range]) -> str:
    """The text of a range file; colours always with six digits."""
    elements = sorted({a["element"] for r in ranges for a in r["ion"]})
    lines = ["[Ions]", f"Number={len(elements)}", *(f"Ion{i}={e}" for i, e in enumerate(elements, 1)), "", "[Ranges]", f"Number={len(ranges)}"]
    for i, r in enumerate(ranges, 1):
        counts: dict[str, int] = {}
        for a in r["ion"]:
            counts[a["element"]] = counts.get(a["element"], 0) + 1
        color = "".join(f"{min(255, round(c * 256)):02X}" for c in r["color"])
        lines.append(f"Range{i}={r['mcbegin']:.4f} {r['mcend']:.4f} Vol:{r['volume']:.5f} " + " ".join(f"{e}:{n}" for e, n in counts.items()) + f" Color:{color}")
    return "\n".join(lines) + "\n"


def parse_rng(text: str) -> list[Range]:
    """The older table: names with colours, then rows of flags per element; a polyatomic part may follow and takes over ranges within 0.001."""
    parts = re.split(r"---\s*polyatomic extension.*", text, flags=re.I)
    found: list[Range] = []
    for part in parts:
        lines = [line for line in part.splitlines() if line.strip()]
        if not lines or not re.match(r"\s*\d+\s+\d+", lines[0]):
            continue
        n_ions, n_ranges = map(int, lines[0].split()[:2])
        names, colors = [], []
        for k in range(n_ions):
            names.append(lines[1 + 2 * k].strip())
            colors.append([float(v) for v in lines[2 + 2 * k].split()[-3:]])
        rows = [line for line in lines[1 + 2 * n_ions :] if line.lstrip().startswith(".")][:n_ranges]
        for row in rows:
            values = row.replace(".", " ", 1).split()
            low, high, flags = float(values[0]), float(values[1]), [int(v) for v in values[2 : 2 + n_ions]]
            atoms = [(e, None) for name, f in zip(names, flags) for e, n in re.findall(r"([A-Z][a-z]?)(\d*)", name) for _ in range(f * int(n or 1))]
            color = next((c for c, f in zip(colors, flags) if f), [0.0, 0.0, 0.0])
            found = [r for r in found if abs(r["mcbegin"] - low) > 1e-3 or abs(r["mcend"] - high) > 1e-3]
            found.append(_range(low, high, atoms, color))
    return sorted(found, key=lambda r: r["mcbegin"])


def parse_xrng(text: str) -> list[Range]:
    """XML range files; bare ampersands are repaired first."""
    root = ET.fromstring(re.sub(r"&(?!\w+;|#)", "&amp;", text))
    out = []
    for node in root.iter():
        if node.tag.lower().endswith("range"):
            values = {k.lower(): v for k, v in node.attrib.items()} | {c.tag.lower(): (c.text or "") for c in node}
            low, high = (values.get(a) or values.get(b) for a, b in (("mcbegin", "min"), ("mcend", "max")))
            if low and high:
                atoms = [(e, int(i) if i else None) for i, e, n in re.findall(r"(\d*)([A-Z][a-z]?)(\d*)", values.get("ion", "")) for _ in range(int(n or 1))]
                charge = values.get("chargestate") or values.get("charge")
                out.append(_range(_number(low), _number(high), atoms, [0.0, 0.0, 0.0], charge=int(charge) if charge else None))
    return sorted(out, key=lambda r: r["mcbegin"])


PARSERS = {"rrng": parse_rrng, "rng": parse_rng, "xrng": parse_xrng}


def read_ranges(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A range table with rangeIdx, from a file that Spark reads."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    text = spark.read.text(path, wholetext=True).first()[0]
    return ranges_frame(spark, PARSERS[kind](text))


def ranges_frame(spark: SparkSession, ranges: list[Range]) -> DataFrame:
    names = [c.split()[0] for c in ("rangeName", "chargeState", "mcbegin", "mcend", "volume", "ion", "color")]
    rows = [(i, *(r[n] for n in names)) for i, r in enumerate(ranges)]
    return spark.createDataFrame(rows, "rangeIdx int, " + RANGES)
