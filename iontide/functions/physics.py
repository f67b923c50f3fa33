"""Closed-form physics as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elementary charge in C, atomic mass constant in kg.
E_CHARGE, AMU = 1.602176634e-19, 1.66053906660e-27


def flight_length(detx: Column, dety: Column, length_mm: float) -> Column:
    """Metres from the specimen to the detector position (mm)."""
    return F.sqrt(detx * detx + dety * dety + F.lit(length_mm * length_mm)) * 1e-3


def tof_to_mc(tof: Column, vdc: Column, detx: Column, dety: Column, length_mm: float, t0: float = 0.0, vp: Column | None = None, mode: str = "laser", alpha: float = 1.015, beta: float = 0.7) -> Column:
    """Mass-to-charge in Da from the time of flight in ns; mode 'laser' or 'voltage'."""
    seconds = (tof - F.lit(t0)) * 1e-9
    length = flight_length(detx, dety, length_mm)
    if mode == "laser":
        volts = vdc
    elif mode == "voltage":
        volts = (vdc + (F.lit(0.0) if vp is None else vp) * beta) * alpha
    else:
        raise ValueError(f"mode {mode!r} is neither 'laser' nor 'voltage'")
    return volts * (2 * E_CHARGE / AMU) * F.pow(seconds / length, 2)


def mc_to_tof(mc: Column, vdc: Column, detx: Column, dety: Column, length_mm: float) -> Column:
    """The time of flight in ns, without an offset."""
    length = flight_length(detx, dety, length_mm)
    return F.sqrt(mc * AMU * length * length / (vdc * (2 * E_CHARGE))) * 1e9


def evaporation_field(ratio: Column, a: float | Column, b: float | Column) -> Column:
    """Field strength from a charge-state ratio and the element's two parameters."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    return a * (1 - b / (F.pow(ratio, 0.3) + b + 0.256))


def rotate(x: Column, y: Column, z: Column, axis: Sequence[float], angle: float) -> tuple[Column, Column, Column]:
    """Rodrigues' rotation about an axis through the origin, by radians."""
    n = math.sqrt(sum(v * v for v in axis))
    u, v, w = (c / n for c in axis)
    c, s, k = math.cos(angle), math.sin(angle), 1 - math.cos(angle)
    rows = (
        (c + u * u * k, u * v * k - w * s, u * w * k + v * s),
        (v * u * k + w * s, c + v * v * k, v * w * k - u * s),
        (w * u * k - v * s, w * v * k + u * s, c + w * w * k),
    )
    return tuple(x * p + y * q + z * r for p, q, r in rows)


def to_frame(x: Column, y: Column, z: Column, origin: Sequence[float], axes: Sequence[Sequence[float]]) -> tuple[Column, ...]:
    """Coordinates in the frame of a region: its origin, and its axes as unit vectors after scaling."""
    out = []
    for axis in axes:
        n = math.sqrt(sum(v * v for v in axis))
        out.append(sum(((p - o) * (v / n) for p, o, v in zip((x, y, z), origin, axis)), F.lit(0.0)))
    return tuple(out)


def launch_angle(radius: Column, length: float, icf: float) -> Column:
    """The angle on the specimen that a detector radius (same unit as length) maps to."""
    seen = F.atan(radius / length)
    return seen + F.asin(F.sin(seen) * (icf - 1))


def colour_index(value: Column, low: float, high: float, steps: int = 256) -> Column:
    """Place of a value in a linear colour table, 0 to steps - 1."""
    return F.least(F.greatest(F.floor((value - low) / (high - low) * steps), F.lit(0)), F.lit(steps - 1))


def efficiency(value: float) -> float:
    """A detection efficiency; values above 1 are percent."""
    return value / 100 if value > 1 else value
