"""Settings with presets, stored as JSON or a plain subset of YAML."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields


@dataclass
class Instrument:
    flight_length_mm: float = 110.0
    detection_efficiency: float = 0.82
    pulse: str = "laser"


@dataclass
class Reconstruction:
    kf: float = 3.3
    icf: float = 1.65
    field_v_per_nm: float = 33.0
    density_per_nm3: float = 60.2


@dataclass
class Spectrum:
    bin_width_da: float = 0.02
    min_snr: float = 4.0


@dataclass
class Settings:
    instrument: Instrument = field(default_factory=Instrument)
    reconstruction: Reconstruction = field(default_factory=Reconstruction)
    spectrum: Spectrum = field(default_factory=Spectrum)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def to_yaml(self) -> str:
        lines = []
        for section, values in asdict(self).items():
            lines.append(f"{section}:")
            lines += [f"  {k}: {json.dumps(v)}" for k, v in values.items()]
        return "\n".join(lines) + "\n"

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """Unknown sections and names are errors, missing ones keep their presets."""
        kinds = {"instrument": Instrument, "reconstruction": Reconstruction, "spectrum": Spectrum}
        for section, own in values.items():
            if section not in kinds or set(own) - {f.name for f in fields(kinds[section])}:
                raise ValueError(f"unknown settings in {section!r}")
        return cls(**{k: kinds[k](**v) for k, v in values.items()})

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        values: dict = {}
        section: dict = {}
        for line in text.splitlines():
            body = line.split("#")[0].rstrip()
            if not body.strip():
                continue
            name, _, value = body.strip().partition(":")
            if not line.startswith(" "):
                section = values.setdefault(name, {})
            else:
                value = value.strip()
                try:
                    section[name] = json.loads(value)
                except ValueError:
                    section[name] = value.strip("'\"")
        return cls.from_dict(values)


#: Reconstruction presets of materials (evaporation field in V/nm, atoms per nm^3).
PRESETS = {"Al": (19.0, 60.2), "Fe": (33.0, 84.9), "W": (57.0, 63.1), "Si": (33.0, 50.0), "Cu": (30.0, 84.9), "Ni": (35.0, 91.4), "Ti": (26.0, 56.6)}


def preset(material: str) -> Settings:
    field_, density = PRESETS[material]
    return Settings(reconstruction=Reconstruction(field_v_per_nm=field_, density_per_nm3=density))
