"""Immutable parameter sets of the operators, with their defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import TypeVar

T = TypeVar("T")

# The stages' default parameters.


@dataclass(frozen=True)
class Qpe:
    a: float = 200.0
    b: float = 1.6
    no_rain_dbz: float = 10.0
    cap_mm_h: float = 300.0


@dataclass(frozen=True)
class Beam:
    earth_m: float = 6_371_000.0
    refraction: float = 4.0 / 3.0
    width_deg: float = 1.0


@dataclass(frozen=True)
class Vpr:
    bright_band_db: float = 6.0
    gradient_db_per_km: float = 4.0
    most_db: float = 6.0
    overshoot_m: float = 1500.0
    base_uncertainty_db: float = 0.5
    uncertainty_db_per_km: float = 1.0
    most_uncertainty_db: float = 3.0


@dataclass(frozen=True)
class Health:
    unavailable_under: float = 0.50
    degraded_under: float = 0.97
    azimuth_gap_deg: float = 3.0
    azimuth_gap_steps: float = 1.5
    outlier_ratio: float = 0.001
    noise_dbm: tuple[float, float] = (-120.0, -70.0)
    constant_range: float = 1e-6


@dataclass(frozen=True)
class Qc:
    dry_dbz: float = -10.0
    range_dbz: tuple[float, float] = (-32.0, 80.0)
    low_snr_db: float = 3.0
    low_quality: float = 0.45
    interference: float = 0.80
    interference_low_quality: float = 0.65
    clutter: float = 0.70
    degraded_factor: float = 0.80


@dataclass(frozen=True)
class Hybrid:
    source_quality: float = 0.10
    blockage: float = 0.70
    flag_blockage: float = 0.10
    most_agl_m: float = 10_000.0
    height_scale_m: float = 6000.0
    azimuth_offset_deg: float = 0.75
    range_offset_gates: float = 0.55


@dataclass(frozen=True)
class Mosaic:
    least_quality: float = 0.10
    quality_gap: float = 0.10
    power: float = 2.0
    low_quality: float = 0.45
    most_offset_s: float = 150.0
    least_time_quality: float = 0.8
    distance_scale_m: float = 100_000.0
    #: "quality" blends the best by quality; "distance" weighs by distance too.
    method: str = "quality"


@dataclass(frozen=True)
class NowcastInput:
    coverage: float = 0.70
    mean_quality: float = 0.45
    age_min: float = 10.0
    least_frames: int = 3
    most_frames: int = 6
    step_s: int = 360


@dataclass(frozen=True)
class Waterline:
    expected: int = 4
    earliest_s: int = 30
    most_s: int = 240
    require_all: bool = False


#: The quality flags by bit.
FLAGS = (
    "GROUND_CLUTTER", "SEA_CLUTTER", "ANOMALOUS_PROPAGATION", "RADIAL_INTERFERENCE", "HARDWARE_ANOMALY", "BIOLOGICAL_ECHO", "BEAM_BLOCKED", "ATTENUATED",
    "WET_RADOME", "BRIGHT_BAND", "VELOCITY_ALIASED", "LOW_SNR", "MISSING", "CORRECTED", "LOW_QUALITY", "NON_METEOROLOGICAL",
)
#: Flags that keep an observation out of composites.
REJECT = ("MISSING", "HARDWARE_ANOMALY", "RADIAL_INTERFERENCE", "GROUND_CLUTTER", "SEA_CLUTTER", "ANOMALOUS_PROPAGATION", "BIOLOGICAL_ECHO")


def flag(*names: str) -> int:
    return sum(1 << FLAGS.index(n) for n in names)


def load(kind: type[T], source: str) -> T:
    """A profile from a JSON object; unknown or ill-typed fields are errors."""
    given = json.loads(source)
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(given) - set(fields):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    values = {}
    for name, value in given.items():
        default = fields[name].default
        if isinstance(default, tuple):
            value = tuple(value)
        if isinstance(default, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if type(value) is not type(default):
            raise TypeError(f"{name}: {type(default).__name__} is asked for")
        values[name] = value
    return kind(**values)
