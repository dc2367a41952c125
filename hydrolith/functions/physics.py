"""Radar physics and quality as column expressions. Missing is null throughout;
no rain is 0.0."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolith.profiles import Beam, Qpe, Vpr

LN10 = math.log(10.0)


def zr_raw(dbz: Column, p: Qpe = Qpe()) -> Column:
    """Rain rate in mm/h by the power law, without limits."""
    return F.exp((dbz / F.lit(10.0) * F.lit(LN10) - F.lit(math.log(p.a))) / F.lit(p.b))


def zr_rate(dbz: Column, valid: Column | None = None, p: Qpe = Qpe()) -> Column:
    """Rain rate: null where invalid, 0 under the no-rain limit, capped above."""
    ok = dbz.isNotNull() if valid is None else dbz.isNotNull() & F.coalesce(valid, F.lit(False))
    return F.when(ok, F.when(dbz < p.no_rain_dbz, F.lit(0.0)).otherwise(F.least(zr_raw(dbz, p), F.lit(p.cap_mm_h))))


def to_linear(dbz: Column) -> Column:
    return F.pow(F.lit(10.0), dbz / F.lit(10.0))


def to_db(linear: Column) -> Column:
    """10 log10; null for what is not positive."""
    return F.when(linear > 0, F.lit(10.0) * F.log10(linear))


def db_or_floor(value: Column, threshold: float, zero: float) -> Column:
    """10 log10 of values of the threshold at least; ``zero`` under it."""
    return F.when(value >= threshold, F.lit(10.0) * F.log10(value)).when(value.isNotNull(), F.lit(zero))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Like least(greatest()), but null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ramp(x: Column, lo: float, hi: float) -> Column:
    """Membership that rises from 0 at lo to 1 at hi."""
    return clip((x - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """Membership 0 outside (a, d), 1 in [b, c], linear between."""
    return F.when(x.isNull(), None).when((x >= b) & (x <= c), F.lit(1.0)).when((x > a) & (x < b), (x - F.lit(a)) / F.lit(b - a)).when((x > c) & (x < d), (F.lit(d) - x) / F.lit(d - c)).otherwise(F.lit(0.0))


def mean_of_available(parts: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of the parts that are not null; null if all are."""
    weights = weights or [1.0] * len(parts)
    zero = F.lit(0.0)
    total = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), p * F.lit(w)).otherwise(zero) for p, w in zip(parts, weights, strict=True)])
    weight = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), F.lit(w)).otherwise(zero) for p, w in zip(parts, weights, strict=True)])
    return F.when(weight > 0, total / weight)


def product_of_available(parts: list[Column]) -> Column:
    """Product of the parts that are not null; null if all are."""
    product = reduce(lambda a, b: a * b, [F.coalesce(p, F.lit(1.0)) for p in parts])
    return F.when(reduce(lambda a, b: a | b, [p.isNotNull() for p in parts]), product)


def weather_probability(snr: Column, rhohv: Column, valid: Column, no_rain: Column) -> Column:
    """Mean of the ramps that are available; 0.6 if none is, 1 where dry."""
    found = mean_of_available([ramp(snr, 0.0, 12.0), ramp(rhohv, 0.70, 0.97)])
    return F.when(~valid, None).when(no_rain, F.lit(1.0)).otherwise(F.coalesce(found, F.lit(0.60)))


def range_quality(position: Column, last: Column, far: float = 0.92) -> Column:
    """Falls linearly from 1 at gate 0 to ``far`` at the last gate."""
    return F.when(last > 0, F.lit(1.0) - F.lit(1.0 - far) * position / last).otherwise(F.lit(1.0))


def time_quality(offset_s: Column, most_s: float, least: float) -> Column:
    rest = round(1.0 - least, 12)  # 0.2 and not 0.19999999999999996
    return F.lit(least) + F.lit(rest) * F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(offset_s) / F.lit(most_s))


def decay(x: Column, scale: float) -> Column:
    """exp(-max(x, 0) / scale)."""
    return F.exp(-F.greatest(x, F.lit(0.0)) / F.lit(scale))


def beam_height(range_m: Column, elevation_deg: Column, antenna_m: Column | float = 0.0, b: Beam = Beam()) -> Column:
    """Height of the beam's centre over an earth of 4/3 radius."""
    r = F.lit(b.earth_m * b.refraction)
    return F.sqrt(range_m * range_m + r * r + F.lit(2.0) * range_m * r * F.sin(F.radians(elevation_deg))) - r + (antenna_m if isinstance(antenna_m, Column) else F.lit(antenna_m))


def ground_arc(range_m: Column, elevation_deg: Column, b: Beam = Beam()) -> Column:
    """Distance along the ground under a point of the beam."""
    r = F.lit(b.earth_m * b.refraction)
    e = F.radians(elevation_deg)
    return r * F.asin(range_m * F.cos(e) / (r + beam_height(range_m, elevation_deg, 0.0, b)))


def slant_range(arc_m: Column, elevation_deg: Column, b: Beam = Beam()) -> Column:
    """Inverse of ``ground_arc``."""
    r = F.lit(b.earth_m * b.refraction)
    phi, e = arc_m / r, F.radians(elevation_deg)
    return r * F.sin(phi) / F.cos(phi + e)


def beam_radius(range_m: Column, b: Beam = Beam()) -> Column:
    return range_m * F.lit(math.tan(math.radians(b.width_deg) / 2))


def partial_blockage(terrain_m: Column, centre_m: Column, radius_m: Column) -> Column:
    """Share of a circular beam under the terrain (a circular segment)."""
    d = terrain_m - centre_m
    a2, d2 = radius_m * radius_m, d * d
    inside = (d * F.sqrt(F.greatest(a2 - d2, F.lit(0.0))) + a2 * F.asin(clip(d / radius_m, -1.0, 1.0)) + a2 * F.lit(math.pi / 2)) / (F.lit(math.pi) * a2)
    return F.when(d.isNull(), None).when(d >= radius_m, F.lit(1.0)).when(d <= -radius_m, F.lit(0.0)).otherwise(inside)


def stratiform_vpr(dbz: Column, beam_m: Column, bottom_m: Column, top_m: Column, stratiform: Column, p: Vpr = Vpr()) -> Column:
    """struct(value, correction, uncertainty, applied, overshoot), null for null.

    Inside the melting layer a bright-band excess, largest in its middle, is
    taken off; above it the loss by height is put back up to a limit; beyond
    the limit of extrapolation the value is missing.
    """
    above_km = (beam_m - top_m) / F.lit(1000.0)
    inside = stratiform & beam_m.between(bottom_m, top_m)
    above = stratiform & (beam_m > top_m)
    over = above & (beam_m - top_m > p.overshoot_m)
    bright = -F.lit(p.bright_band_db) * (F.lit(1.0) - F.abs(F.lit(2.0) * (beam_m - bottom_m) / (top_m - bottom_m) - F.lit(1.0)))
    correction = F.when(over, None).when(inside, bright).when(above, F.least(above_km * F.lit(p.gradient_db_per_km), F.lit(p.most_db))).otherwise(F.lit(0.0))
    grown = F.when(inside, F.abs(bright) / F.lit(2.0)).otherwise(above_km * F.lit(p.uncertainty_db_per_km))
    uncertainty = F.when(inside | above, F.least(F.lit(p.most_uncertainty_db), F.lit(p.base_uncertainty_db) + grown)).otherwise(F.lit(0.0))
    made = F.struct((dbz + correction).alias("value"), correction.alias("correction"), uncertainty.alias("uncertainty"), (inside | above & ~over).alias("applied"), over.alias("overshoot"))
    return F.when(dbz.isNotNull(), made)


def wedge_area_km2(inner_m: Column, outer_m: Column, width_deg: float) -> Column:
    """Area of a polar gate."""
    return F.lit(0.5 * math.radians(width_deg)) * (outer_m * outer_m - inner_m * inner_m) / F.lit(1e6)
