"""Distances and azimuths on the WGS84 ellipsoid as column expressions.

Vincenty's iterations are a fold over a fixed number of steps, so they run in
the JVM; nearly antipodal points do not settle and give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrolith.functions.basic import pmod_deg

# The ellipsoid's semi-major axis and flattening.
A = 6378137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)
STEPS = 12


def _series(u2: Column) -> tuple[Column, Column]:
    one = F.lit(1.0)
    a = one + u2 / 16384.0 * (F.lit(4096.0) + u2 * (F.lit(-768.0) + u2 * (F.lit(320.0) - F.lit(175.0) * u2)))
    b = u2 / 1024.0 * (F.lit(256.0) + u2 * (F.lit(-128.0) + u2 * (F.lit(74.0) - F.lit(47.0) * u2)))
    return a, b


def _bend(b: Column, sin_s: Column, cos_s: Column, cos_m: Column) -> Column:
    """Correction of the arc."""
    m2 = cos_m * cos_m
    return b * sin_s * (cos_m + b / 4.0 * (cos_s * (F.lit(-1.0) + F.lit(2.0) * m2) - b / 6.0 * cos_m * (F.lit(-3.0) + F.lit(4.0) * sin_s * sin_s) * (F.lit(-3.0) + F.lit(4.0) * m2)))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """struct(distance in metres, azimuth at the first point in degrees)."""
    u1, u2 = F.atan(F.lit(1 - FLAT) * F.tan(F.radians(lat1))), F.atan(F.lit(1 - FLAT) * F.tan(F.radians(lat2)))
    start = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lon2 - lon1).alias("l"))

    def parts(p: Column, lam: Column) -> Column:
        x, y = p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam)
        sin_s, cos_s = F.hypot(x, y), p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)
        return F.struct(x.alias("x"), y.alias("y"), sin_s.alias("ss"), cos_s.alias("cs"), F.atan2(sin_s, cos_s).alias("s"), F.coalesce(F.try_divide(p["c1"] * p["c2"] * F.sin(lam), sin_s), F.lit(0.0)).alias("sa"))

    def middle(p: Column, q: Column) -> Column:
        return F.coalesce(q["cs"] - F.try_divide(F.lit(2.0) * p["s1"] * p["s2"], F.lit(1.0) - q["sa"] * q["sa"]), F.lit(0.0))

    def whole(p: Column) -> Column:
        def step(lam: Column, _: Column) -> Column:
            def next_lam(q: Column) -> Column:
                c2 = F.lit(1.0) - q["sa"] * q["sa"]
                c = F.lit(FLAT / 16) * c2 * (F.lit(4.0) + F.lit(FLAT) * (F.lit(4.0) - F.lit(3.0) * c2))
                m = middle(p, q)
                return p["l"] + (F.lit(1.0) - c) * F.lit(FLAT) * q["sa"] * (q["s"] + c * q["ss"] * (m + c * q["cs"] * (F.lit(-1.0) + F.lit(2.0) * m * m)))

            return _let(parts(p, lam), next_lam)

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), p["l"], step)

        def result(q: Column) -> Column:
            square = (F.lit(1.0) - q["sa"] * q["sa"]) * F.lit((A * A - B * B) / (B * B))
            a, b = _series(square)
            distance = F.lit(B) * a * (q["s"] - _bend(b, q["ss"], q["cs"], middle(p, q)))
            return F.struct(distance.alias("distance"), pmod_deg(F.degrees(F.atan2(q["x"], q["y"]))).alias("azimuth"))

        return _let(parts(p, lam), result)

    return _let(start, whole)


def direct(lat: Column, lon: Column, azimuth: Column, distance: Column) -> Column:
    """struct(latitude, longitude) at a distance along an azimuth."""
    az = F.radians(azimuth)
    tan_u = F.lit(1 - FLAT) * F.tan(F.radians(lat))
    cos_u = F.lit(1.0) / F.sqrt(F.lit(1.0) + tan_u * tan_u)
    sin_u = tan_u * cos_u
    sin_a = cos_u * F.sin(az)
    a, b = _series((F.lit(1.0) - sin_a * sin_a) * F.lit((A * A - B * B) / (B * B)))
    start = F.struct(sin_u.alias("su"), cos_u.alias("cu"), sin_a.alias("sa"), F.atan2(tan_u, F.cos(az)).alias("s1"), a.alias("a"), b.alias("b"), F.sin(az).alias("sz"), F.cos(az).alias("cz"), (distance / (F.lit(B) * a)).alias("d"))

    def whole(p: Column) -> Column:
        s = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), p["d"], lambda s, _: p["d"] + _bend(p["b"], F.sin(s), F.cos(s), F.cos(F.lit(2.0) * p["s1"] + s)))

        def result(s: Column) -> Column:
            sin_s, cos_s, cos_m = F.sin(s), F.cos(s), F.cos(F.lit(2.0) * p["s1"] + s)
            back = p["su"] * sin_s - p["cu"] * cos_s * p["cz"]
            latitude = F.atan2(p["su"] * cos_s + p["cu"] * sin_s * p["cz"], F.lit(1 - FLAT) * F.hypot(p["sa"], back))
            lam = F.atan2(sin_s * p["sz"], p["cu"] * cos_s - p["su"] * sin_s * p["cz"])
            c2 = F.lit(1.0) - p["sa"] * p["sa"]
            c = F.lit(FLAT / 16) * c2 * (F.lit(4.0) + F.lit(FLAT) * (F.lit(4.0) - F.lit(3.0) * c2))
            shift = lam - (F.lit(1.0) - c) * F.lit(FLAT) * p["sa"] * (s + c * sin_s * (cos_m + c * cos_s * (F.lit(-1.0) + F.lit(2.0) * cos_m * cos_m)))
            return F.struct(F.degrees(latitude).alias("latitude"), (lon + F.degrees(shift)).alias("longitude"))

        return _let(s, result)

    return _let(start, whole)
