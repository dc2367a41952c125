"""Geometry, tiles and reprojection against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.operators import scores, verification


def test_projections_round_trip(spark):
    d = spark.createDataFrame([(lon, lat) for lon in (117.2, 119.9, 121.0) for lat in (-35.0, 0.1, 25.5, 60.0)], "lon double, lat double")
    for to, back in (((scores.to_mercator), scores.from_mercator), (lambda a, b: scores.to_utm(a, b, 50), lambda a, b: scores.from_utm(a, b, 50))):
        x, y = to(F.col("lon"), F.col("lat"))
        lon, lat = back(F.col("x"), F.col("y"))
        for r in d.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
            assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)
    # A published point: 117 E, 0 N is the origin of zone 50, and a degree north is 110,574.3886 m of meridian before scaling.
    e, n = scores.to_utm(F.lit(117.0), F.lit(1.0), 50)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(500_000.0) and r.n == pytest.approx(0.9996 * 110_574.3886, abs=0.001)


def test_grid_metric(spark):
    r = scores.grid_metric(spark.createDataFrame([(0.0,), (60.0,)], "latitude double"), 1.0, 1.0, 0.0).orderBy("latitude").collect()
    assert r[0].x_spacing_m == pytest.approx(111_319.4908, abs=0.01) and r[1].x_spacing_m == pytest.approx(55_800.0, rel=1e-3)
    assert r[0].y_spacing_m == pytest.approx(110_574.304, abs=0.01)


def test_reprojection(spark):
    """A gate seen by both radars gets the other's value of the same place."""
    rays, gates, first, step = 360, 200, 500.0, 1000.0
    site, other = (25.0, 118.0), (25.0, 118.5)
    n = spark.range(rays * gates).select((F.col("id") % rays).alias("ray"), (F.col("id") / rays).cast("int").alias("gate")).withColumn("dbzh", F.col("ray") + F.col("gate") / 1000)
    c = spark.createDataFrame([(90.0, 20_000.0), (90.0, 50_000.0), (270.0, 200_000.0)], "azimuth_deg double, range_m double")
    got = {(r.azimuth_deg, r.range_m): r.neighbour_dbzh for r in scores.reprojected(c, site, n, other, rays, first, step, gates).collect()}
    apart = 111_319.49 * math.cos(math.radians(25)) * 0.5
    assert int(got[(90.0, 20_000.0)]) == 270 and got[(90.0, 20_000.0)] % 1 == pytest.approx(round((apart - 20_000 - first) / step) / 1000, abs=2e-3)
    assert got[(270.0, 200_000.0)] is None


def test_covering_tiles(spark):
    r = np.random.default_rng(2)
    on = {(y, x) for y in range(14) for x in range(14) if r.random() < 0.93}
    got = scores.covering_tiles(spark.createDataFrame([(1, y, x) for y, x in on], "c long, y long, x long"), ["c"], 4, 2, 6).orderBy("tile").collect()
    left, want = set(on), []
    full = [(t, s) for t in range(0, 14, 2) for s in range(0, 14, 2) if all((t + a, s + b) in on for a in range(4) for b in range(4))]
    for _ in range(6):
        gain, t, s = max((sum((a, b) in left for a in range(t, t + 4) for b in range(s, s + 4)), -t, -s) for t, s in full)
        if not gain:
            break
        want.append((-t, -s, gain))
        left -= {(a, b) for a in range(-t, -t + 4) for b in range(-s, -s + 4)}
    assert [(x.top, x.left, x.adds) for x in got] == want


def test_radial_spectrum_of_a_wave(spark):
    """A wave of known length has its power near its frequency, within what the
    taper spreads."""
    n = 32
    cells = [(1, y, x, 5.0 + math.sin(2 * math.pi * 4 * x / n)) for y in range(n) for x in range(n)]
    rows = [r for r in verification.radial_spectrum(spark.createDataFrame(cells, "c long, y long, x long, value double"), ["c"]).collect() if r.power is not None]
    top = max(rows, key=lambda r: r.power)
    assert top.low <= 5 / n and top.high >= 3 / n
    assert all(r.power < 0.01 * top.power for r in rows if r.high < 2 / n or r.low > 6.5 / n)
