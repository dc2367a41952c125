"""Values that lie on a limit, or tie, fall on the side that the SQL says."""

import datetime
import math
import random

from pyspark.sql import functions as F

from hydrolith.functions import physics
from hydrolith.operators import grids, objects, signatures
from hydrolith.plans.operations_queries import sessions


def test_first_usable_of_one_sweep_is_the_least(spark):
    row = lambda cell, q: (cell, 1, 20.0, True, q, 0.9, 0.0, 100.0, 0.0, 0.0, 0.5)
    c = spark.createDataFrame([row(1, 64), row(1, 128), row(2, 128), row(2, 64)], "cell int, sweep int, dbzh double, valid boolean, qc_flags long, quality double, blockage double, agl_m double, azimuth_offset_deg double, range_offset_gates double, elevation_deg double").coalesce(1)
    assert {r.cell: r.qc_flags for r in grids.hybrid_scan(c, ["cell"]).collect()} == {1: 64, 2: 64}


def test_level_winner_of_equal_scores_is_the_largest_echo(spark):
    row = lambda cell, z: (cell, 1, z, 0.5, 7, 0.0, 1000.0, 1000.0, 0.0)
    c = spark.createDataFrame([row(1, 40.0), row(1, 10.0), row(1, None), row(2, None), row(2, 10.0), row(2, 40.0)], "cell int, level int, dbzh double, quality double, source int, age_min double, grid_m double, resolution_m double, height_off_m double").coalesce(1)
    assert {r.cell: r.dbzh for r in grids.level_winners(c, ["cell"], "level", 10.0, 250.0).collect()} == {1: 40.0, 2: 40.0}


def test_time_quality_to_the_last_bit(spark):
    got = spark.range(150).select(F.col("id").cast("double").alias("o")).select("o", physics.time_quality(F.col("o"), 150.0, 0.8).alias("q")).collect()
    assert [r.q for r in got] == [0.8 + 0.2 * max(0.0, 1.0 - r.o / 150.0) for r in got]


def ray(spark, value):
    r = random.Random(5)
    rows = [(1, 0, g, (g + 1) * 1000.0, value(g, r), None, None, None) for g in range(60)]
    return spark.createDataFrame(rows, "sweep int, ray int, gate int, range_m double, dbzh double, ceiling double, rhohv double, protected boolean")


def test_residuals_to_the_last_bit(spark):
    p = signatures.Signature(rays=24, gates=60, spacing_m=1000.0, minimum_range_m=0, echo_dbz=-50.0, span_m=12_000, measured_m=8000)
    f = signatures.fitted(ray(spark, lambda g, r: 8 + 20 * math.log10(g + 1) + r.randrange(9) / 2), ["sweep"], p)
    got = f.select("residual", F.abs(F.col("dbzh") - F.col("intercept") - signatures.log_range()).alias("want")).collect()
    assert len(got) == 60 and [r.residual for r in got] == [r.want for r in got]


def test_axial_deviation_to_the_last_bit(spark):
    p = objects.Objects(rays=24, gates=60, spacing_m=1000.0, window_m=5000)
    got = objects.axial(ray(spark, lambda g, r: 8 + 20 * math.log10(g + 1) + r.randrange(9) / 2), ["sweep"], p).orderBy("gate").collect()
    for g, row in enumerate(got):
        mean = squares = 0.0
        for n, x in enumerate([o.corrected for o in got[max(0, g - 2) : g + 3]], 1):
            before, mean = mean, mean + (x - mean) / n
            squares += (x - mean) * (x - before)
        assert row.axial_std == math.sqrt(squares / n)


def test_half_an_hour_parts_sessions(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(k, u, "view", at(s), 1.0) for k, (u, s) in enumerate([(1, 0), (1, 1800), (1, 3599), (2, 0), (2, 1799), (2, 1799)])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    t = 1704067200
    assert sorted(map(tuple, sessions(spark, str(tmp_path)).collect())) == [(1, t, t + 1800, 1), (1, t + 1800, t + 5399, 2), (2, t, t + 3599, 3)]
