"""Steps whose rows stay in proportion to their input, and their results by plain rules."""

import random

from hydrolith.operators import evidence


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matching_makes_no_pairs(spark):
    r = random.Random(3)
    points = [(k, r.randrange(-50, 300), 100.0 * r.randrange(-9, 30), 100.0 * r.randrange(9)) for k in range(300)] + [(900, None, 0.0, 0.0), (901, 5, float("nan"), 0.0)]
    fields = [(i, r.randrange(-50, 300), 100.0 * r.randrange(-9, 30), 100.0 * r.randrange(9), None if i % 7 == 0 else float("nan") if i % 7 == 1 else i / 2) for i in range(400)] + [(400, 7, None, 0.0, 1.0)]
    p = spark.createDataFrame(points, "k long, t long, x_m double, y_m double")
    f = spark.createDataFrame(fields, "id long, t long, x_m double, y_m double, value double")
    m = evidence.matched_observations(p, f, "k", 20, 300.0)
    assert "Join" not in plan(m)
    want = {}
    for k, t, x, y in points[:300]:
        near = [(((x - fx) ** 2 + (y - fy) ** 2) ** 0.5, abs(t - ft), i, v) for i, ft, fx, fy, v in fields[:400]]
        near = [n for n in near if n[0] <= 300 and n[1] <= 20]
        if near:
            want[k] = min(near, key=lambda n: n[:3])
    assert 100 < len(want) < 300
    assert {r.k: (r.distance_m, r.offset_s, r.field_id, str(r.value)) for r in m.collect()} == {k: (d, s, i, str(v)) for k, (d, s, i, v) in want.items()}
    assert evidence.matched_observations(p, f.limit(0), "k", 20, 300.0).count() == 0
