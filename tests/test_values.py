"""Hand values of the expressions and operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith import profiles
from hydrolith.functions import basic as bs
from hydrolith.functions import geodesy
from hydrolith.functions import physics as ph
from hydrolith.operators import asof, grids, kernels, resampling, sequences, verification as ver
from hydrolith.profiles import Waterline, flag


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_rates(spark):
    d = spark.createDataFrame([(5.0, True), (20.0, True), (60.0, True), (None, False), (90.0, True)], "dbzh double, valid boolean")
    got = [r.rate for r in grids.qpe(d).collect()]
    assert got[0] == 0.0 and got[3] is None and got[4] == 300.0
    assert got[1] == pytest.approx((100 / 200) ** (1 / 1.6)) and got[2] == pytest.approx((1e6 / 200) ** (1 / 1.6))


def test_waterline(spark):
    cases = [(4, 30, False, True, "all_radars_arrived"), (2, 180, False, False, "waiting_maximum_watermark"), (2, 240, False, True, "maximum_wait_elapsed"), (3, 1200, True, False, "waiting_all_radars"), (4, 10, False, False, "waiting_earliest_delay"), (0, 900, False, False, "no_contributors")]
    for n, age, everything, ready, reason in cases:
        w = one(spark, asof.waterline(F.lit(n), F.lit(age), Waterline(require_all=everything))).c0
        assert (w.ready, w.reason) == (ready, reason)


def test_windows_of_fss(spark):
    row = lambda t, f: spark.createDataFrame([(0, x, a, b) for x, (a, b) in enumerate(zip(t, f, strict=True))], "y long, x long, observed double, forecast double").withColumn("k", F.lit(1))
    assert ver.fractions_skill(row([1.0, 0.0, None], [0.0, 1.0, None]), ["k"], 0.5, 3).first().fss == pytest.approx(1.0)
    c = {d: ver.contingency(row([2.0, 2.0, 0.0, 0.0], [2.0, None, 0.0, None]), ["k"], [1.0], d).first() for d in ("common", "truth")}
    assert c["common"].csi == 1.0 and c["truth"].csi == 0.5 and c["truth"].coverage == 0.5
    assert ver.odd_window(10, 1) == 9 and ver.odd_window(1, 3) == 1 and ver.odd_window(11.2, 1) == 11


def test_ensemble_scores(spark):
    d = spark.createDataFrame([(1, 0.0, [0.0, 0.0]), (1, 2.0, [1.0, 3.0])], "k int, observed double, members array<double>")
    b = ver.probability_scores(d, ["k"], [1.0]).first()
    e = ver.ensemble_scores(d, ["k"]).first()
    assert b.brier == pytest.approx(0.125) and e.crps == pytest.approx(0.25) and e.mean_rmse == 0.0 and e.spread == pytest.approx(0.5)


def test_accumulation(spark):
    rows = [(m, lead, r) for m, f in enumerate([lambda h: 10.0 * (h < 1), lambda h: 10.0 * (h >= 1), lambda h: 0.0]) for lead in range(6, 121, 6) for r in [f((lead - 6) / 60)]]
    d = spark.createDataFrame([(1, *r) for r in rows], "cell int, member int, lead_min int, rate double")
    assert grids.member_first(d, ["cell"], "member", 0, 120, 0.5, 3).first().amount == pytest.approx(10.0)
    assert grids.accumulated(d.filter("member = 0"), ["cell"], 0, 60).first().amount == pytest.approx(10.0)
    gap = d.withColumn("rate", F.when(F.col("lead_min") != 6, F.col("rate")))
    assert grids.accumulated(gap.filter("member = 0"), ["cell"], 0, 60).first().amount is None


def test_mosaic_cases(spark):
    cols = "y int, x int, source int, code int, dbzh double, valid boolean, quality double, qc_flags long, offset_s double, data_age_min double, distance_m double"
    rows = [(0, 0, 1, 1, 30.0, True, 0.9, 0, 0.0, 1.0, 0.0), (0, 0, 2, 2, 10.0, True, 0.5, 0, 0.0, 1.0, 0.0), (0, 1, 1, 1, 20.0, True, 0.8, 0, 0.0, 1.0, 0.0), (0, 1, 2, 2, 20.0, True, 0.8, 0, 0.0, 1.0, 0.0), (1, 0, 1, 1, 50.0, True, 0.9, flag("GROUND_CLUTTER"), 0.0, 1.0, 0.0), (1, 0, 2, 2, 18.0, True, 0.4, 0, 0.0, 1.0, 0.0), (1, 1, 1, 1, None, False, None, 0, 0.0, 1.0, 0.0)]
    got = {(r.y, r.x): r for r in grids.mosaic(spark.createDataFrame(rows, cols), ["y", "x"]).collect()}
    assert (got[0, 0].dbzh, got[0, 0].source_code, got[0, 0].contributors) == (pytest.approx(30.0), 1, 1)
    assert (got[0, 1].dbzh, got[0, 1].source_code, got[0, 1].contributors) == (pytest.approx(20.0), 65535, 2)
    assert got[1, 0].dbzh == pytest.approx(18.0) and got[1, 0].qc_flags == flag("LOW_QUALITY")
    assert got[1, 1].dbzh is None and got[1, 1].qc_flags == flag("MISSING") and not got[1, 1].valid


def test_vpr(spark):
    at = lambda h, s=True: one(spark, ph.stratiform_vpr(F.lit(30.0), F.lit(float(h)), F.lit(3000.0), F.lit(4000.0), F.lit(s))).c0
    assert at(1000).value == 30.0 and at(3500).value == 24.0 and at(4500).value == 32.0 and at(9000).value is None and at(9000).overshoot
    assert at(3500, False).value == 30.0 and at(3500).uncertainty == 3.0 and at(3250).uncertainty == 2.0


def test_blockage_and_paths(spark):
    assert one(spark, ph.partial_blockage(F.lit(100.0), F.lit(100.0), F.lit(50.0))).c0 == pytest.approx(0.5)
    g = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.1, 0.4, 0.2, None, 0.9])], "ray int, gate int, partial double")
    assert [r.cumulative for r in sequences.running_blockage(g, ["ray"], "gate", "partial").orderBy("gate").collect()] == [0.1, 0.4, 0.4, None, None]
    z = spark.createDataFrame([(1, float(i), 30.0 + i % 3, 50.0) for i in range(8)], "ray int, km double, dbzh double, dp double")
    pia = [r.pia for r in sequences.zphi(z, ["ray"], "km", "dbzh", "dp", 0.3, 0.78).orderBy("km").collect()]
    assert pia[0] == pytest.approx(0.0, abs=1e-9) and pia[-1] == pytest.approx(15.0) and pia == sorted(pia)
    arc, back = one(spark, ph.ground_arc(F.lit(100_000.0), F.lit(1.5)), ph.slant_range(ph.ground_arc(F.lit(100_000.0), F.lit(1.5)), F.lit(1.5)))
    assert arc < 100_000 and back == pytest.approx(100_000.0, rel=1e-6)


def test_geodesic(spark):
    """The distance and azimuth of a published example, and there and back."""
    g = one(spark, geodesy.inverse(F.lit(-37.95103341666667), F.lit(144.42486788888888), F.lit(-37.65282113888889), F.lit(143.92649552777777))).c0
    assert g.distance == pytest.approx(54972.271, abs=0.01) and g.azimuth == pytest.approx(306.86816, abs=1e-4)
    d = one(spark, geodesy.direct(F.lit(-37.95103341666667), F.lit(144.42486788888888), F.lit(g.azimuth), F.lit(g.distance))).c0
    assert d.latitude == pytest.approx(-37.65282113888889, abs=1e-8) and d.longitude == pytest.approx(143.92649552777777, abs=1e-8)


def test_angles_times_ids(spark):
    assert one(spark, bs.turn(F.lit(350.0), F.lit(10.0)), bs.apart(F.lit(10.0), F.lit(350.0))) == (-20.0, 20.0)
    t = F.lit("2026-01-01T00:03:00Z").cast("timestamp")
    r = one(spark, bs.iso(bs.round_to(t, 360)), bs.iso(bs.truncate_to(t, 360)), bs.iso(bs.next_minute(F.lit("2026-01-01T00:03:00.1Z").cast("timestamp"))))
    assert tuple(r) == ("2026-01-01T00:06:00Z", "2026-01-01T00:00:00Z", "2026-01-01T00:04:00Z")
    assert one(spark, bs.parse_utc(F.lit("2026-01-01T00:00:00"))).c0 is None and one(spark, bs.parse_utc(F.lit("2026-01-01T00:00:00+08:00"))).c0 is not None
    import uuid

    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, bs.uuid5_like(ns, F.lit("a.example"))).c0 == str(uuid.uuid5(uuid.UUID(ns), "a.example"))
    p = one(spark, bs.cycle_parts(bs.cycle_id(F.lit("g"), t))).c0
    assert p.grid == "g" and p.time is not None
    assert one(spark, bs.clipped(F.lit("abcdef"), 4), bs.redact(F.lit('x token="abc" https://u:p@h Bearer q.w'))) == ("abc…", 'x token="[REDACTED]" https://[REDACTED]@h Bearer [REDACTED]')


def test_profiles():
    assert profiles.load(profiles.Qpe, '{"a": 300}').a == 300.0
    for bad in ('{"z": 1}', '{"a": "x"}'):
        with pytest.raises((ValueError, TypeError)):
            profiles.load(profiles.Qpe, bad)
    assert flag("GROUND_CLUTTER", "NON_METEOROLOGICAL") == 1 | 1 << 15


def test_pools():
    """Against the definition: the isotonic fit minimises squared error."""
    r = np.random.default_rng(1)
    for _ in range(30):
        w = r.integers(1, 6, 7).astype(float)
        e = np.array([r.integers(0, x + 1) for x in w], float)
        y = ver.pool(e, w)
        assert (np.diff(y) >= -1e-12).all() and (w * y).sum() == pytest.approx(e.sum())
        want = [max(min(e[i : j + 1].sum() / w[i : j + 1].sum() for j in range(k, 7)) for i in range(k + 1)) for k in range(7)]
        assert y == pytest.approx(want)


def test_coherent_probabilities(spark):
    a, b, c = ver.coherent([F.lit(0.25), F.lit(0.5), F.lit(0.1)])
    assert tuple(one(spark, a, b, c)) == (0.25, 0.25, 0.1)


def test_motion():
    r = np.random.default_rng(2)
    a = np.zeros((40, 40))
    a[10:18, 12:20] = r.random((8, 8)) * 20 + 5
    b = np.roll(a, (2, 3), (0, 1))
    assert kernels.shift_of(a, b)[:2] == (2, 3)
    v, u = kernels.motion(a, b)
    ahead = kernels.carried(b, v, u, 1)
    want = np.roll(b, (2, 3), (0, 1))
    good = np.isfinite(ahead)
    assert np.abs(ahead - want)[good].mean() < 0.2
    assert kernels.shift_of(np.zeros((8, 8)), np.zeros((8, 8))) == (0, 0, 0.0)


def test_labels_close_the_circle(spark):
    g = spark.createDataFrame([(1, 0, 5), (1, 35, 5), (1, 34, 5), (1, 10, 5), (1, 10, 7)], "sweep long, ray long, gate long")
    got = {(r.ray, r.gate): (r.label, r.size) for r in kernels.polar_labels(g, ["sweep"], 36).collect()}
    assert got[0, 5] == got[35, 5] == got[34, 5] and got[0, 5][1] == 3 and got[10, 5][0] != got[10, 7][0]


def test_states_against_enumeration(spark):
    import itertools

    r = random.Random(1)
    rows = [(k, i, r.choice([None, r.random()])) for k in range(12) for i in range(6)]
    got: dict = {}
    for x in kernels.ray_states(spark.createDataFrame(rows, "ray int, gate int, p double"), ["ray"], "gate", "p").collect():
        got.setdefault(x.ray, {})[x.gate] = x.state
    for k in range(12):
        p = [min(0.999, max(0.001, 0.5 if v is None else v)) for kk, _, v in rows if kk == k]
        cost = lambda s: sum(math.log(q if z else 1 - q) for z, q in zip(s, p, strict=True)) + sum(math.log(0.9 if a == b else 0.1) for a, b in itertools.pairwise(s))  # noqa: B023, E731
        best = max(cost(s) for s in itertools.product((0, 1), repeat=6))
        assert cost([got[k][i] for i in range(6)]) == pytest.approx(best)


def test_robust_slope(spark):
    """A line with two wild values keeps its slope."""
    from hydrolith.operators.robust import robust_slope

    y = [2.0 * i + 0.01 * (i % 3) for i in range(11)]
    y[3], y[8] = 500.0, None
    d = spark.createDataFrame([(1, float(i), v) for i, v in enumerate(y)] + [(2, 0.0, 1.0), (2, 1.0, 2.0)], "ray int, km double, phase double")
    got = {(r.ray, r.km): r.slope for r in robust_slope(d, ["ray"], "km", "phase", 5).collect()}
    assert got[1, 5.0] == pytest.approx(2.0, abs=0.02) and got[2, 0.0] is None


def test_separated_is_the_greedy_choice(spark):
    """Against all candidates in order, one by one."""
    from hydrolith.operators import kernels

    def greedy(rows, gap, most):
        out = []
        for r in sorted(rows, key=lambda r: (-r[3], r[4])):
            if len(out) < most and all(r[1] != x[1] and abs(r[2] - x[2]) >= gap for x in out):
                out.append(r)
        return [(*r, i + 1) for i, r in enumerate(out)]

    g = np.random.default_rng(4)
    made = [(0, "A", 86000, 10.0, 1), (0, "B", 90000, 9.0, 2), (0, "B", 172700, 8.0, 3)]
    made += [(k, "ABCDEF"[g.integers(6)], int(g.integers(0, 600_000)), float(g.integers(0, 40)), 100 * k + i) for k in range(1, 9) for i in range(60)]
    df = spark.createDataFrame(made, "month long, radar string, t long, value double, scan_id long")
    got = sorted(tuple(r) for r in kernels.separated(df, ["month"], "t", "value", "radar", "scan_id", 86400, 5).collect())
    assert got == sorted(x for k in range(9) for x in greedy([r for r in made if r[0] == k], 86400, 5))
    assert [r[1:3] for r in got if r[0] == 0] == [("A", 86000), ("B", 172700)]


def test_bootstrap_draws_cases_and_issues(spark):
    """Against resampling with numpy: one case varies by its issues, too."""
    g = np.random.default_rng(5)
    cases = {"a": {0: g.normal(0, 1, 12)}, "b": {c: g.normal(c / 4, 2, 5) for c in range(40)}}
    rows = [(k, c, i, float(v)) for k, of in cases.items() for c, vs in of.items() for i, v in enumerate(vs)] + [("b", 0, 0, None)]
    df = spark.createDataFrame(rows, "k string, c long, i long, value double")
    got = {r.k: r for r in resampling.block_bootstrap(df, ["k"], "c", "i").collect()}
    for k, of in cases.items():
        vs = list(of.values())
        draws = [np.mean([g.choice(vs[c], len(vs[c])).mean() for c in g.integers(0, len(vs), len(vs))]) for _ in range(2000)]
        low, high = np.percentile(draws, [2.5, 97.5])
        assert got[k].mean == pytest.approx(np.mean([v.mean() for v in vs])) and got[k].cases == len(vs)
        assert abs(got[k].low - low) < 0.15 * (high - low) and abs(got[k].high - high) < 0.15 * (high - low)


def test_isotonic_keeps_different_probabilities_apart(spark):
    df = spark.createDataFrame([("k", 1 / 3, 1), ("k", 0.3333, 0), ("k", 0.3333, 0)], "k string, p double, event int")
    assert sorted((r.x, r.y, r.w) for r in ver.isotonic(df, ["k"]).collect()) == [(0.3333, 0.0, 2.0), (1 / 3, 1.0, 1.0)]
