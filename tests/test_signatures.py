"""Range signatures and the broad source on made-up sweeps with known answers."""

import math

import pytest

from hydrolith.operators import signatures

R, G = 12, 60
SCHEMA = "s long, ray long, gate long, range_m double, dbzh double, ceiling double, protected boolean, conflict boolean, rhohv double, snr double, zdr double, phidp double"
P = signatures.Signature(rays=R, gates=G, spacing_m=1000.0, minimum_range_m=3000, echo_dbz=0.0, span_m=15_000, measured_m=10_000, growth_db=2.0, log_span_db=3.0, high_dbz=15.0, high_fraction=0.5, gap_m=2000, gap_fraction=0.3, fit_span_m=8000, fit_samples=8, plateau_m=10_000, plateau_dbz=30.0, width_deg=100, aspect=0.5)
B = signatures.Broad(rays=R, spacing_m=1000.0, block_m=10_000, minimum_range_m=5000, maximum_range_m=55_000, blocks=2, block_span_m=5000, reference_span_m=15_000, snr_db=15, samples=10, neighbour_deg=60, span_deg=30, neighbours=2, plateau_m=20_000)


def gate(s, r, k, z, ceiling=None, protected=None, zdr=1.0, phidp=179.0, snr=25.0):
    return (s, r, k, (k + 1) * 1000.0, z, ceiling, protected, None, 0.8, snr, zdr, phidp)


def source(k, level=5.0):
    return level + 20 * math.log10(k + 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_what_does_not_fit_is_left_out(spark):
    """Two rays of a source around the circle, a wild gate, a hole, a far ray."""
    rows = [gate(1, r, k, source(k) + (20 if (r, k) == (0, 30) else 0)) for r in (0, R - 1) for k in range(5, 50) if (r, k) != (0, 40)]
    rows += [gate(1, 5, k, 20.0) for k in range(5, 50)] + [gate(1, 7, k, None) for k in range(G)] + [gate(None, 0, 1, 50.0)]
    o, g = signatures.range_objects(frame(spark, rows), ["s"], P)
    (only,) = o.collect()
    assert (only.rays, only.width_deg, only.first, only.last, only.modes) == (2, 60.0, 5, 49, [1])
    inside = {(x.ray, x.gate) for x in g.collect()}
    assert inside == {(r, k) for r in (0, R - 1) for k in range(5, 50)} - {(0, 30), (0, 40)}
    assert only.gates == len(inside) and {x.why for x in signatures.fitted(frame(spark, rows), ["s"], P).filter("ray = 5").collect()} == {"shape"}
    crossed = signatures.range_objects(frame(spark, rows), ["s"], signatures.Signature(**{**P.__dict__, "link_residual_db": 25.0}))[1]
    assert [(x.ray, x.gate) for x in crossed.filter("linked").collect()] == [(0, 30)]


def test_an_outlier_may_end_an_object(spark):
    """A wild gate cuts an interval in two; what is left too short is no object."""
    rows = [gate(1, 0, k, source(k) + (20 if k in (16, 17) else 0)) for k in range(5, 50)]
    o, g = signatures.range_objects(frame(spark, rows), ["s"], P)
    assert [(x.first, x.last) for x in o.orderBy("first").collect()] == [(5, 15), (18, 49)]
    assert not g.filter("gate IN (16, 17)").count()
    short = [gate(1, 0, k, source(k) + (20 if k in (12, 13) else 0)) for k in range(5, 50)]
    assert [(x.first, x.last) for x in signatures.range_objects(frame(spark, short), ["s"], P)[0].collect()] == [(14, 49)]


def test_ceilings_and_flat_tails(spark):
    capped = [gate(1, 0, k, min(30.0, source(k)), 30.0) for k in range(5, 50)]
    over = [gate(2, 0, k, source(k), 30.0) for k in range(5, 50)]
    flat = [gate(3, 0, k, min(32.0, source(k))) for k in range(5, 55)]
    f = {x.s: x for x in signatures.fitted(frame(spark, capped + over + flat), ["s"], P).collect()}
    assert (f[1].mode, f[1].why, f[1].cap) == (2, None, 30.0) and f[1].intercept == pytest.approx(5.0)
    assert (f[2].mode, f[2].why) == (2, "over_ceiling") and (f[3].mode, f[3].cap, f[3].why) == (3, 32.0, None)


def test_broad_source_holds_its_target_out(spark):
    """Rays 0 to 2 agree; ray 6 stands alone. A target that is unlike the model is a
    conflict and does not change the model."""
    rows = [gate(1, r, k, source(k) + 0.1 * (k % 3) + (9 if (r, k) == (1, 30) else 0), protected=(r, k) == (2, 20) or None, zdr=1 + 0.1 * (k % 2), phidp=178.0 + k % 5) for r in (0, 1, 2, 6) for k in range(5, 54)]
    got = {(x.ray, x.gate): x for x in signatures.broad_source(frame(spark, rows), ["s"], B).collect()}
    b = signatures.BROAD_REASONS
    assert got[1, 31].candidate and got[1, 31].reason == b["fit"] | b["agreement"] | b["match"]
    assert got[1, 30].reason == b["fit"] | b["agreement"] | b["conflict"] and got[1, 30].residual_db == pytest.approx(9.0, abs=0.3)
    assert got[6, 30].reason == b["fit"] and got[6, 30].residual_db is None and not got[6, 30].candidate
    assert not got[2, 20].candidate and got[2, 20].reason & b["protected"] and got[2, 20].reason & b["match"]
    folds = {(x.ray, x.t): x for x in signatures.broad_folds(frame(spark, rows), ["s"], B).collect()}
    assert (folds[1, 2].left, folds[1, 2].right, folds[6, 2].agrees) == (1, 1, False)
    worse = [gate(*x[:3], x[4] + (30 if 15 <= x[2] < 45 else 0), zdr=x[10], phidp=x[11]) for x in rows]
    again = {(x.ray, x.t): x for x in signatures.broad_folds(frame(spark, worse), ["s"], signatures.Broad(**{**B.__dict__, "blocks": 1, "samples": 5, "reference_span_m": 3000})).filter("t = 2").collect()}
    assert again[0, 2].intercept == pytest.approx(folds[0, 2].intercept, abs=0.2)  # blocks 1 to 3 hold the change, block 2 and its guards are out


def test_nothing(spark):
    none = frame(spark, [])
    o, g = signatures.range_objects(none, ["s"], P)
    assert o.count() == g.count() == signatures.broad_source(none, ["s"], B).count() == signatures.fitted(none, ["s"], P).count() == 0
