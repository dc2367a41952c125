"""Rays' evidence with context, gates that it marks, fans closed and extended."""

import numpy as np
import pytest

from hydrolith.operators import interference

R, G = 24, 40
P = interference.Radial(rays=R, gates=G, run=20, segment=5, short_range_m=20_000, broad_run=25)


def sweep(values):
    return [(1, r, k, 1000.0 * (k + 1), None if np.isnan(z) else float(z)) for (r, k), z in np.ndenumerate(values)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "s long, ray long, gate long, range_m double, dbzh double")


@pytest.fixture(scope="module")
def kinds(spark):
    z = np.full((R, G), 5.0)
    z[0] = 40.0  # full
    z[3, :26], z[3, 26:] = 30.0, 6.0  # reverse
    z[6, 0:6] = z[6, 12:18] = z[6, 24:30] = 30.0  # intermittent
    z[9, 2:10] = 30.0  # near
    z[12, 25:35] = 30.0  # a far part
    z[15, :] = 44 + 20 * np.log10(np.arange(1, G + 1) / 10)  # grows as a source
    z[18, ::2] = np.nan
    return frame(spark, sweep(z) + [(None, 1, 1, 1000.0, 50.0)])


def test_kinds(spark, kinds):
    got = {x.ray: x for x in interference.radial_evidence(kinds.filter("s IS NOT NULL"), ["s"], P).collect()}
    assert [got[r].type for r in (0, 3, 6, 9, 12, 15)] == ["narrow", "reverse", "intermittent", "short_range", "narrow", "broad"]
    assert got[0].dense and got[15].dense and got[0].probability == got[15].probability == 0.95
    assert not got[6].dense and got[9].probability == got[12].probability == 0.5 and got[21].type == "none"
    assert got[18].valid_gates == G // 2 and interference.radial_evidence(kinds.limit(0), ["s"], P).count() == 0


def test_context_promotes_and_vetoes(spark, kinds):
    """One vote is the ray's own; null is unknown and no vote."""
    context = spark.createDataFrame([(1, 6, 0.9, None, None), (1, 9, 0.9, 0.9, 0.0), (1, 12, None, 0.1, None), (1, 3, 0.1, 0.5, 0.9)], "s long, ray long, persistence double, consistency double, vertical double")
    got = {x.ray: x for x in interference.radial_evidence(kinds.filter("s IS NOT NULL"), ["s"], P, context).collect()}
    assert got[6].promoted and got[12].promoted and got[6].probability == 0.95
    assert got[9].vetoed and not got[9].promoted and got[9].probability == 0.5
    assert not got[0].promoted and got[0].probability == 0.95


def test_marks_only_its_evidence(spark, kinds):
    own = kinds.filter("s IS NOT NULL")
    rays = interference.radial_evidence(own, ["s"], P)
    got = {}
    for x in interference.evidence_gates(own, rays, ["s"], P).collect():
        got.setdefault(x.ray, set()).add(x.gate)
    assert got[12] == set(range(25, 35)) and got[9] == set(range(2, 10)) and got[6] == {*range(6), *range(12, 18), *range(24, 30)}
    assert got[0] == got[15] == set(range(G)) and 21 not in got


def rays(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "s long, ray long, hard boolean, extent double, like_fan boolean, fills boolean, edge_like boolean")


def fan(r, hard=False, extent=1.0, like=False, fills=False, edge=False):
    return (r, hard, extent, like, fills, edge)


F = interference.Fans(gap_rays=3, seed_fraction=0.3, edge_rays=2)


def test_closed_over_the_seam(spark):
    rows = [fan(r, hard=r in (1, 10, 11, 16, 21)) for r in range(2, 22)] + [fan(22, like=True), fan(23), fan(0, fills=True, extent=0.9), fan(1, hard=True)]
    got = {x.ray for x in interference.closed_fans(rays(spark, rows), ["s"], 24, F).filter("closed").collect()}
    assert got == {22, 0}  # a gap of three from 21 to 1; 12 to 15 is too wide, 23 looks like nothing
    short = [(*x[:2], 0.2, *x[3:]) if x[0] == 0 else x for x in rows]
    assert {x.ray for x in interference.closed_fans(rays(spark, short), ["s"], 24, F).filter("closed").collect()} == {22}
    one = [fan(r, hard=r == 5, like=True) for r in range(24)]
    assert not interference.closed_fans(rays(spark, one), ["s"], 24, F).filter("closed").count()


def test_extended_one_after_another(spark):
    edge = {2, 3, 4, 8, 23, 22, 12, 14, 15}
    rows = [fan(r, hard=r in (0, 1, 11, 9), edge=r in edge, extent=0.5 if r == 12 else 1.0) for r in range(24)]
    got = {x.ray for x in interference.extended_fans(rays(spark, rows), ["s"], 24, F).filter("extended").collect()}
    assert got == {2, 3, 23, 22, 8}  # two at most; 12 does not reach, so 14 is not met
    assert not interference.extended_fans(rays(spark, [fan(r, edge=True) for r in range(24)]), ["s"], 24, F).filter("extended").count()
    assert interference.extended_fans(rays(spark, []), ["s"], 24, F).count() == interference.closed_fans(rays(spark, []), ["s"], 24, F).count() == 0
