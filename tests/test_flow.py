"""Motion fields and frames between frames on moved fields with known answers."""

import numpy as np
import pytest

from hydrolith.operators import flow


def clouds(h, w, seed=3, n=60):
    """A function of shifts (numbers or grids) to a field of blobs so moved."""
    g = np.random.default_rng(seed)
    high, cy, cx, wide = g.uniform(5, 20, n), g.uniform(-20, h + 20, n), g.uniform(-20, w + 20, n), g.uniform(3, 7, n)
    y, x = np.mgrid[:h, :w]

    def make(sy, sx):
        out = np.zeros((h, w))
        for k in range(n):
            out += high[k] * np.exp(-((y - sy - cy[k]) ** 2 + (x - sx - cx[k]) ** 2) / (2 * wide[k] ** 2))
        return out

    return make


def test_a_shear_of_eight_cells():
    """The top moves eight cells to the right, the bottom eight to the left."""
    h = w = 96
    make = clouds(h, w)
    y, _ = np.mgrid[:h, :w]
    dx = 8.0 * (1 - 2 * y / (h - 1))
    a = make(0, 0)
    b = make(np.zeros((h, w)), dx)
    v, u, s = flow.dense_motion(a, b)
    inner = s.copy()
    inner[:12], inner[-12:], inner[:, :12], inner[:, -12:] = False, False, False, False
    assert inner.mean() > 0.4
    assert np.median(np.abs(u - dx)[inner]) < 0.25 and np.percentile(np.abs(u - dx)[inner], 90) < 0.5
    assert np.percentile(np.abs(v)[inner], 90) < 0.5


def test_wild_features_do_not_count():
    """A patch that jumps elsewhere is outvoted by what lies around it."""
    a = clouds(80, 80, 5)(0, 0)
    b = clouds(80, 80, 5)(3, -2)
    b[30:38, 30:38] = np.random.default_rng(1).uniform(0, 30, (8, 8))
    v, u, s = flow.dense_motion(a, b)
    mid = np.s_[12:-12, 12:-12]
    assert np.percentile(np.abs(v[mid] - 3), 80) < 0.5 and np.percentile(np.abs(u[mid] + 2), 80) < 0.5


def test_nothing_to_follow():
    for a in (np.zeros((20, 20)), np.full((20, 20), np.nan), np.ones((2, 2))):
        v, u, s = flow.dense_motion(a, a)
        assert not v.any() and not u.any() and not s.any()
    lone = np.where(np.add.outer(np.arange(30), np.zeros(30)) < 15, clouds(30, 30)(0, 0), np.nan)
    assert np.isfinite(flow.dense_motion(lone, lone)[0]).all()


def test_warp_needs_its_stencil():
    a = np.arange(16.0).reshape(4, 4)
    a[1, 1] = np.nan
    got = flow.warped(a, np.full((4, 4), 1.0), np.zeros((4, 4)))
    assert np.isnan(got[0]).all() and got[1].tolist() == a[0].tolist() and np.isnan(got[2, 1])
    half = flow.warped(a, np.full((4, 4), 0.5), np.zeros((4, 4)))
    assert half[3, 0] == 10.0 and np.isnan(half[1, 1]) and np.isnan(half[2, 1])


@pytest.fixture(scope="module")
def frames(spark):
    make = clouds(48, 48, 7)
    rows = []
    for m in (0, 1):
        for t in (0, 10, 20, 30):
            f = make(0.4 * t, 0.3 * t) * (1 + m)
            rows += [("a", m, t, int(y), int(x), float(z)) for (y, x), z in np.ndenumerate(f)]
    rows += [("b", 0, 0, 0, 0, 1.0), ("b", 0, 10, 0, 0, None), ("b", 0, 30, 1, 1, 2.0), (None, 0, 10, None, 1, 1.0)]
    return spark.createDataFrame(rows, "k string, member long, lead_min int, y long, x long, rate double")


def test_frames_between_frames(spark, frames):
    got = flow.resampled(frames, ["k"]).toPandas()
    a = got[got["k"] == "a"]
    assert sorted(a["lead_min"].unique()) == [6, 12, 18, 24, 30]
    make = clouds(48, 48, 7)
    for m, t in ((0, 6), (1, 12), (0, 24)):
        own = a[(a["member"] == m) & (a["lead_min"] == t)]
        grid = np.full((48, 48), np.nan)
        grid[own["y"], own["x"]] = own["rate"].astype(float)
        want = make(0.4 * t, 0.3 * t) * (1 + m)
        inner = np.isfinite(grid)
        inner[:8], inner[-8:], inner[:, :8], inner[:, -8:] = False, False, False, False
        # Far closer than either frame beside it.
        near = min(np.abs(make(0.4 * s, 0.3 * s) * (1 + m) - want)[inner].mean() for s in (t // 10 * 10, t // 10 * 10 + 10))
        assert inner.mean() > 0.3 and np.abs(grid - want)[inner].mean() < 0.25 * near
    last = a[(a["lead_min"] == 30) & (a["member"] == 1)]
    assert np.allclose(sorted(last["rate"].astype(float)), sorted((make(12, 9) * 2).ravel()))
    b = got[got["k"] == "b"]
    assert set(b["lead_min"]) == {6, 30} and b[b["lead_min"] == 6]["rate"].isna().all()
    assert flow.resampled(frames.limit(0), ["k"]).count() == 0


def test_motion_of_a_table(spark, frames):
    pair = frames.filter("k = 'a' AND member = 0 AND lead_min IN (0, 10)").groupBy("k", "y", "x").pivot("lead_min", [0, 10]).max("rate").toDF("k", "y", "x", "previous", "current")
    got = flow.motion_fields(pair, ["k"]).filter("supported AND y BETWEEN 12 AND 36 AND x BETWEEN 12 AND 36").toPandas()
    assert abs(got["dy"].median() - 4) < 0.3 and abs(got["dx"].median() - 3) < 0.3
    assert flow.motion_fields(pair.limit(0), ["k"]).count() == 0
