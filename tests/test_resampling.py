"""Bootstrap draws, mergeable pools, walks in time and tiles against plain versions."""

import itertools

import numpy as np
import pytest

from hydrolith.operators import asof, kernels, resampling, scores
from hydrolith.operators import verification as ver


def test_counts_of_a_tree_are_multinomial():
    """Leaves of 3, 5, 0 and 8 cases: each draw has 16, split as 16 draws of 16."""
    n = [3, 5, 0, 8]
    paths = [[(16, 8), (8, 3)], [(16, 8), (8, 3)], [(16, 8), (8, 0)], [(16, 8), (8, 0)]]
    drawn = np.stack([resampling.split_path(paths[leaf], leaf, 11, 20_000) for leaf in range(4)])
    assert (drawn.sum(0) == 16).all() and not drawn[2].any()
    for k, m in enumerate(n):
        p = m / 16
        assert drawn[k].mean() == pytest.approx(m, abs=0.05) and drawn[k].var() == pytest.approx(16 * p * (1 - p), rel=0.05, abs=1e-9)
    assert np.cov(drawn[0], drawn[3])[0, 1] == pytest.approx(-16 * 3 / 16 * 8 / 16, rel=0.08)


@pytest.mark.parametrize("sizes", [(1, 1, 1), (2, 3, 3), (7, 7, 2), (40, 1, 5)])
def test_drawn_sums(sizes):
    """Moments of a mean of issues drawn from cases of few and of many issues."""
    g = np.random.default_rng(3)
    values = [g.normal(2, 3, n) for n in sizes]
    counts = np.full(30_000, 4, np.int64)
    got = resampling.drawn_sums(values, counts, np.random.default_rng(1))
    means = np.array([v.mean() for v in values])
    inner = np.array([v.var() / len(v) for v in values])
    assert got.mean() == pytest.approx(4 * means.mean(), abs=0.05)
    assert got.var() == pytest.approx(4 * (means.var() + inner.mean()), rel=0.05)
    assert resampling.drawn_sums(values, np.zeros(5, np.int64), np.random.default_rng(1)).tolist() == [0.0] * 5


def test_bootstrap_with_a_deep_tree(spark):
    """Many leaves and one leaf give intervals of the same law; null keys are a key."""
    g = np.random.default_rng(8)
    rows = [(k, c, i, float(g.normal(c % 7, 1))) for k in ("a", None) for c in range(300) for i in range(1 + c % 3)]
    df = spark.createDataFrame(rows, "k string, c long, i long, value double")
    one = {r.k: r for r in resampling.block_bootstrap(df, ["k"], "c", "i").collect()}
    deep = {r.k: r for r in resampling.block_bootstrap(df.repartition(7), ["k"], "c", "i", leaf_cases=10).collect()}
    for k in ("a", None):
        wide = one[k].high - one[k].low
        assert one[k].mean == pytest.approx(deep[k].mean) and one[k].cases == deep[k].cases == 300
        assert abs(one[k].low - deep[k].low) < 0.12 * wide and abs(one[k].high - deep[k].high) < 0.12 * wide
    again = {r.k: r for r in resampling.block_bootstrap(df.repartition(2), ["k"], "c", "i", leaf_cases=10).collect()}
    assert all(again[k].low == pytest.approx(deep[k].low, abs=1e-9) for k in deep)
    assert resampling.block_bootstrap(df.limit(0), ["k"], "c", "i").count() == 0


def test_median_bootstrap(spark):
    """Against medians of samples; odd and even numbers, ties, one value, none."""
    g = np.random.default_rng(2)
    own = {"odd": g.normal(0, 1, 101), "even": g.normal(5, 2, 60), "ties": np.repeat([1.0, 2.0, 3.0], 15), "one": np.array([4.0])}
    rows = [(k, float(v)) for k, vs in own.items() for v in vs] + [("odd", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for few in (10**6, 0):
        got = {r.k: r for r in resampling.median_bootstrap(df, ["k"], "v", few=few, slice_rows=20).collect()}
        for k, v in own.items():
            draws = np.median(g.choice(v, (4000, len(v))), axis=1)
            low, high = np.quantile(draws, [0.025, 0.975])
            assert got[k].n == len(v) and got[k].median == pytest.approx(np.median(v))
            assert abs(got[k].low - low) <= 0.15 * (high - low) + 1e-9 and abs(got[k].high - high) <= 0.15 * (high - low) + 1e-9
        assert (got["none"].n, got["none"].median, got["none"].low) == (0, None, None)
    assert resampling.median_bootstrap(df.limit(0), ["k"], "v").count() == 0


def test_skill_gates(spark):
    def record(case, model, score, coverage=1.0, issue=0, lead=6):
        return (case, issue, lead, model, score, coverage)

    rows = [record(c, "lk", 0.6) for c in range(4)] + [record(c, "persistence", 0.5) for c in range(4)] + [record(c, "translation", 0.7 if c else 0.5) for c in range(4)]
    df = spark.createDataFrame(rows + [record(0, "lk", float("nan"), 1.0, 1), record(9, "translation", None, None)], "case long, issue long, lead long, model string, score double, coverage double")
    got = {r.baseline: r for r in resampling.paired_skill(df, [], "lk", 3, 0.9).collect()}
    assert (got["persistence"].positive, got["persistence"].evaluable, got["persistence"].cases, got["persistence"].passes) == (4, 4, 5, True)
    assert (got["translation"].positive, got["translation"].passes) == (1, False)
    assert got["persistence"].low == pytest.approx(0.1) == got["persistence"].high
    status = lambda f, n: resampling.skill_status(resampling.paired_skill(f, [], "lk", 3, 0.9), n).first().status
    assert status(df, 4) == "insufficient_evidence"  # case 9 has no comparison
    four = df.filter("case < 9")
    assert status(four, 4) == "translation_baseline_retained" and status(four, 5) == "insufficient_evidence"
    assert status(four.filter("model <> 'translation'"), 4) == "skill_not_demonstrated"
    assert resampling.skill_status(resampling.paired_skill(df.limit(0), [], "lk", 3), 1).first().status == "insufficient_evidence"


def test_pools_of_slices_merge(spark):
    """Any number of slices gives the fit of one group."""
    g = np.random.default_rng(6)
    p = np.round(g.random(600), 3)
    rows = [(k, float(x), int(g.random() < x**2)) for k in ("a", None) for x in p] + [("b", 0.5, None), ("b", None, 1)]
    df = spark.createDataFrame(rows, "k string, p double, event int")
    want = {}
    for k in ("a", "b", None):
        own = [(x, e or 0) for kk, x, e in rows if kk == k and x is not None]
        xs = sorted({x for x, _ in own})
        e, w = (np.array([sum(f(b) for a, b in own if a == x) for x in xs], float) for f in (lambda b: b, lambda b: 1))
        want |= {(k, x): (y, m) for x, y, m in zip(xs, ver.pool(e, w), w, strict=True)}
    for slices in (1, 16):
        got = {(r.k, r.x): (r.y, r.w) for r in ver.isotonic(df, ["k"], slices).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    assert ver.isotonic(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_context_walks_to_the_nearest(spark, same):
    """Against all pairs, with equal times, ids and sites and rows without them."""
    g = np.random.default_rng(4)
    rows = [(int(i), "ABC"[g.integers(3)] if g.random() < 0.9 else None, int(g.integers(0, 200))) for i in g.permutation(120)] + [(None, "A", 5), (500, "A", None)]
    rows += [(600 + i, "A", 1000) for i in range(6)] + [(700 + i, "B", 1000) for i in range(6)]
    got = {}
    for r in asof.context(spark.createDataFrame(rows, "i long, s string, t long"), "s", "t", "i", 9, 2, same, span_rows=10).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other_id))
    whole = [r for r in rows if r[0] is not None and r[2] is not None]
    for i, s, t in whole:
        of = lambda x, s=s: s is not None and x[1] is not None and x[1] == s if same else not (s is not None and x[1] == s)
        near = sorted((abs(x[2] - t), x[2], x[0]) for x in whole if x[0] != i and abs(x[2] - t) <= 9 and of(x))
        assert sorted(got.get(i, [])) == [(k + 1, x[2]) for k, x in enumerate(near[:2])]


def test_separated_with_stored_rounds(spark):
    """More rounds than one plan holds: the plan stays short and the picks greedy."""
    rows = [(0, f"r{i}", i * 100, float(i * 7919 % 101), i) for i in range(60)]
    df = spark.createDataFrame(rows, "month long, radar string, t long, value double, scan_id long")
    got = kernels.separated(df, ["month"], "t", "value", "radar", "scan_id", 250, 12)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    picks = []
    for r in sorted(rows, key=lambda r: (-r[3], r[4])):
        if len(picks) < 12 and all(abs(r[2] - x[2]) >= 250 for x in picks):
            picks.append(r)
    assert [r.scan_id for r in got.orderBy("rank").collect()] == [r[4] for r in picks]


def test_tiles_with_the_largest_rectangle_first(spark):
    """Against all rectangles and all tiles, one by one."""
    g = np.random.default_rng(9)
    on = g.random((15, 17)) < 0.9
    on[3:11, 4:13] = True
    on[14, 16] = True
    size, stride, multiple = 4, 3, 2
    best = max(
        ((h * w, min(h, w), w, -y, -x), (y, x, h, w))
        for h, w in itertools.product(range(4, 16, 2), range(4, 18, 2))
        for y, x in itertools.product(range(16 - h), range(18 - w))
        if on[y : y + h, x : x + w].all()
    )[1]
    assert scores.largest_rectangle(on, size, multiple) == best
    starts = lambda n: sorted({*range(0, n - size + 1, stride), n - size})
    tiles = [(y, x) for y in starts(15) for x in starts(17) if on[y : y + size, x : x + size].all()]
    left = np.zeros_like(on)
    for y, x in tiles:
        left[y : y + size, x : x + size] = True
    left[best[0] : best[0] + best[2], best[1] : best[1] + best[3]] = False
    want = [best]
    while len(want) < 9:
        gain, y, x = max((int(left[y : y + size, x : x + size].sum()), -y, -x) for y, x in tiles)
        if not gain:
            break
        want.append((-y, -x, size, size))
        left[-y : -y + size, -x : -x + size] = False
    cells = [(None, int(y), int(x)) for y, x in np.argwhere(on)] * 2 + [(None, None, 3), ("few", 0, 0)]
    df = spark.createDataFrame(cells, "k string, y long, x long")
    got = scores.covering_tiles(df, ["k"], size, stride, 9, multiple).orderBy("tile").collect()
    assert [(r.top, r.left, r.height, r.width) for r in got] == want and {r.k for r in got} == {None}
    assert scores.covering_tiles(df.limit(0), ["k"], size, stride, 9).count() == 0
