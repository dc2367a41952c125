"""Exact ranks, labels of runs and states of rays against plain versions."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrolith.operators import kernels, ranks

ROWS = [("a", float(i * 7919 % 1000)) for i in range(1000)] + [("b", 3.0)] * 50 + [("b", 4.0)] * 2 + [(None, v) for v in (1.0, 2.0, None)] + [("c", None)]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame(ROWS, "k string, v double")


def by_key():
    return {k: sorted(v for key, v in ROWS if key == k and v is not None) for k in ("a", "b", None, "c")}


@pytest.mark.parametrize("few", [10**6, 0])
def test_nearest_ranks(values, few):
    """By one sorted array a key, and by slices of 100 rows."""
    got = {r.k: r for r in ranks.nearest_ranks(values, ["k"], "v", {"lo": 0.0, "mid": 0.5, "high": 0.95, "top": 1.0}, few=few, slice_rows=100).collect()}
    for k, v in by_key().items():
        want = [v[max(1, math.ceil(len(v) * q)) - 1] if v else None for q in (0.0, 0.5, 0.95, 1.0)]
        assert [got[k].n, got[k].lo, got[k].mid, got[k].high, got[k].top] == [len(v), *want]


@pytest.mark.parametrize("few", [10**6, 0])
def test_interpolated(values, few):
    got = {r.k: r.q for r in ranks.interpolated(values, ["k"], "v", {"q": 0.37}, few=few, slice_rows=100).collect()}
    for k, v in by_key().items():
        assert got[k] == (pytest.approx(np.quantile(v, 0.37)) if v else None)


def test_ranks_of_an_empty_table(values):
    for few in (10**6, 0):
        assert ranks.nearest_ranks(values.limit(0), ["k"], "v", {"mid": 0.5}, few=few).count() == 0


def test_slices_follow_the_rows(values):
    """A hot key has as many slices as its rows ask for, and no sort of it all."""
    sliced = ranks.nearest_ranks(values, ["k"], "v", {"mid": 0.5}, few=0, slice_rows=10)
    plan = sliced._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" in plan and "0.99" in plan
    assert {r.k: r.mid for r in sliced.collect()}["a"] == by_key()["a"][499]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 5), st.integers(0, 7)), min_size=1))
def test_run_labels(gates):
    runs = []
    for ray, gate in sorted(gates):
        if runs and runs[-1][0] == ray and runs[-1][2] == gate - 1:
            runs[-1][2] = gate
        else:
            runs.append([ray, gate, gate])
    label = kernels.run_labels(*np.array(runs).T, 6)
    of = {(r, g): int(x) for (r, a, b), x in zip(runs, label, strict=True) for g in range(a, b + 1)}
    seen: dict = {}
    for start in sorted(gates):
        if start in seen:
            continue
        todo, seen[start] = [start], start
        while todo:
            r, g = todo.pop()
            for n in (((r + 1) % 6, g), ((r - 1) % 6, g), (r, g + 1), (r, g - 1)):
                if n in gates and n not in seen:
                    seen[n] = start
                    todo.append(n)
    assert len({(seen[g], of[g]) for g in gates}) == len(set(seen.values())) == len(set(of.values()))
    assert all(of[g] == of[seen[g]] for g in gates)


def test_states_against_all_sequences():
    rng = np.random.default_rng(3)
    size = np.array([6, 1, 4, 6])
    p = np.zeros((4, 6))
    for i, n in enumerate(size):
        p[i, :n] = rng.uniform(0.05, 0.95, n)
    hit, miss = np.log(np.where(p > 0, p, 1)), np.log(1 - p)
    got = kernels.likeliest(hit, miss, size, 0.8)

    def worth(i, s):
        return sum(hit[i, j] if x else miss[i, j] for j, x in enumerate(s)) + sum(math.log(0.8 if a == b else 0.2) for a, b in itertools.pairwise(s))

    for i, n in enumerate(size):
        best = max(itertools.product((0, 1), repeat=int(n)), key=lambda s: worth(i, s))
        assert got[i, :n].tolist() == list(best)
