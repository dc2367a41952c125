"""The compiled forest against a walk through its trees, and on volumes held out."""

import numpy as np
import pytest

from hydrolith.operators import classifier


def rows(n=4000):
    g = np.random.default_rng(1)
    out = []
    for i in range(n):
        a, b, c = g.normal(), g.normal(), g.normal()
        label = bool((a > 0.3) != (b > 0)) if g.random() > 0.02 else None
        out.append((i % 40, a if g.random() > 0.05 else None, b if g.random() > 0.03 else float("nan"), c, label))
    return out


def test_compiled_trees_and_held_out_volumes(spark):
    df = spark.createDataFrame(rows(), "v long, a double, b double, c double, bad boolean")
    features = ["a", "b", "c"]
    forest = classifier.fit(df, features, "bad", ["v"])
    again = classifier.fit(df.repartition(7), features, "bad", ["v"])
    assert forest == again and max(len(str(t)) for t in forest) > 200
    got = df.withColumns({"p": classifier.probability(forest, features), "out": classifier.held_out(["v"])}).collect()
    for r in got[:400]:
        assert r.p == pytest.approx(np.mean([classifier.leaf_of(t, [r.a, r.b, r.c]) for t in forest]))
    out = [r for r in got if r.out and r.bad is not None]
    assert 0 < len({r.v for r in out}) < 40 and not {r.v for r in out} & {r.v for r in got if not r.out}
    assert np.mean([(r.p >= 0.5) == r.bad for r in out]) > 0.85


def test_bounds_of_the_sample(spark):
    """Any number of rows gives a forest; none, or one class, gives leaves."""
    df = spark.createDataFrame(rows(600), "v long, a double, b double, c double, bad boolean")
    few = classifier.fit(df, ["a", "b", "c"], "bad", ["v"], trees=2, sample=50)
    assert len(few) == 2
    for none in (df.limit(0), df.filter("bad IS NULL"), df.filter("NOT bad")):
        forest = classifier.fit(none, ["a", "b", "c"], "bad", ["v"], trees=3)
        assert [t.feature for t in forest] == [-1] * 3 and {r.p for r in df.limit(3).select(classifier.probability(forest, ["a", "b", "c"]).alias("p")).collect()} == {0.0}
