"""What objects claim beyond their intervals, against loops over gates."""

from dataclasses import replace

import numpy as np
import pytest

import __spark_entry__ as entry
from hydrolith.operators import objects
from tests.test_objects import G, P, R, table


def key(x):
    return x.s, x.ray, x.gate


@pytest.mark.parametrize("along,across,rough", [(2500.0, 2.0, False), (4000.0, 0.0, True), (3000.0, 90.0, True)])
def test_members_edges_and_what_lies_around(spark, along, across, rough):
    _, df = table(spark, 3, holes=0.05)
    p = replace(P, review=True, review_m=along, review_deg=across, rough=rough)
    seeds = objects.object_seeds(df, ["s"], p).cache()
    at = {key(x): x for x in seeds.collect()}
    inner = objects.radial_objects(seeds, ["s"], p)[1]
    want = {key(x): (x.object, x.linked, x.own, x.rough, x.edge) for x in objects.with_edges(seeds, inner, ["s"], p).collect()}
    got = objects.object_gates(seeds, inner, ["s"], p).collect()
    assert {key(x): (x.object, x.linked, x.own, x.rough, x.edge) for x in got if not x.review} == want
    assert any(v[4] for v in want.values()) and len(got) == len({key(x) for x in got})
    n, m = int(-(-across // 45)), max(1, int(along // 1000))
    around = set()
    for s in ("a", "b"):
        ids = np.zeros((R, G), bool)
        for t, r, k in want:
            ids[r, k] |= t == s
        for r in range(R):
            for k in range(G):
                x = at.get((s, r, k))
                near = ids[max(0, r - n) : r + n + 1, max(0, k - m) : k + m + 1].any()
                if x and near and not ids[r, k] and x.echo and x.support >= p.support and not x.protected and (x.rough or x.stands or x.low):
                    around.add((s, r, k))
    assert {key(x) for x in got if x.review} == around and around
    assert not {x.object for x in got if x.review} - {0}


def test_high_correlation_is_checked_where_it_may_be_a_signature(spark):
    p = replace(P, review=True, high_rho=True)
    gate = lambda r, k, echo, std: ("a", r, k, echo, 1.0, std, False, False, False, False)
    seeds = spark.createDataFrame([gate(1, 5, True, 1.0), gate(1, 6, True, 6.0), gate(2, 6, True, 6.5), gate(0, 5, False, 1.0), gate(3, 5, True, 1.0), gate(7, 5, True, 1.0)], "s string, ray long, gate long, echo boolean, support double, axial_std double, protected boolean, rough boolean, stands boolean, low boolean")
    inner = spark.createDataFrame([("a", 1, 5), ("a", 0, 5)], "s string, ray long, gate long")
    assert [key(x) for x in objects.peripheral(seeds, inner, ["s"], p).collect()] == [("a", 1, 6)]  # ray 7 is not beside ray 0 here
    assert objects.peripheral(seeds, inner, ["s"], replace(p, high_rho=False)).count() == 0


def test_query_has_edges_and_what_lies_around(spark):
    got = entry.queries()["object_members"](spark, "/root/testdata/sf0.01").collect()
    edges = {(x.sweep, x.ray, x.gate, x.object) for x in got if x.edge}
    assert edges == {tuple(x) for x in entry.queries()["object_edges"](spark, "/root/testdata/sf0.01").collect()} and edges
    assert any(x.review for x in got) and any(x.rough for x in got)
    assert all((x.object == 0) == x.review for x in got)


def test_nothing_gives_nothing(spark):
    _, df = table(spark, 3)
    seeds = objects.object_seeds(df.limit(0), ["s"], P)
    assert objects.object_gates(seeds, objects.radial_objects(seeds, ["s"], P)[1], ["s"], replace(P, review=True)).count() == 0
