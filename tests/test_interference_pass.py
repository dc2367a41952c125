"""The evidence of rays is one pass over gates that are dealt once, with the same values."""

import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from hydrolith.operators import interference
from hydrolith.plans import interference_queries, views

SF = "/root/testdata/sf0.001"
R, G, LEAST = 8, 30, 3


def test_gates_are_dealt_by_sweep(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    assert interference_queries.gates(spark, SF).rdd.getNumPartitions() >= 10


@pytest.mark.parametrize("name", ["interference_decision", "radial_fan_closure", "radial_interference", "radial_gates"])
def test_gates_are_dealt_once(spark, name):
    """Of the exchanges by more than the sweep only those that make the gates and the
    context are left, and all plans of gates are the same one to Spark."""
    d = getattr(interference_queries, name)(spark, SF)
    d.collect()
    final = d._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [m[1] for line in final.split("\n") if "ReusedExchange" not in line and (m := re.search(r"Exchange hashpartitioning\(([^)]*)\)", line))]
    assert len(dealt) == 4, dealt
    assert len([x for x in dealt if "gate" in x]) == 1 and len([x for x in dealt if "ray" in x]) == 2


@pytest.fixture(scope="module")
def gates():
    r = random.Random(5)
    z = {(s, ray, k): round(r.uniform(0, 40), 1) for s in (1, 2) for ray in range(R) for k in range(G) if r.random() < 0.85}
    for s, ray, k in list(z):
        if (s, ray) in ((1, 0), (2, R - 1)):
            z[s, ray, k] = 60.0 if k % 11 else None
        elif r.random() < 0.1:
            z[s, ray, k] = None
    return {at: v for at, v in z.items() if at[:2] != (2, 3)} | {(3, 2, 4): None}


def frame(spark, gates):
    rows = [(*at, 1000.0 * (at[2] + 1), v) for at, v in gates.items()] + [(None, 1, 1, 0.0, 9.0), (1, None, 1, 0.0, 9.0), (1, 1, None, 0.0, 9.0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "s long, ray int, gate int, range_m double, dbzh double").repartition(3)


def in_runs(at):
    """Lists of numbers that follow each other."""
    out = []
    for k in sorted(at):
        out[-1].append(k) if out and out[-1][-1] == k - 1 else out.append([k])
    return out


def baseline(gates, s, ray, k):
    v = [x for d in (-1, 1) if (x := gates.get((s, (ray + d) % R, k))) is not None]
    return sum(v) / len(v) if v else None


P = interference.Radial(rays=R, gates=G, run=8, segment=LEAST, difference_db=20.0)


def test_evidence_by_plain_rules(spark, gates):
    df = frame(spark, gates)
    got = {(x.s, x.ray): x for x in interference.radial_evidence(df, ["s"], P).collect()}
    own = {}
    for (s, ray, k), v in gates.items():
        if v is not None:
            own.setdefault((s, ray), {})[k] = (v, baseline(gates, s, ray, k))
    assert set(got) == set(own)
    marked = set()
    for at, v in own.items():
        x = got[at]
        apart = [abs(a - b) for a, b in v.values() if b is not None]
        long = [r for r in in_runs([k for k, (a, b) in v.items() if b is not None and a - b >= P.candidate_db]) if len(r) >= LEAST]
        assert (x.valid_gates, x.longest_run, x.segments, x.evidence_gates) == (len(v), max(map(len, in_runs(v))), len(long), sum(map(len, long)))
        assert x.difference == (median(apart) if apart else None)
        marked |= {(*at, k) for k in (v if x.dense else [k for r in long for k in r]) if x.probability > 0}
    assert any(x.dense for x in got.values()) and any(x.segments and not x.dense for x in got.values())
    assert {(x.s, x.ray, x.gate) for x in interference.evidence_gates(df, interference.radial_evidence(df, ["s"], P), ["s"], P).collect()} == marked


def test_every_ray_is_described(spark, gates):
    df = frame(spark, gates)
    got = {(x.s, x.ray): x for x in interference.described(df, ["s"], 30_000.0, P).collect()}
    assert set(got) == {(s, ray) for s in (1, 2, 3) for ray in range(R)}
    assert all(x.type is None and x.extent is None and not x.hard for at, x in got.items() if at == (2, 3) or at[0] == 3)
    assert {at: x.extent for at, x in got.items() if x.extent} == {(x.s, x.ray): x.extent for x in interference.boundary(df, ["s"], G, 30_000.0).collect()}
    assert {(x.s, x.ray) for x in interference.radial_evidence(df, ["s"], P).collect()} == {at for at, x in got.items() if x.type}


def test_quantiles_are_percentiles(spark):
    r = random.Random(2)
    rows = [(k, r.uniform(-9, 9) if k % 3 else 0.1) for k in range(20) for _ in range(k + 1)]
    df = spark.createDataFrame(rows, "k int, v double")
    a = df.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(f"p{i}") for i, q in enumerate((0.25, 0.5, 0.75))])
    b = df.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("a")).select("k", *[interference._quantile("a", q).alias(f"p{i}") for i, q in enumerate((0.25, 0.5, 0.75))])
    assert sorted(a.collect()) == sorted(b.collect())


def test_extended_keeps_columns(spark):
    rows = [(1, r, r == 0, 1.0, r in (1, 2, 3, 11), f"t{r}") for r in range(12)]
    x = spark.createDataFrame(rows, "s long, ray long, hard boolean, extent double, edge_like boolean, type string")
    got = interference.extended_fans(x, ["s"], 12).collect()
    assert sorted((g.ray, g.type) for g in got) == sorted((r, f"t{r}") for r in range(12))
    assert {g.ray for g in got if g.extended} == {1, 2, 11}
