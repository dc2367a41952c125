"""Ranks are joined to values as rows, not as arrays on every value."""

from pyspark.sql import functions as F

from hydrolith.operators import ranks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_meet_values_as_rows(spark):
    values = [v % 500 / 4 for v in range(3000)]
    df = spark.createDataFrame([(k, v) for k in (1, None) for v in values], "k int, v double")
    asked = [1, 3000, *range(1, 3000, 7), 5, 5, 3001]
    found = ranks.values_at(df, ["k"], "v", F.array(*[F.lit(r) for r in asked]), few=10, slice_rows=100)
    inner = ranks._sliced(df, ["k"], "v", spark.createDataFrame([(1, (0, 5))], "k int, _w struct<i:int,r:long>"), 4)
    assert "collect_list" not in plan(inner)
    want = {i: sorted(values)[r - 1] for i, r in enumerate(asked) if r <= 3000}
    assert {r.k: {x.i: x.v for x in r["_at"]} for r in found.collect()} == {1: want, None: want}
