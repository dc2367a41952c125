"""Small functions that no query calls: codes, shown cells, pages of a snapshot, parts."""

import json

import pytest
from pyspark.sql import functions as F

from hydrolith.functions import physics
from hydrolith.operators import catalogue, grids
from hydrolith.profiles import flag
from hydrolith.sources import contracts, tables


def test_source_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "s string")
    assert {r.s: r.code for r in grids.source_codes(df, "s").collect()} == {"a": 1, "b": 2, "c": 3}
    assert grids.source_codes(df.limit(0), "s").count() == 0


def test_displayed(spark):
    bad = flag("GROUND_CLUTTER")
    df = spark.createDataFrame([(1, True, 5.0, 0), (2, True, 5.0, bad), (3, False, 5.0, 0), (4, True, None, 0)], "k int, eligible boolean, dbzh double, flags long")
    assert [r.k for r in grids.displayed(df, "flags", ("GROUND_CLUTTER",)).filter("shown").collect()] == [1]


def test_pages_of_a_snapshot(spark):
    """Rows that come after the first page was read do not move the next ones."""
    old = [(t, k) for t in (10, 20, 30) for k in (1, 2)]
    snapshot = F.col("t") <= 30
    first = catalogue.page(spark.createDataFrame(old, "t long, k long"), "t", "k", None, 2, snapshot).collect()
    grown = spark.createDataFrame([*old, (40, 1), (50, 1)], "t long, k long")
    second = catalogue.page(grown, "t", "k", (first[1].t, first[1].k), 2, snapshot).collect()
    assert [(r.t, r.k) for r in first[:2]] + [(r.t, r.k) for r in second[:2]] == sorted(old, reverse=True)[:4] and len(first) == len(second) == 3
    assert catalogue.page(grown, "t", "k", None, 1).first().t == 50


def test_db_or_floor(spark):
    df = spark.createDataFrame([(100.0,), (0.5,), (0.0,), (None,)], "v double").select(physics.db_or_floor(F.col("v"), 1.0, -15.0).alias("d"))
    assert [r.d for r in df.collect()] == [pytest.approx(20.0), -15.0, -15.0, None]


def test_parts_and_listings(spark, tmp_path):
    spark.createDataFrame([("20240101", 1), ("20240103", 2), ("20240104", 3)], "day string, v int").write.partitionBy("day").parquet(str(tmp_path / "t"))
    df = spark.read.schema("v int, day string").parquet(str(tmp_path / "t"))
    got = tables.partitions_since(df, "day", F.to_timestamp(F.lit("2024-01-04 12:00:00")), 86_400)
    assert sorted(r.v for r in got.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().executedPlan().toString()
    pages = spark.createDataFrame([("l", "<Key>a.gz</Key><Key>b.txt</Key><Key>a.gz</Key>"), ("m", None)], "listing string, body string")
    assert [(r.listing, r.name) for r in tables.listed_objects(pages, r"<Key>([^<]*\.gz)</Key>").collect()] == [("l", "a.gz")]


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"case": "x", "scores": [{"lead": 6, "csi": 0.5}]}, indent=1))
    got = tables.read_reports(spark, str(tmp_path), "case string, scores array<struct<lead: int, csi: double>>").select("case", F.inline("scores")).collect()
    assert [tuple(r) for r in got] == [("x", 6, 0.5)]


WHOLE = {"scan_id": "s", "radar": "r", "moment": "DBZH", "value": 1.0, "valid": True, "quality": 0.5, "flags": 0, "contributors": 1, "confidence": 0.5, "lead_min": 6}
BREAKS = {"missing_is_null": {"valid": False}, "quality_in_range": {"quality": 2.0}, "no_quality_of_missing": {"valid": False, "value": None}, "flags_not_negative": {"flags": -1}, "contributed": {"contributors": 0}, "not_negative": {"value": -1.0}, "confidence_in_range": {"confidence": -0.1}, "on_the_step": {"lead_min": 7}}


@pytest.mark.parametrize("name", sorted(contracts.CONTRACTS))
def test_contracts(spark, name):
    """A row that keeps all rules, one that breaks each, one without a key, a repeat."""
    c = contracts.CONTRACTS[name]
    schema = ", ".join(f"{k} {t}" for k, t in c.columns.items())
    row = lambda k, **other: tuple(({**WHOLE, **{x: k for x in c.columns if x not in WHOLE}, **other})[x] for x in c.columns)
    rows = [row(0), row(0), row(1, **{c.key[-1]: None})] + [row(n + 2, **BREAKS[rule]) for n, rule in enumerate(c.rules)]
    got = {r.rule: r.rows for r in contracts.violations(spark.createDataFrame(rows, schema), c).collect()}
    assert got["key_is_not_null"] == got["key_is_unique"] == 1 and all(got[rule] >= 1 for rule in c.rules)
    clean = spark.createDataFrame([row(0), row(1)], schema)
    assert all(r.rows == 0 for r in contracts.violations(clean, c).collect()) and not contracts.missing_columns(clean, c)
    assert all(r.rows == 0 for r in contracts.violations(clean.limit(0), c).collect()) and contracts.missing_columns(clean.drop(c.key[0]), c) == [c.key[0]]
