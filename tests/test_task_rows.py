"""What a task holds does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from hydrolith.plans import grid_queries, object_queries, signature_queries, verification_queries, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [verification_queries.records, grid_queries.leads], ids=lambda f: f.__name__)
def test_partitions_follow_rows(spark, monkeypatch, rows):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    df = rows(spark, SF)
    assert df.select(F.spark_partition_id().alias("p")).distinct().count() >= 10
    assert df.count() == rows(spark, SF).distinct().count()


@pytest.mark.parametrize("rows", [object_queries.gates, signature_queries.gates], ids=["objects", "signatures"])
def test_gates_are_dealt_by_sweep(spark, monkeypatch, rows):
    monkeypatch.setattr(views, "TASK_ROWS", 500)
    assert rows(spark, SF).rdd.getNumPartitions() >= 10
