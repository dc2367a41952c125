"""Counts, strips, lists and sessions of an operations room over the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolith.functions import physics
from hydrolith.operators import ranks
from hydrolith.plans.registry import load, query
from hydrolith.plans.views import CELLS_SQL, SCANS_SQL, cells, scans


@query("non_empty_counts", "SELECT o_orderpriority AS kind, count(*) AS rows_all, count(NULLIF(CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderstatus END, '')) AS non_empty FROM orders GROUP BY 1")
def non_empty_counts(spark, sf_dir):
    note = F.when(F.col("o_custkey") % 5 == 0, "").when(F.col("o_custkey") % 7 == 0, None).otherwise(F.col("o_orderstatus"))
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("rows_all"), F.count(F.nullif(note, F.lit(""))).alias("non_empty"))


_STAGE = {"done": "value >= 20", "running": "value >= 10 AND value < 20", "queued": "value >= 5 AND value < 10", "failed": "value < 5"}


@query(
    "stage_strip",
    f"SELECT status AS stage, {', '.join(f'count(*) FILTER (WHERE {w}) AS {n}' for n, w in _STAGE.items())}, quantile_disc(value, 0.5) FILTER (WHERE value >= 20) AS p50_done FROM ({SCANS_SQL}) GROUP BY 1",
)
def stage_strip(spark, sf_dir):
    """The strip over the stages: how many are done, running, queued and failed,
    and the nearest-rank median of the done ones."""
    s = scans(spark, sf_dir).withColumnRenamed("status", "stage")
    counts = s.groupBy("stage").agg(*[F.count_if(F.expr(w)).alias(n) for n, w in _STAGE.items()])
    p50 = ranks.nearest_ranks(s.filter(_STAGE["done"]), ["stage"], "value", {"p50_done": 0.5}).drop("n")
    return counts.join(p50, "stage", "left")


@query(
    "weighted_available",
    f"""SELECT analysis, y, x, source, ray, round((coalesce(3 * a, 0) + coalesce(2 * b, 0) + coalesce(1 * c, 0)) / NULLIF((CASE WHEN a IS NULL THEN 0.0::DOUBLE ELSE 3 END) + (CASE WHEN b IS NULL THEN 0 ELSE 2 END) + (CASE WHEN c IS NULL THEN 0 ELSE 1 END), 0), 9) + 0.0::DOUBLE AS score
    FROM (SELECT analysis, y, x, source, ray, dbzh / 80 AS a, CASE WHEN valid THEN quality END AS b, CASE WHEN source <> 2 THEN data_age_min / 10 END AS c FROM ({CELLS_SQL}))""",
)
def weighted_available(spark, sf_dir):
    parts = [F.col("dbzh") / 80, F.when(F.col("valid"), F.col("quality")), F.when(F.col("source") != 2, F.col("data_age_min") / 10)]
    return cells(spark, sf_dir).select("analysis", "y", "x", "source", "ray", (F.round(physics.mean_of_available(parts, [3.0, 2.0, 1.0]), 9) + 0.0).alias("score"))


@query(
    "panel_reference",
    f"""WITH s AS ({SCANS_SQL}), a AS (SELECT DISTINCT t // 3600 * 3600 AS t0 FROM s), c AS (SELECT t0, radar, scan_id, abs(t - t0) AS apart, row_number() OVER (PARTITION BY t0, radar ORDER BY abs(t - t0), scan_id) AS r FROM a JOIN s ON status <> 'error' AND t BETWEEN t0 - 300 AND t0 + 300)
    SELECT t0, radar, scan_id, apart FROM c WHERE r = 1""",
)
def panel_reference(spark, sf_dir):
    """For each panel hour and radar: its nearest scan that takes part, at most
    five minutes off, of equal ones the lowest id. A scan within reach of an hour
    rounds to it, so there is no join of all times."""
    s = scans(spark, sf_dir)
    hours = s.select((F.floor(F.col("t") / 3600) * 3600).alias("t0")).distinct()
    near = s.filter("status <> 'error'").withColumn("t0", F.floor((F.col("t") + 1800) / 3600) * 3600).withColumn("apart", F.abs(F.col("t") - F.col("t0"))).filter("apart <= 300")
    best = near.groupBy("t0", "radar").agg(F.min(F.struct("apart", "scan_id")).alias("_b"))
    return best.join(hours, "t0", "left_semi").select("t0", "radar", "_b.scan_id", "_b.apart")


@query(
    "run_list",
    f"SELECT radar AS run, modified, completed, row_number() OVER (ORDER BY modified DESC, completed DESC NULLS LAST, radar) AS place FROM (SELECT radar, max(t) // 86400 * 86400 AS modified, max(CASE WHEN status = 'purchase' THEN t END) AS completed FROM ({SCANS_SQL}) GROUP BY 1) QUALIFY place <= 50",
)
def run_list(spark, sf_dir):
    """The first page of runs, last modified first, then last completed; the
    order is made of the page's 50 rows and not of all runs."""
    runs = scans(spark, sf_dir).groupBy(F.col("radar").alias("run")).agg((F.floor(F.max("t") / 86400) * 86400).alias("modified"), F.max(F.when(F.col("status") == "purchase", F.col("t"))).alias("completed"))
    order = [F.desc("modified"), F.desc_nulls_last("completed"), F.asc("run")]
    return runs.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(
    "sessions",
    f"""WITH s AS ({SCANS_SQL}), g AS (SELECT *, sum(CASE WHEN t - p < 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY radar ORDER BY t, scan_id) AS k FROM (SELECT *, lag(t) OVER (PARTITION BY radar ORDER BY t, scan_id) AS p FROM s))
    SELECT radar, min(t) AS begins, max(t) + 1800 AS ends, count(*) AS scans FROM g GROUP BY radar, k""",
)
def sessions(spark, sf_dir):
    """Sessions of a radar: scans less than half an hour apart."""
    s = scans(spark, sf_dir).withColumn("at", F.timestamp_seconds("t"))
    gap = "1799 seconds 999999 microseconds"  # windows that touch are one, and a pause of half an hour parts sessions
    w = s.groupBy("radar", F.session_window("at", gap)).agg(F.min("t").alias("begins"), (F.max("t") + 1800).alias("ends"), F.count("*").alias("scans"))
    return w.select("radar", "begins", "ends", "scans")
