"""How the driver's tables stand for radar tables, in Spark and in SQL.

``events`` are scans of radars (users); ``lineitem`` rows are gates or cells of
sources; both spellings of a view hold the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrolith.plans.registry import load

#: scan_id, radar, status, t (whole seconds), value.
SCANS_SQL = "SELECT event_id AS scan_id, user_id AS radar, event_type AS status, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t, value FROM events"

_CELL = """l_suppkey % 4 AS analysis, l_partkey % 48 AS y, l_orderkey % 48 AS x, l_linenumber AS source, l_orderkey AS ray, l_linenumber AS gate,
 CASE WHEN (l_orderkey + l_partkey) % 11 = 0 THEN NULL ELSE CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber * 13) % 800 AS DOUBLE) / 10 - 10 END AS dbzh,
 CAST((l_orderkey + l_linenumber * 17) % 101 AS DOUBLE) / 100 AS quality, (l_partkey * 31 + l_orderkey) % 2048 * 8 AS qc_flags, (l_orderkey + l_suppkey) % 13 <> 0 AS valid,
 CAST(l_partkey % 150 AS DOUBLE) AS offset_s, CAST(l_suppkey % 7 AS DOUBLE) AS data_age_min, CAST((l_orderkey * 3 + l_linenumber) % 150 AS DOUBLE) * 1000 AS distance_m"""
CELLS_SQL = f"SELECT {_CELL} FROM lineitem"


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").selectExpr("event_id AS scan_id", "user_id AS radar", "event_type AS status", "unix_seconds(CAST(ts AS TIMESTAMP)) AS t", "value")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*split_columns(_CELL))


#: Rows of a table that a task takes where keys are nearly as many as rows.
TASK_ROWS = 500_000


def spread(df: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """The rows dealt by the hash of ``keys`` over as many partitions as their number
    (that of ``of``, where they are made from it) asks for, so what a task holds does not
    grow with the table. Groups by these and further keys need no other shuffle. One job
    counts the rows, by the files' footers."""
    parts = max(-(-(df if of is None else of).count() // TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def split_columns(columns: str) -> list[str]:
    """Splits a select list at the commas outside parentheses."""
    out, depth, piece = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(piece.strip())
            piece = ""
        else:
            piece += c
    return [*out, piece.strip()]
