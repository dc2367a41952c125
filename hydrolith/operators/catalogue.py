"""Catalogue reads: newest rows, pages, windows, retention, counts.

Newest and first rows are aggregates of structs, so each task sends one row for
each key; a window would send them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.operators import ranks


def newest(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (a total order)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def page(df: DataFrame, time: str, key: str, after: tuple | None, limit: int, snapshot: Column | None = None) -> DataFrame:
    """A page, newest first, after the cursor (time, key), with one row more
    than asked for if there is a next page. Only top rows are moved."""
    if snapshot is not None:
        df = df.filter(snapshot)
    if after is not None:
        t, k = (F.lit(x) if not isinstance(x, Column) else x for x in after)
        df = df.filter((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < k)))
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(limit + 1)


def optional(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality filters; a value of None or an empty text filters nothing."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])) if kv[1] not in (None, "") else d, wanted.items(), df)


def allowed(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose lower-cased column is on a list, which is trimmed, lower-cased
    and without repeats; an empty list allows all."""
    clean = sorted({n.strip().lower() for n in names if n.strip()})
    return df.filter(F.lower(F.col(column)).isin(clean)) if clean else df


def merged_windows(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of half-open windows that overlap or touch, for each key."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.select(*keys, start, end).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = flagged.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def zero_preserving(stations: DataFrame, volumes: DataFrame, key: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of volumes for every key of either table, also without any."""
    keys = stations.select(key).union(volumes.select(key)).filter(F.col(key).isNotNull()).distinct()
    return keys.join(volumes.withColumn("_there", F.lit(1)), key, "left").groupBy(key).agg(F.count("_there").alias("volumes"), *aggregates)


def retention_ranks(df: DataFrame, kind: list[str], version: list[str], order: list[str]) -> DataFrame:
    """Ranks from the newest: within a kind, and within a kind and version."""
    by = [F.col(c).desc() for c in order]
    return df.withColumns({"kind_rank": F.row_number().over(Window.partitionBy(*kind).orderBy(*by)), "version_rank": F.row_number().over(Window.partitionBy(*kind, *version).orderBy(*by))})


def expired(df: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """What is to be deleted if the newest ``keep`` of each key stay."""
    if not 1 <= keep <= 10:
        raise ValueError("keep is from 1 to 10")
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > keep).drop("_n")


def measured(value: str) -> Column:
    """Values that count as measurements: not negative, infinite or NaN."""
    v = F.col(value)
    return F.when((v >= 0) & ~F.isnan(v) & (v != float("inf")), v)


def runtimes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """samples, p50, p95 (at rank ceil(n q)) and maximum of the measurements."""
    ok = df.withColumn(value, measured(value))
    top = ok.groupBy(*keys).agg(F.max(value).alias("maximum"))
    return ranks.met(ranks.nearest_ranks(ok, keys, value, {"p50": 0.5, "p95": 0.95}).withColumnRenamed("n", "samples"), top, keys)


def run_state(mode: Column, n: dict[str, Column]) -> Column:
    """The state of a run from its mode and the counts of its tasks by state."""
    of = lambda *names: sum((F.coalesce(n[x], F.lit(0)) for x in names), F.lit(0))
    active, pending, bad, good = of("RUNNING", "COMMITTING"), of("QUEUED", "WAITING"), of("FAILED", "BLOCKED"), of("SUCCEEDED")
    by_counts = F.when(active > 0, "RUNNING").when(pending > 0, "QUEUED").when(bad > 0, F.when(good > 0, "PARTIAL_SUCCESS").otherwise("FAILED")).when(good > 0, "SUCCEEDED").otherwise("QUEUED")
    return F.when(mode == "CANCELLED", F.when(active > 0, "CANCELLING").otherwise("CANCELLED")).when(mode == "PAUSED", "PAUSED").otherwise(by_counts)


def missing_members(df: DataFrame, keys: list[str], member: str, expected: Column) -> DataFrame:
    """Expected members (an array) that a key does not have, in order."""
    have = F.collect_set(member)
    return df.groupBy(*keys).agg(F.array_sort(F.array_except(expected, have)).alias("missing"))
