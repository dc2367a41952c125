"""Ordered operators along a ray, a series or a run of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: str, state: Column, step: int | None = None) -> DataFrame:
    """Adds ``island``: rows in order that share a state (and, with ``step``,
    follow one another by it) have one number."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = state.eqNullSafe(F.lag(state).over(w))
    if step is not None:
        new = new & (F.col(order) - F.lag(order).over(w) == step)
    return df.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w)).drop("_new")


def bridged(df: DataFrame, keys: list[str], order: str, valid: str, most: int) -> DataFrame:
    """Runs of valid rows, joined over at most ``most`` missing positions:
    keys, first, last, count of valid rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = df.filter(F.col(valid)).withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) <= most + 1, 0).otherwise(1))
    return v.withColumn("_i", F.sum("_new").over(w)).groupBy(*keys, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("valid_count")).drop("_i")


def running_blockage(df: DataFrame, ray: list[str], gate: str, partial: str) -> DataFrame:
    """Adds ``cumulative``: the largest blockage so far along a ray, null from
    the first missing gate on."""
    w = Window.partitionBy(*ray).orderBy(gate).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.max(F.col(partial).isNull().cast("int")).over(w) == 1
    return df.withColumn("cumulative", F.when(~lost, F.max(partial).over(w)))


def two_way_path(df: DataFrame, keys: list[str], range_km: str, specific: str) -> DataFrame:
    """Adds ``pia``: twice the trapezoid integral of a specific attenuation
    within each run of rows that have one; null elsewhere."""
    order = Window.partitionBy(*keys).orderBy(range_km)
    run = df.withColumn("_r", F.sum(F.col(specific).isNull().cast("int")).over(order))
    w = Window.partitionBy(*keys, "_r", F.col(specific).isNull()).orderBy(range_km)
    area = (F.col(specific) + F.lag(specific).over(w)) / F.lit(2.0) * (F.col(range_km) - F.lag(range_km).over(w))
    return run.withColumn("_a", F.coalesce(area, F.lit(0.0))).withColumn("pia", F.when(F.col(specific).isNotNull(), F.lit(2.0) * F.sum("_a").over(w))).drop("_r", "_a")


def zphi(df: DataFrame, keys: list[str], range_km: str, dbz: str, delta_phi: str, alpha: float, beta: float) -> DataFrame:
    """Adds ``pia``: path attenuation by the closed Z-Phi form, from the whole
    phase shift of the segment (a column, constant in a segment).

    With S = 10^(beta (alpha dPhi)/10) - 1 and J(r) the integral of Z^beta:
    pia(r) = (10/beta) log10((1 + S) / (1 + S - S J(r)/J_end)), at J_end equal
    to alpha dPhi."""
    w = Window.partitionBy(*keys).orderBy(range_km)
    whole = Window.partitionBy(*keys)
    z = F.pow(F.lit(10.0), F.col(dbz) * F.lit(beta / 10.0))
    df = df.withColumn("_z", z)
    area = (F.col("_z") + F.lag("_z").over(w)) / F.lit(2.0) * (F.col(range_km) - F.lag(range_km).over(w))
    df = df.withColumn("_a", F.coalesce(area, F.lit(0.0))).withColumn("_j", F.sum("_a").over(w)).withColumn("_e", F.sum("_a").over(whole))
    s = F.pow(F.lit(10.0), F.lit(beta * alpha / 10.0) * F.col(delta_phi)) - F.lit(1.0)
    part = F.when(F.col("_e") > 0, F.col("_j") / F.col("_e")).otherwise(F.lit(0.0))
    return df.withColumn("pia", F.lit(10.0 / beta) * F.log10((F.lit(1.0) + s) / (F.lit(1.0) + s - s * part))).drop("_z", "_a", "_j", "_e")


def unwrapped(df: DataFrame, keys: list[str], order: str, phase: str, period: float = 360.0) -> DataFrame:
    """Adds ``unwrapped``: jumps of over half a period are undone, in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    jump = F.col(phase) - F.lag(phase).over(w)
    turns = F.when(jump > period / 2, -F.ceil(jump / F.lit(period) - F.lit(0.5))).when(jump < -period / 2, F.ceil(-jump / F.lit(period) - F.lit(0.5))).otherwise(F.lit(0))
    return df.withColumn("_t", F.coalesce(turns, F.lit(0))).withColumn("unwrapped", F.col(phase) + F.sum("_t").over(w) * F.lit(period)).drop("_t")


def moving(df: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """Adds mean, deviation and share of available values over a window."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumns({"mean": F.avg(value).over(w), "deviation": F.stddev_pop(value).over(w), "available": F.count(value).over(w) / F.lit(2.0 * half + 1.0)})


def slope(df: DataFrame, keys: list[str], x: str, y: str, half: int) -> DataFrame:
    """Adds ``slope``: least squares of y on x over a window of rows."""
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(-half, half)
    return df.withColumn("slope", F.regr_slope(y, x).over(w))


def interpolated(df: DataFrame, keys: list[str], time_s: str, value: str) -> DataFrame:
    """Adds ``filled``: missing values linear in time between the values around
    them; none before the first or after the last."""
    w = Window.partitionBy(*keys).orderBy(time_s)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time_s).cast("double").alias("t"), F.col(value).alias("v")))
    df = df.withColumn("_k", known)
    a = F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumns({"_a": a, "_b": b})
    between = F.col("_a.v") + F.try_divide((F.col("_b.v") - F.col("_a.v")) * (F.col(time_s) - F.col("_a.t")), F.col("_b.t") - F.col("_a.t"))
    return df.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), between)).drop("_k", "_a", "_b")


def fixed_windows(df: DataFrame, keys: list[str], time_s: str, step_s: int, length: int) -> DataFrame:
    """Starts of runs of ``length`` frames without a gap, with an id each."""
    w = Window.partitionBy(*keys).orderBy(time_s)
    end = F.lead(time_s, length - 1).over(w)
    full = df.select(*keys, time_s).distinct().withColumn("_e", end).filter(F.col("_e") - F.col(time_s) == step_s * (length - 1))
    return full.select(*keys, F.col(time_s).alias("start_s"), F.col("_e").alias("end_s"), F.sha2(F.concat_ws("|", *keys, F.col(time_s), F.col("_e")), 256).alias("window_id"))


def complete_blocks(df: DataFrame, keys: list[str], hour: str, value: str, before: int, after: int) -> DataFrame:
    """Mean and maximum over hours -before to +after, where none is missing."""
    w = Window.partitionBy(*keys).orderBy(hour).rangeBetween(-before, after)
    n = F.count(value).over(w)
    return df.withColumns({"block_mean": F.avg(value).over(w), "block_max": F.max(value).over(w), "_n": n}).filter(F.col("_n") == before + after + 1).drop("_n")


def neighbours(df: DataFrame, keys: list[str], ray: str, value: str, rays: Column) -> DataFrame:
    """Adds left and right: the value at the rays beside, around the circle.

    ``rays`` is the number of rays; each row is sent to two neighbours by an
    equality join, and the circle closes by modulus."""
    right = df.select(*keys, F.pmod(F.col(ray) - 1, rays).alias(ray), F.col(value).alias("right"))
    left = df.select(*keys, F.pmod(F.col(ray) + 1, rays).alias(ray), F.col(value).alias("left"))
    return df.join(left, [*keys, ray], "left").join(right, [*keys, ray], "left")
