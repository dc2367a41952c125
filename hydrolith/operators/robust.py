"""Robust local fits along rays, with built-in functions only.

A gate's window (a handful of gates) is an array; Tukey's biweight is a fold of
a few reweighted least-squares fits over it, so no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TUKEY = 4.685
ROUNDS = 5


def _fit(points: Column) -> Column:
    """struct(a, b): weighted line y = a + b x through struct(x, y, w)."""
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))
    w, x, y = total(lambda p: p["w"]), total(lambda p: p["w"] * p["x"]), total(lambda p: p["w"] * p["y"])
    xx, xy = total(lambda p: p["w"] * p["x"] * p["x"]), total(lambda p: p["w"] * p["x"] * p["y"])
    b = F.try_divide(w * xy - x * y, w * xx - x * x)
    return F.struct(F.try_divide(y - b * x, w).alias("a"), b.alias("b"))


def _median(values: Column) -> Column:
    v = F.array_sort(values)
    n = F.size(v)
    return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / F.lit(2.0)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def robust_slope(df: DataFrame, keys: list[str], x: str, y: str, half: int, least: int = 3) -> DataFrame:
    """Adds ``slope``: the biweight line's over a window of rows around each
    row; null where fewer than ``least`` values are there or the fit is flat in
    x. Outliers beyond ``TUKEY`` scaled median residuals do not count."""
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(-half, half)
    point = F.when(F.col(y).isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w")))
    d = df.withColumn("_p", F.collect_list(point).over(w)).withColumn("_n", F.size("_p"))

    def again(points: Column, _: Column) -> Column:
        def weighted(line: Column) -> Column:
            residual = lambda p: F.abs(p["y"] - line["a"] - line["b"] * p["x"])

            def by_scale(scale: Column) -> Column:
                u = lambda p: F.try_divide(residual(p), scale)
                one = lambda p: F.when(scale <= 1e-9, F.lit(1.0)).when(u(p) >= 1, F.lit(0.0)).otherwise(F.pow(F.lit(1.0) - u(p) * u(p), F.lit(2.0)))
                return F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.coalesce(one(p), F.lit(1.0)).alias("w")))

            return _let(F.lit(TUKEY * 1.4826) * _median(F.transform(points, residual)), by_scale)

        return F.when(_fit(points)["b"].isNull(), points).otherwise(_let(_fit(points), weighted))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.col("_p"), again)
    return d.withColumn("slope", F.when(F.col("_n") >= least, _let(fitted, _fit)["b"])).drop("_p", "_n")
