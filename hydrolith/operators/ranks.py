"""Exact ranks within keys of any size.

Where every key has few rows, its values are one sorted array. Else a key's
different values are counted first, so that repeats are one row, and fall into
slices of about ``SLICE_ROWS`` rows, however many that makes. Counts by slice tell
which slice holds a rank, and only that slice is put in order, with the ranks among
its values as rows of their own: no task holds a key, no row all ranks. A sketch gives the slices' borders and decides about balance alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key up to which its values are one array.
FEW_ROWS = 100_000
#: Rows of a slice, and the most slices of a key (borders are a sketch's).
SLICE_ROWS, MOST_SLICES = 200_000, 4096


def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; ``b``'s keys go."""
    other = b.withColumnsRenamed({k: f"_j_{k}" for k in on})
    same = reduce(lambda x, y: x & y, [a[k].eqNullSafe(other[f"_j_{k}"]) for k in on], F.lit(True))
    return a.join(other, same).drop(*[f"_j_{k}" for k in on])


def _sliced(df: DataFrame, keys: list[str], value: str, wanted: DataFrame, slices: int) -> DataFrame:
    """keys, i and value at each of ``wanted`` (keys, _w of i and rank r)."""
    v = F.col(value)
    inner = [F.lit(i / slices) for i in range(1, slices)]
    borders = df.groupBy(*keys).agg(F.percentile_approx(v, F.array(*inner), 50 * slices).alias("_b"))
    counts = df.filter(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    sliced = met(counts, borders, keys).select(*keys, value, "_c", F.size(F.filter("_b", lambda b: b < F.col(value))).alias("_s"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_s"))
    ends = sliced.groupBy(*keys, "_s").agg(F.sum("_c").alias("_c")).withColumn("_end", upto).withColumn("_before", F.col("_end") - F.col("_c")).drop("_c")
    held = met(wanted, ends, keys).filter((F.col("_w.r") > F.col("_before")) & (F.col("_w.r") <= F.col("_end")))
    asked = held.groupBy(*keys, "_s").agg(F.first("_before").alias("_before"))
    inside = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_s").orderBy(value))
    there = met(sliced, asked, [*keys, "_s"]).select(*keys, "_s", value, (inside - F.col("_c") + 1).alias("_r"), F.lit(None).cast("int").alias("i"))
    both = there.unionByName(held.select(*keys, "_s", F.lit(None).cast(dict(df.dtypes)[value]).alias(value), F.col("_w.r").alias("_r"), F.col("_w.i").alias("i")))
    upto = Window.partitionBy(*keys, "_s").orderBy("_r", F.col("i").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)  # a value begins at its first rank
    return both.withColumn(value, F.last(value, ignorenulls=True).over(upto)).filter("i IS NOT NULL").select(*keys, value, "i")


def values_at(df: DataFrame, keys: list[str], value: str, ranks: Column, few: int = FEW_ROWS, slice_rows: int = SLICE_ROWS, numbered: DataFrame | None = None) -> DataFrame:
    """keys, n and _at (structs of i, from 0, and the value) for the array of
    ``ranks`` (1-based, from the columns of ``numbered``: the keys, n and others):
    one row for each key, ranks outside 1 to n left out. Two jobs: the first counts
    the rows of the largest key."""
    v = F.col(value)
    counted = df.groupBy(*keys).agg(F.count(v).alias("n"))
    of_key = counted if numbered is None else numbered
    most = counted.agg(F.max("n")).first()[0] or 0
    each = F.transform(ranks, lambda r, i: F.struct(i.alias("i"), r.cast("long").alias("r")))
    inside = F.filter(each, lambda w: (w["r"] >= 1) & (w["r"] <= F.col("n")))
    if most <= few:
        own = df.groupBy(*keys).agg(F.count(v).alias("n"), F.array_sort(F.collect_list(v)).alias("_v"))
        if numbered is not None:
            own = met(numbered, own.drop("n"), keys)
        return own.select(*keys, "n", F.transform(inside, lambda w: F.struct(w["i"].alias("i"), F.get("_v", (w["r"] - 1).cast("int")).alias("v"))).alias("_at"))
    wanted = of_key.select(*keys, F.explode(inside).alias("_w"))
    found = _sliced(df, keys, value, wanted, max(2, min(MOST_SLICES, -(-most // slice_rows))))
    rows = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", v.alias("v")))).alias("_at"))
    other = rows.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys], F.lit(True))
    return of_key.join(other, same, "left").select(*keys, "n", "_at")


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], few: int = FEW_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row for each key: its ``n`` values that are not null and, under the name
    of each of ``ranks`` (1-based, from ``n``), the value there; null where n is 0."""
    found = values_at(df, keys, value, F.array(*[r.cast("long") for r in ranks.values()]), few, slice_rows)
    one = lambda k: F.get(F.filter("_at", lambda x: x["i"] == k), 0)["v"]
    return found.select(*keys, "n", *[one(k).alias(name) for k, name in enumerate(ranks)])


def nearest_ranks(df: DataFrame, keys: list[str], value: str, q: dict[str, float], **sizes: int) -> DataFrame:
    """Values at rank ceil(n q) of each key, and ``n``."""
    return at_ranks(df, keys, value, {name: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(x))) for name, x in q.items()}, **sizes)


def interpolated(df: DataFrame, keys: list[str], value: str, q: dict[str, float], **sizes: int) -> DataFrame:
    """Quantiles between the two values around rank 1 + (n - 1) q, and ``n``."""
    at = {name: (F.col("n") - 1) * F.lit(x) for name, x in q.items()}
    ends = {f"_{side}_{name}": f(a) + 1 for name, a in at.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    lo, hi = (lambda name: F.col(f"_lo_{name}")), (lambda name: F.col(f"_hi_{name}"))
    between = [(lo(name) + (hi(name) - lo(name)) * (a - F.floor(a))).alias(name) for name, a in at.items()]
    return at_ranks(df, keys, value, ends, **sizes).select(*keys, "n", *between)
