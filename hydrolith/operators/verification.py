"""Forecast verification: contingency, errors, neighbourhoods, probabilities.

Scores are sums over cells, so each task sends one row for each group. A
neighbourhood needs sums over windows of a grid: rows are widened along one
axis at a time by an explode and an aggregation, which needs no complete grid
and no window over a whole row of cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.basic import ratio
from hydrolith.sources.shared import stored


def contingency(pairs: DataFrame, keys: list[str], thresholds: list[float], domain: str = "common") -> DataFrame:
    """Scores of rows with observed and forecast, for each threshold (events
    are at least it). Domain "common" takes cells where both are there, "truth"
    all with an observation, a missing forecast being no event there."""
    o, f = F.col("observed"), F.col("forecast")
    rows = pairs.filter(o.isNotNull() & f.isNotNull()) if domain == "common" else pairs.filter(o.isNotNull())
    rows = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    oe, fe = o >= F.col("threshold"), F.coalesce(f >= F.col("threshold"), F.lit(False))
    g = rows.groupBy(*keys, "threshold").agg(
        F.count_if(oe & fe).alias("hits"), F.count_if(oe & ~fe).alias("misses"), F.count_if(~oe & fe).alias("false_alarms"), F.count_if(~oe & ~fe).alias("correct_negatives"),
        F.avg(F.abs(f - o)).alias("mae"), F.sqrt(F.avg((f - o) * (f - o))).alias("rmse"), F.avg(f - o).alias("bias"), (F.count(f) / F.count("*")).alias("coverage"),
    )
    h, m, a = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return g.withColumns({"csi": ratio(h, h + m + a), "pod": ratio(h, h + m), "far": ratio(a, h + a)})


def window_sums(cells: DataFrame, keys: list[str], values: list[str], half_y: int, half_x: int) -> DataFrame:
    """Sums of values over (2 half + 1)-windows around each cell that is there;
    cells off the grid count 0. One axis at a time."""
    wide = cells.select(*keys, "y", "x", *values)
    for axis, half in (("x", half_x), ("y", half_y)):
        shifted = wide.withColumn("_d", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(axis, F.col(axis) + F.col("_d"))
        wide = shifted.groupBy(*keys, "y", "x").agg(*[F.sum(v).alias(v) for v in values])
    return cells.select(*keys, "y", "x").join(wide, [*keys, "y", "x"])


def fractions_skill(pairs: DataFrame, keys: list[str], threshold: float, window: int, full_support: bool = False) -> DataFrame:
    """FSS over cells that have both values.

    Shares are of the evaluated cells in the window; with ``full_support`` only
    windows whose every cell is evaluated count, events are strictly above the
    threshold and the score is kept in [0, 1]."""
    half = window // 2
    both = pairs.filter(F.col("observed").isNotNull() & F.col("forecast").isNotNull())
    event = lambda c: ((F.col(c) > threshold) if full_support else (F.col(c) >= threshold)).cast("double")
    cells = both.select(*keys, "y", "x", F.lit(1.0).alias("n"), event("observed").alias("o"), event("forecast").alias("f"))
    w = window_sums(cells, keys, ["n", "o", "f"], half, half)
    if full_support:
        w = w.filter(F.col("n") == window * window)
    po, pf = F.col("o") / F.col("n"), F.col("f") / F.col("n")
    s = w.groupBy(*keys).agg(F.sum((pf - po) * (pf - po)).alias("_d"), F.sum(pf * pf + po * po).alias("_s"), F.count("*").alias("cells"))
    score = F.lit(1.0) - F.col("_d") / F.col("_s")
    return s.select(*keys, "cells", F.when(F.col("_s") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if full_support else score).alias("fss"))


def odd_window(scale_km: float, spacing_km: float) -> int:
    """The odd number of cells nearest to a scale; of equal ones the smaller."""
    cells = scale_km / spacing_km
    low = max(1, 2 * int((cells - 1) // 2) + 1)
    return low if cells - low <= low + 2 - cells else low + 2


def integral_image(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``integral``: the sum of values at or before a cell in both axes.
    Rows first, then columns: a grid's row or column is a window, never a grid."""
    rows = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_r", F.sum(value).over(rows)).withColumn("integral", F.sum("_r").over(cols)).drop("_r")


def probability_scores(cells: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """Brier score for each threshold (strictly above), over cells with an
    observation and an array of members without nulls."""
    rows = cells.filter(F.col("observed").isNotNull() & (F.size("members") > 0)).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    p = F.size(F.filter("members", lambda m: m > F.col("threshold"))) / F.size("members")
    o = (F.col("observed") > F.col("threshold")).cast("double")
    return rows.groupBy(*keys, "threshold").agg(F.avg((p - o) * (p - o)).alias("brier"), F.count("*").alias("cells"))


def crps(observed: Column, members: Column) -> Column:
    """Mean |x - y| less half the mean difference of members, which is
    sum((2i - n - 1) x_(i)) / n^2 over members in order."""
    n = F.size(members).cast("double")
    error = F.aggregate(members, F.lit(0.0), lambda a, x: a + F.abs(x - observed)) / n
    ordered = F.transform(F.array_sort(members), lambda x, i: x * (F.lit(2.0) * (i + 1) - n - F.lit(1.0)))
    return error - F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x) / (n * n)


def ensemble_scores(cells: DataFrame, keys: list[str]) -> DataFrame:
    """CRPS, error of the members' mean, and spread."""
    n = F.size("members").cast("double")
    mean = F.aggregate("members", F.lit(0.0), lambda a, x: a + x) / n
    c = cells.filter(F.col("observed").isNotNull() & (F.size("members") > 0)).withColumns({"_m": mean, "_c": crps(F.col("observed"), F.col("members"))})
    spread = F.sqrt(F.aggregate("members", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m"))) / n)
    return c.groupBy(*keys).agg(F.avg("_c").alias("crps"), F.sqrt(F.avg((F.col("_m") - F.col("observed")) * (F.col("_m") - F.col("observed")))).alias("mean_rmse"), F.avg(spread).alias("spread"), F.count("*").alias("cells"))


def reliability(samples: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Equal bins of probability, the last one closed: count, mean probability
    and observed frequency of rows with p and event (0 or 1)."""
    b = F.least(F.floor(F.col("p") * F.lit(bins)), F.lit(bins - 1)).cast("int")
    return samples.filter(F.col("p").isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("event").cast("double")).alias("frequency"))


def matched_means(records: DataFrame, record: list[str], by: list[str], algorithms: int) -> DataFrame:
    """Means for each algorithm over records for which every algorithm has a
    value, over all and for each value of ``by`` (null: all)."""
    full = records.filter(F.col("value").isNotNull()).groupBy(*record).agg(F.countDistinct("algorithm").alias("_n")).filter(F.col("_n") == algorithms).drop("_n")
    m = records.join(full, record, "left_semi")
    return m.groupingSets([["algorithm"], ["algorithm", *by]], "algorithm", *by).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def paired_difference(records: DataFrame, record: list[str], candidate: str, reference: str) -> DataFrame:
    """Candidate less reference for records that have both."""
    one = lambda name: F.max(F.when(F.col("algorithm") == name, F.col("value")))
    p = records.groupBy(*record).agg(one(candidate).alias("candidate"), one(reference).alias("reference"))
    return p.filter(F.col("candidate").isNotNull() & F.col("reference").isNotNull()).withColumn("difference", F.col("candidate") - F.col("reference"))


def pool(events: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators: the nondecreasing fit of event rates."""
    sums: list[float] = []
    masses: list[float] = []
    counts: list[int] = []
    for e, w in zip(events.tolist(), weights.tolist(), strict=True):
        sums.append(e)
        masses.append(w)
        counts.append(1)
        while len(sums) > 1 and sums[-2] * masses[-1] >= sums[-1] * masses[-2]:
            e, w, c = sums.pop(), masses.pop(), counts.pop()
            sums[-1] += e
            masses[-1] += w
            counts[-1] += c
    return np.repeat(np.array(sums) / np.array(masses), counts)


def _pooled(d: pd.DataFrame) -> pd.DataFrame:
    """Adds to rows in order (e, w) the number of their pool, from 0."""
    y = pool(d["e"].to_numpy(), d["w"].to_numpy())
    return d.assign(pool=np.r_[0, np.cumsum(np.diff(y) > 0)].astype(np.int64) if len(d) else np.zeros(0, np.int64))


def isotonic(samples: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    """Calibration curve of each key: x, y (nondecreasing) and w (samples at x).

    Samples are summed at each different probability, which fall into slices by
    ranges of it, and each slice is pooled by itself. Pools merge: what is one pool
    within a slice is one within any range around it, so the pools of all slices are
    pooled again, as rows of their own. Means of neighbouring pools rise and have
    whole numbers of events and samples, so n samples have about n ** (2/3) pools at
    most, and only these meet in one group of a key. Rows without a probability are
    left out; an event that is null is none; null keys are a key; an empty table
    gives no rows."""
    sums = samples.filter(F.col("p").isNotNull()).groupBy(*keys, F.col("p").cast("double").alias("x")).agg(F.coalesce(F.sum(F.col("event").cast("double")), F.lit(0.0)).alias("e"), F.count("*").cast("double").alias("w"))
    types = dict(sums.dtypes)
    of_keys = "".join(f"`{k}` {types[k]}, " for k in keys)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:  # a batch is a range of a slice, and pools merge all the same
            part = uuid.uuid4().hex
            for n, (_, own) in enumerate(d.groupby(keys, dropna=False, sort=False) if keys else [((), d)]):
                own = _pooled(own.sort_values("x"))
                yield own.assign(pool=own["pool"].map(lambda k, n=n: f"{part}-{n}-{k}"))

    ranged = (sums.repartitionByRange(slices, *keys, "x") if slices else sums.repartitionByRange(*keys, "x")).sortWithinPartitions(*keys, "x")
    rows = stored(ranged.mapInPandas(local, f"{of_keys}x double, e double, w double, pool string"))

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("x")
        return d.assign(y=pool(d["e"].to_numpy(), d["w"].to_numpy()))[["pool", "y"]]

    pools = rows.groupBy(*keys, "pool").agg(F.min("x").alias("x"), F.sum("e").alias("e"), F.sum("w").alias("w"))
    fitted = pools.groupBy(*keys).applyInPandas(fit, "pool string, y double")
    return rows.join(fitted, "pool").select(*keys, "x", "y", "w")


def coherent(calibrated: list[Column]) -> list[Column]:
    """Probabilities of rising thresholds, each at most the one before."""
    out = calibrated[:1]
    for c in calibrated[1:]:
        out.append(F.when(c.isNotNull(), F.least(c, out[-1])))
    return out


def coverage_summary(slices: DataFrame, slice_keys: list[str], model: str, least: float) -> DataFrame:
    """Figures of coverage over different slices of each model."""
    s = slices.dropDuplicates([*slice_keys, model])
    return s.groupBy(model).agg(F.count("*").alias("slices"), F.min("coverage").alias("minimum"), F.avg("coverage").alias("mean"), F.count_if(F.col("coverage") < least).alias("below"))


def confusion(rows: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts, precision, recall and F1; null where a denominator is 0."""
    g = rows.groupBy(*keys).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count_if(~truth & ~predicted).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(tp * 2, tp * 2 + fp + fn)})


def gauge_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Bias ratio, correlation and errors of estimates against gauges."""
    e, g = F.col("estimate"), F.col("gauge")
    p = pairs.filter(e.isNotNull() & g.isNotNull())
    return p.groupBy(*keys).agg(F.count("*").alias("n"), ratio(F.sum(e), F.sum(g)).alias("bias_ratio"), F.corr(e, g).alias("correlation"), F.avg(F.abs(e - g)).alias("mae"), F.sqrt(F.avg((e - g) * (e - g))).alias("rmse"))


def radial_spectrum(fields: DataFrame, keys: list[str], bands: int = 16) -> DataFrame:
    """Power of a grid's two-dimensional spectrum in log-spaced annuli, after a
    Hann taper. ``fields`` has y, x, value and one small dense grid for a key."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        h, w = int(d["y"].max()) + 1, int(d["x"].max()) + 1
        a = np.zeros((h, w))
        a[d["y"], d["x"]] = d["value"].fillna(0.0)
        power = np.abs(np.fft.rfft2((a - a.mean()) * np.hanning(h)[:, None] * np.hanning(w))) ** 2
        k = np.hypot(np.fft.fftfreq(h)[:, None], np.fft.rfftfreq(w))
        edges = np.geomspace(1.0 / max(h, w), 0.5, bands + 1)
        at = np.searchsorted(edges, k, side="right") - 1
        out = [(b, float(edges[b]), float(edges[b + 1]), float(power[at == b].mean()) if (at == b).any() else None) for b in range(bands)]
        f = pd.DataFrame(out, columns=["band", "low", "high", "power"])
        for c in reversed(keys):
            f.insert(0, c, d[c].iloc[0])
        return f

    types = dict(fields.dtypes)
    return fields.groupBy(*keys).applyInPandas(run, ", ".join([*[f"`{k}` {types[k]}" for k in keys], "band int, low double, high double, power double"]))


