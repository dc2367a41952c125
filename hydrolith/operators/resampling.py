"""Bootstrap intervals by exact draws of n of n, without lists of all cases.

Cases fall into leaves of a binary tree by the bits of their hash. How many of a
draw's n cases come from a leaf follows from the tree: at each node the count splits
binomially by the numbers of cases below, with a generator seeded by the node, so
a leaf needs the sizes along its own path alone. Within a leaf the count splits
over the numbers of issues that cases have, and copies of cases draw their issues.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.basic import ratio
from hydrolith.operators.ranks import values_at
from hydrolith.sources.shared import stored

#: Cases of a leaf, about, and the most levels of the tree.
LEAF_CASES, MOST_LEVELS = 1000, 24
#: Issues up to which all means of a case's drawn issues are a table.
TABLE_ISSUES = 4
#: Copies of cases, or drawn issues, that a task holds at once.
DRAWN = 1_000_000


def split_path(sizes: list[tuple[int, int]], leaf: int, seed: int, draws: int) -> np.ndarray:
    """How many cases of each draw come from a leaf: ``sizes`` are the cases below
    each node on its path from the root, and below that node's left child."""
    count = np.full(draws, sizes[0][0] if sizes else 0, np.int64)
    depth = len(sizes)
    for level, (whole, left) in enumerate(sizes):
        node = leaf >> (depth - level)
        down = np.random.default_rng([seed % (1 << 64), level, node]).binomial(count, left / whole)
        count = down if not leaf >> (depth - level - 1) & 1 else count - down
    return count


def drawn_sums(values: list[np.ndarray], counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sum, for each draw, of the means of redrawn issues over its copies of
    cases: ``counts`` copies of the cases, whose issues are ``values``."""
    total = np.zeros(len(counts))
    sizes = np.array([len(v) for v in values])
    kinds, n = np.unique(sizes, return_counts=True)
    shares = rng.multinomial(counts, n / n.sum())
    for k, size in enumerate(kinds.tolist()):
        v = np.stack([x for x in values if len(x) == size])
        if size <= TABLE_ISSUES:
            v = v[:, np.indices((size,) * size).reshape(size, -1)].mean(1)  # all draws of its issues, each as likely
            size = 1
        flat, width = v.ravel(), v.shape[1]
        upto = np.cumsum(shares[:, k])
        begin = 0
        while begin < len(counts):  # draws that are held at once
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + max(1, DRAWN // size), side="right")))
            own = shares[begin:end, k]
            m = int(own.sum())
            if width == 1 or size == 1:
                means = flat[rng.integers(0, len(flat), m, dtype=np.int32 if len(flat) < 2**31 else np.int64)]
            else:
                means = np.concatenate([v[c, rng.integers(0, width, width)] for c in rng.integers(0, len(v), m)]).reshape(m, width).mean(1) if m * width > DRAWN else v[rng.integers(0, len(v), m)[:, None], rng.integers(0, width, (m, width))].mean(1)
            some = np.flatnonzero(own)
            if len(some):
                total[begin + some] += np.add.reduceat(means, (np.cumsum(own) - own)[some])
            begin = end
    return total


def block_bootstrap(values: DataFrame, keys: list[str], case: str, issue: str, draws: int = 2000, seed: int = 7, leaf_cases: int = LEAF_CASES) -> DataFrame:
    """mean (of case means of issue means), cases, and low and high: the 2.5 and 97.5
    percentiles of the mean when as many cases as there are are drawn with putting
    back, and for each drawn case as many of its issues as it has.

    Rows without a value are left out, rows of one issue are averaged; null keys,
    cases and issues are values like others. A key with one case has an interval by
    its issues alone. An empty table gives no rows. Results do not depend on how
    rows are dealt. The number of cases of the largest key (one job) sets the depth
    of the tree; a leaf's cases are one group of about ``leaf_cases``."""
    per_issue = values.filter(F.col("value").isNotNull()).groupBy(*keys, case, issue).agg(F.avg("value").alias("v"))
    of_case = F.transform(F.array_sort(F.collect_list(F.struct(F.col(issue).alias("i"), "v"))), lambda x: x["v"])
    key = F.xxhash64(F.lit(seed), *keys) if keys else F.lit(seed).cast("long")
    per_case = per_issue.groupBy(*keys, case).agg(of_case.alias("vs"), F.avg("v").alias("v"))
    per_case = stored(per_case.select(*keys, key.alias("_k"), F.xxhash64(F.lit(seed), case).alias("_h"), "vs", "v"))  # read for sizes, paths and draws
    of_key = per_case.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("*").alias("cases"))
    most = of_key.agg(F.max("cases")).first()[0] or 0
    depth = min(MOST_LEVELS, max(0, (-(-most // leaf_cases) - 1).bit_length()))

    hashed = per_case.withColumn("_leaf", F.pmod("_h", F.lit(1 << depth)))
    leaves = hashed.groupBy("_k", "_leaf").agg(F.count("*").alias("n"))
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    nodes = levels.groupBy("_k", "level", F.expr(f"shiftright(_leaf, {depth} - level)").alias("node")).agg(F.sum("n").alias("n"))
    below = nodes.filter("level > 0 AND node % 2 = 0").select("_k", (F.col("level") - 1).alias("level"), F.shiftright("node", 1).alias("node"), F.col("n").alias("left"))
    split = nodes.filter(F.col("level") < depth).join(below, ["_k", "level", "node"], "left").na.fill(0, ["left"])
    steps = levels.filter(F.col("level") < depth).withColumn("node", F.expr(f"shiftright(_leaf, {depth} - level)")).select("_k", "_leaf", "level", "node").join(split, ["_k", "level", "node"])
    paths = steps.groupBy("_k", "_leaf").agg(F.array_sort(F.collect_list(F.struct("level", "n", "left"))).alias("path"))
    if not depth:
        paths = leaves.select("_k", "_leaf", F.array(F.struct(F.lit(0).alias("level"), "n", F.lit(0).cast("long").alias("left"))).alias("path"))

    def drawn(cases: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        cases = cases.sort_values("_h")
        k, leaf = int(cases["_k"].iloc[0]), int(cases["_leaf"].iloc[0])
        sizes = [(int(x["n"]), int(x["left"])) for x in path["path"].iloc[0]]
        counts = split_path(sizes if depth else [], leaf, k, draws) if depth else np.full(draws, len(cases), np.int64)
        sums = drawn_sums([np.asarray(v, float) for v in cases["vs"]], counts, np.random.default_rng([k % (1 << 64), depth, leaf]))
        return pd.DataFrame({"_k": [k], "sums": [sums]})

    paths = paths.select(F.col("_k").alias("_p"), F.col("_leaf").alias("_l"), "path")
    sums = hashed.select("_k", "_leaf", "_h", "vs").groupBy("_k", "_leaf").cogroup(paths.groupBy("_p", "_l")).applyInPandas(drawn, "_k long, sums array<double>")
    of_draw = sums.select("_k", F.posexplode("sums").alias("draw", "s")).groupBy("_k", "draw").agg(F.sum("s").alias("s"))
    out = of_key.withColumn("_k", key)
    means = of_draw.join(out.select("_k", "cases"), "_k").select("_k", (F.col("s") / F.col("cases")).alias("m"))
    ends = means.groupBy("_k").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return out.join(ends, "_k").select(*keys, "mean", "cases", "low", "high")


def median_ranks(n: pd.Series, key: pd.Series, draws: int) -> pd.Series:
    """Ranks of the two middle values (one, twice, where n is odd) of each draw of
    n of n: order statistics of n even numbers, as ranks of the sample."""
    out = []
    for m, k in zip(n.tolist(), key.tolist(), strict=True):
        if not m:
            out.append(np.zeros(0, np.int64))
            continue
        rng = np.random.default_rng([k % (1 << 64), m])
        low = rng.beta((m + 1) // 2, m + 1 - (m + 1) // 2, draws)
        high = low if m % 2 else low + (1 - low) * rng.beta(1, m - m // 2, draws)
        out.append(np.stack([np.minimum(m, np.floor(u * m).astype(np.int64) + 1) for u in (low, high)], axis=1).ravel())
    return pd.Series(out, dtype=object)


def median_bootstrap(values: DataFrame, keys: list[str], value: str, draws: int = 2000, seed: int = 7, **sizes: int) -> DataFrame:
    """n, median, low and high of each key: the 2.5 and 97.5 percentiles of the median
    of n of its n values drawn with putting back.

    The middle values of a draw are values of the sample at ranks whose law is that
    of order statistics, so a draw is two ranks and no sample is drawn. Null values
    are left out; a key without others has nulls, with one value it is all three. An
    empty table gives no rows."""

    @F.pandas_udf("array<bigint>")
    def ranks(n: pd.Series, key: pd.Series) -> pd.Series:
        return median_ranks(n, key, draws)

    values = stored(values.select(*keys, value))  # read for counts, borders and ranks
    own = F.xxhash64(F.lit(seed), *keys) if keys else F.lit(seed).cast("long")
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    numbered = values.groupBy(*keys).agg(F.count(value).alias("n")).withColumn("_r", F.concat(middle, ranks("n", own)))
    found = values_at(values, keys, value, F.col("_r"), numbered=numbered, **sizes)
    both = F.transform(F.sequence(F.lit(0), F.lit(draws)), lambda k: (F.get("_v", 2 * k) + F.get("_v", 2 * k + 1)) / 2)
    at = found.select(*keys, "n", F.transform("_at", lambda x: x["v"]).alias("_v")).withColumn("_m", F.when(F.size("_v") > 0, both))
    drawn = F.array_sort(F.slice("_m", 2, draws))

    def quantile(q: float) -> Column:
        place = q * (draws - 1)
        lo = int(place)
        return F.get("_d", lo) + (F.get("_d", min(lo + 1, draws - 1)) - F.get("_d", lo)) * (place - lo)

    return at.withColumn("_d", drawn).select(*keys, "n", F.get("_m", 0).alias("median"), quantile(0.025).alias("low"), quantile(0.975).alias("high"))


def paired_skill(records: DataFrame, keys: list[str], candidate: str, least_positive: int, least_coverage: float | None = None, draws: int = 2000) -> DataFrame:
    """For each of ``keys`` and baseline (every other model): how the candidate does
    against it over cases, with the gates that a comparison has to pass.

    ``records`` have case, issue, lead, model, score and coverage. A case's difference
    is the mean over its issues that both models have of the difference of the issue's
    mean scores. cases: all with a record; evaluable: with a difference; positive: of
    these, over 0. A coverage is expected for each (case, issue, lead) of the
    candidate; coverage_passes if none is missing or under ``least_coverage`` (always,
    where that is None). passes: enough positive cases, and coverage. Scores that
    are null or NaN do not count; without an evaluable case, difference and
    interval are null."""
    if not keys:
        return paired_skill(records.withColumn("_all", F.lit(0)), ["_all"], candidate, least_positive, least_coverage, draws).drop("_all")
    score = F.when(~F.isnan("score"), F.col("score"))
    r = records.withColumn("score", score)
    cases = r.groupBy(*keys).agg(F.count_distinct("case").alias("cases"))
    means = r.filter("score IS NOT NULL").groupBy(*keys, "case", "issue", "model").agg(F.avg("score").alias("v"))
    own = means.filter(F.col("model") == candidate).drop("model").withColumnRenamed("v", "_own")
    pairs = means.filter(F.col("model") != candidate).withColumnRenamed("model", "baseline").join(own, [*keys, "case", "issue"])
    pairs = pairs.select(*keys, "baseline", "case", "issue", (F.col("_own") - F.col("v")).alias("value"))
    of_case = pairs.groupBy(*keys, "baseline", "case").agg(F.avg("value").alias("_d"))
    counts = of_case.groupBy(*keys, "baseline").agg(F.count("*").alias("evaluable"), F.count_if(F.col("_d") > 0).alias("positive"))
    at = r.filter(F.col("model") == candidate).groupBy(*keys, "case", "issue", "lead").agg(F.max(F.when(~F.isnan("coverage"), F.col("coverage"))).alias("_c"))
    cover = at.groupBy(*keys).agg(F.count("*").alias("_n"), F.count("_c").alias("_there"), F.min("_c").alias("least_coverage"))
    ends = block_bootstrap(pairs, [*keys, "baseline"], "case", "issue", draws).withColumnsRenamed({"mean": "difference"}).drop("cases")
    every = r.filter(F.col("model") != candidate).select(*keys, F.col("model").alias("baseline")).distinct()
    out = every.join(cases, keys, "left").join(cover, keys, "left").join(counts, [*keys, "baseline"], "left").join(ends, [*keys, "baseline"], "left").na.fill(0, ["evaluable", "positive"])
    covered = F.lit(True) if least_coverage is None else F.coalesce((F.col("_n") == F.col("_there")) & (F.col("least_coverage") >= least_coverage), F.lit(False))
    out = out.withColumn("coverage_passes", covered).withColumn("passes", covered & (F.col("positive") >= least_positive))
    return out.select(*keys, "baseline", "cases", "evaluable", "positive", "least_coverage", "coverage_passes", "passes", "difference", "low", "high")


def skill_status(comparisons: DataFrame, least_cases: int, weak: str = "persistence", translation: str = "translation") -> DataFrame:
    """One row: what the comparisons say together. insufficient_evidence with too few
    cases or a comparison that does not reach all; lk_supported if all pass, against
    the weak baseline and at least one other; translation_baseline_retained if those
    against the weak one pass and the translation's do not; else
    skill_not_demonstrated. No comparisons: insufficient_evidence."""
    is_weak, is_moved = F.col("baseline") == weak, F.col("baseline") == translation
    a = comparisons.agg(
        F.coalesce(F.min("cases"), F.lit(0)).alias("cases"), F.coalesce(F.bool_or(F.col("evaluable") < F.col("cases")), F.lit(True)).alias("short"),
        F.coalesce(F.bool_and(F.when(is_weak, F.col("passes"))), F.lit(True)).alias("weak_passes"), F.coalesce(F.bool_and(F.when(~is_weak, F.col("passes"))), F.lit(False)).alias("strong_passes"),
        F.coalesce(F.bool_and(F.when(is_moved, F.col("passes"))), F.lit(True)).alias("moved_passes"), F.count("*").alias("comparisons"),
    )
    status = F.when((F.col("cases") < least_cases) | F.col("short"), "insufficient_evidence").when(F.col("weak_passes") & F.col("strong_passes"), "lk_supported").when(F.col("weak_passes") & ~F.col("moved_passes"), "translation_baseline_retained").otherwise("skill_not_demonstrated")
    return a.select(status.alias("status"), "comparisons", "cases")
