"""Verification, calibration and sampling over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import basic as bs
from hydrolith.operators import flow, kernels, resampling, verification as ver
from hydrolith.plans.registry import load, query
from hydrolith.plans.sequence_queries import GATES_SQL
from hydrolith.plans.views import SCANS_SQL, spread

#: A case with observation and forecast at a cell of a small grid.
_PAIR = """c, y, x, CASE WHEN (p + s) % 13 = 0 THEN NULL ELSE CAST(p % 30 AS DOUBLE) END AS observed, CASE WHEN (p * 3 + s) % 17 = 0 THEN NULL ELSE CAST((p + s % 9) % 30 AS DOUBLE) END AS forecast"""
PAIRS_SQL = f"SELECT {_PAIR} FROM (SELECT l_suppkey % 4 AS c, l_partkey % 32 AS y, l_orderkey % 32 AS x, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2, 3)"


def pairs(spark, sf_dir):
    from hydrolith.plans.views import split_columns

    g = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("c"), (F.col("l_partkey") % 32).alias("y"), (F.col("l_orderkey") % 32).alias("x")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return g.selectExpr(*split_columns(_PAIR))


def rounded(df, keys, digits=6):
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*keys, *[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns if c not in keys])


def _contingency_sql(where: str) -> str:
    return f"""WITH r AS (SELECT *, CAST(unnest([5.0, 20.0]) AS DOUBLE) AS threshold FROM ({PAIRS_SQL}) WHERE {where}), g AS (SELECT c, threshold, count(*) FILTER (WHERE observed >= threshold AND forecast >= threshold) AS hits, count(*) FILTER (WHERE observed >= threshold AND NOT coalesce(forecast >= threshold, false)) AS misses,
    count(*) FILTER (WHERE observed < threshold AND forecast >= threshold) AS false_alarms, count(*) FILTER (WHERE observed < threshold AND NOT coalesce(forecast >= threshold, false)) AS correct_negatives, round(avg(abs(forecast - observed)), 6) AS mae, round(sqrt(avg(pow(forecast - observed, 2))), 6) AS rmse,
    round(avg(forecast - observed), 6) AS bias, round(count(forecast) / count(*), 6) AS coverage FROM r GROUP BY 1, 2)
    SELECT *, round(hits / NULLIF(hits + misses + false_alarms, 0), 6) AS csi, round(hits / NULLIF(hits + misses, 0), 6) AS pod, round(false_alarms / NULLIF(hits + false_alarms, 0), 6) AS far FROM g"""


@query("contingency_scores", _contingency_sql("observed IS NOT NULL AND forecast IS NOT NULL"))
def contingency_scores(spark, sf_dir):
    return rounded(ver.contingency(pairs(spark, sf_dir), ["c"], [5.0, 20.0]), ["c", "threshold"])


@query("contingency_truth_domain", _contingency_sql("observed IS NOT NULL"))
def contingency_truth_domain(spark, sf_dir):
    return rounded(ver.contingency(pairs(spark, sf_dir), ["c"], [5.0, 20.0], "truth"), ["c", "threshold"])


def _fss_sql(event: str, having: str, score: str) -> str:
    return f"""WITH e AS (SELECT c, y, x, CASE WHEN observed {event} THEN 1.0 ELSE 0.0 END AS o, CASE WHEN forecast {event} THEN 1.0 ELSE 0.0 END AS f FROM ({PAIRS_SQL}) WHERE observed IS NOT NULL AND forecast IS NOT NULL),
    w AS (SELECT a.c, a.y, a.x, count(*) AS n, CAST(sum(b.o) AS DOUBLE) AS o, CAST(sum(b.f) AS DOUBLE) AS f FROM e a JOIN e b ON a.c = b.c AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3), k AS (SELECT * FROM w WHERE {having})
    SELECT c, count(*) AS cells, round({score}, 6) AS fss FROM k GROUP BY c"""


_FSS = "1 - sum(pow(f / n - o / n, 2)) / NULLIF(sum(pow(f / n, 2) + pow(o / n, 2)), 0)"


@query("fss_valid_support", _fss_sql(">= 15", "true", _FSS))
def fss_valid_support(spark, sf_dir):
    return rounded(ver.fractions_skill(pairs(spark, sf_dir), ["c"], 15.0, 5), ["c"])


@query("fss_full_support", _fss_sql("> 15", "n = 25", f"greatest(0, least(1, {_FSS}))"))
def fss_full_support(spark, sf_dir):
    return rounded(ver.fractions_skill(pairs(spark, sf_dir), ["c"], 15.0, 5, True), ["c"])


@query(
    "fss_integral_image",
    f"""WITH v AS (SELECT c, y, x, coalesce(observed, 0) AS v FROM ({PAIRS_SQL})), r AS (SELECT *, sum(v) OVER (PARTITION BY c, y ORDER BY x) AS r FROM v) SELECT c, y, x, sum(r) OVER (PARTITION BY c, x ORDER BY y) AS integral FROM r""",
)
def fss_integral_image(spark, sf_dir):
    v = pairs(spark, sf_dir).withColumn("v", F.coalesce("observed", F.lit(0.0)))
    return ver.integral_image(v, ["c"], "v").select("c", "y", "x", "integral")


#: Observation and members of an order: its lines' quantities.
MEMBERS_SQL = "SELECT o_orderkey AS k, o_custkey % 5 AS g, CAST(o_orderkey % 50 AS DOUBLE) AS observed, list(CAST(l_quantity AS DOUBLE) ORDER BY l_quantity) AS members FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"


def members(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("members"))
    o = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey % 5 AS g", "CAST(o_orderkey % 50 AS DOUBLE) AS observed")
    return o.join(m, F.col("k") == F.col("l_orderkey")).drop("l_orderkey")


@query(
    "brier_scores",
    f"""WITH r AS (SELECT *, CAST(unnest([10.0, 25.0, 40.0]) AS DOUBLE) AS threshold FROM ({MEMBERS_SQL})), p AS (SELECT g, threshold, observed, len(list_filter(members, lambda m: m > threshold)) / len(members) AS p FROM r)
    SELECT g, threshold, round(avg(pow(p - CASE WHEN observed > threshold THEN 1 ELSE 0 END, 2)), 6) AS brier, count(*) AS cells FROM p GROUP BY 1, 2""",
)
def brier_scores(spark, sf_dir):
    return rounded(ver.probability_scores(members(spark, sf_dir), ["g"], [10.0, 25.0, 40.0]), ["g", "threshold"])


@query(
    "crps_ensemble",
    f"""WITH u AS (SELECT k, g, observed, len(members) AS n, unnest(members) AS x, generate_subscripts(members, 1) AS i FROM ({MEMBERS_SQL})),
    s AS (SELECT k, g, observed, n, avg(abs(x - observed)) - sum((2 * i - n - 1) * x) / (n * n) AS crps, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY 1, 2, 3, 4) SELECT g, round(avg(crps), 5) AS crps, round(sqrt(avg(pow(m - observed, 2))), 5) AS mean_rmse, round(avg(sd), 5) AS spread, count(*) AS cells FROM s GROUP BY g""",
)
def crps_ensemble(spark, sf_dir):
    return rounded(ver.ensemble_scores(members(spark, sf_dir), ["g"]), ["g"], 5)


@query(
    "reliability_bins",
    f"""WITH p AS (SELECT g, len(list_filter(members, lambda m: m > 25)) / len(members) AS p, CASE WHEN observed > 25 THEN 1 ELSE 0 END AS event FROM ({MEMBERS_SQL}))
    SELECT g, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(event), 6) AS frequency FROM p GROUP BY 1, 2""",
)
def reliability_bins(spark, sf_dir):
    p = members(spark, sf_dir).select("g", (F.size(F.filter("members", lambda m: m > 25)) / F.size("members")).alias("p"), (F.col("observed") > 25).cast("int").alias("event"))
    return rounded(ver.reliability(p, ["g"], 10), ["g", "bin"])


RECORDS_SQL = "SELECT l_orderkey AS issue, CAST(l_suppkey % 3 AS INTEGER) AS lead, CASE l_linenumber % 3 WHEN 0 THEN 'lk' WHEN 1 THEN 'steps' ELSE 'persistence' END AS algorithm, avg(CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE l_quantity END) AS value FROM lineitem GROUP BY 1, 2, 3"


def records(spark, sf_dir):
    n = F.col("l_linenumber") % 3
    line = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("issue"), (F.col("l_suppkey") % 3).cast("int").alias("lead"), F.when(n == 0, "lk").when(n == 1, "steps").otherwise("persistence").alias("algorithm"), F.when(F.col("l_partkey") % 19 != 0, F.col("l_quantity")).alias("value")
    )
    return spread(line, "issue").groupBy("issue", "lead", "algorithm").agg(F.avg("value").alias("value"))


@query(
    "matched_macro_mean",
    f"""WITH r AS ({RECORDS_SQL}), f AS (SELECT issue, lead FROM r WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT algorithm) = 3) SELECT algorithm, r.lead, round(avg(value), 6) AS mean, count(*) AS n FROM r JOIN f ON r.issue = f.issue AND r.lead = f.lead GROUP BY GROUPING SETS ((algorithm), (algorithm, r.lead))""",
)
def matched_macro_mean(spark, sf_dir):
    return rounded(ver.matched_means(records(spark, sf_dir), ["issue", "lead"], ["lead"], 3), ["algorithm", "lead"])


@query(
    "paired_difference",
    f"""WITH p AS (SELECT issue, lead, max(CASE WHEN algorithm = 'steps' THEN value END) AS candidate, max(CASE WHEN algorithm = 'lk' THEN value END) AS reference FROM ({RECORDS_SQL}) GROUP BY 1, 2) SELECT issue, lead, round(candidate, 6) AS candidate, round(reference, 6) AS reference, round(candidate - reference, 6) AS difference FROM p WHERE candidate IS NOT NULL AND reference IS NOT NULL""",
)
def paired_difference(spark, sf_dir):
    return rounded(ver.paired_difference(records(spark, sf_dir), ["issue", "lead"], "steps", "lk"), ["issue", "lead"])


@query(
    "headline_score",
    f"SELECT round(avg(CASE WHEN algorithm = 'lk' THEN value END), 6) AS lk, round(avg(CASE WHEN algorithm = 'steps' THEN value END), 6) AS steps, round(avg(CASE WHEN algorithm = 'persistence' THEN value END), 6) AS persistence FROM ({RECORDS_SQL}) WHERE lead > 0",
)
def headline_score(spark, sf_dir):
    r = records(spark, sf_dir).filter("lead > 0")
    return r.agg(*[F.round(F.avg(F.when(F.col("algorithm") == a, F.col("value"))), 6).alias(a) for a in ("lk", "steps", "persistence")])


@query(
    "coverage_summary",
    f"""WITH s AS (SELECT algorithm, issue, lead, round(avg(value), 1) / 50 AS coverage FROM ({RECORDS_SQL}) WHERE value IS NOT NULL GROUP BY 1, 2, 3) SELECT algorithm, count(*) AS slices, round(min(coverage), 6) AS minimum, round(avg(coverage), 6) AS mean, count(*) FILTER (WHERE coverage < 0.45) AS below FROM s GROUP BY 1""",
)
def coverage_summary(spark, sf_dir):
    s = records(spark, sf_dir).filter("value IS NOT NULL").withColumn("coverage", F.round("value", 1) / 50)
    return rounded(ver.coverage_summary(s, ["issue", "lead"], "algorithm", 0.45), ["algorithm"])


@query(
    "confusion_metrics",
    """WITH c AS (SELECT doc_id % 4 AS g, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn FROM labels GROUP BY 1)
    SELECT *, round(tp / NULLIF(tp + fp, 0), 6) AS "precision", round(tp / NULLIF(tp + fn, 0), 6) AS recall, round(2 * tp / NULLIF(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def confusion_metrics(spark, sf_dir):
    lab = load(spark, sf_dir, "labels").withColumn("g", F.col("doc_id") % 4)
    return rounded(ver.confusion(lab, ["g"], F.col("quality") == 1, F.col("toxic") == 0), ["g"])


@query(
    "gauge_verification",
    f"SELECT c, count(*) AS n, round(sum(forecast) / sum(observed), 6) AS bias_ratio, round(corr(forecast, observed), 6) AS correlation, round(avg(abs(forecast - observed)), 6) AS mae, round(sqrt(avg(pow(forecast - observed, 2))), 6) AS rmse FROM ({PAIRS_SQL}) WHERE forecast IS NOT NULL AND observed IS NOT NULL GROUP BY c",
)
def gauge_verification(spark, sf_dir):
    return rounded(ver.gauge_scores(pairs(spark, sf_dir).withColumnsRenamed({"forecast": "estimate", "observed": "gauge"}), ["c"]), ["c"])


@query(
    "worst_group_gate",
    f"""WITH g AS (SELECT c, y, avg(CASE WHEN observed >= 10 AND forecast < 10 THEN 1.0 ELSE 0.0 END) AS rate FROM ({PAIRS_SQL}) WHERE forecast IS NOT NULL AND observed IS NOT NULL GROUP BY 1, 2) SELECT c, round(max(rate), 6) AS worst, arg_max(y, rate * 1000 - y / 1000) AS stratum, max(rate) <= 0.5 AS accepted FROM g GROUP BY c""",
)
def worst_group_gate(spark, sf_dir):
    p = pairs(spark, sf_dir).filter("forecast IS NOT NULL AND observed IS NOT NULL")
    g = p.groupBy("c", "y").agg(F.avg(((F.col("observed") >= 10) & (F.col("forecast") < 10)).cast("double")).alias("rate"))
    return g.groupBy("c").agg(F.round(F.max("rate"), 6).alias("worst"), F.max_by("y", F.struct("rate", -F.col("y"))).alias("stratum"), (F.max("rate") <= 0.5).alias("accepted"))


@query(
    "median_of_group_medians",
    "SELECT r, round(median(m), 6) AS bias, count(*) AS groups FROM (SELECT o_custkey % 7 AS r, o_custkey AS k, median(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY r",
)
def median_of_group_medians(spark, sf_dir):
    m = load(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("r"), "o_custkey").agg(F.median("o_totalprice").alias("m"))
    return m.groupBy("r").agg(F.round(F.median("m"), 6).alias("bias"), F.count("*").alias("groups"))


@query("relative_bias_interval")
def relative_bias_interval(spark, sf_dir):
    """The median of customers' median prices, and its bootstrap interval."""
    m = load(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("r"), "o_custkey").agg(F.median("o_totalprice").alias("m"))
    return resampling.median_bootstrap(m, ["r"], "m")


SKILL_SQL = """SELECT l_suppkey % 3 AS threshold, CASE l_partkey % 4 WHEN 0 THEN 'persistence' WHEN 1 THEN 'translation' ELSE 'lk' END AS model, l_orderkey // 1000 AS "case", l_orderkey // 250 AS issue, l_linenumber * 6 AS lead,
 CASE WHEN l_partkey % 19 <> 0 THEN l_quantity + CASE WHEN l_partkey % 4 > 1 THEN l_suppkey % 3 * 2 ELSE 0 END END AS score, CASE WHEN l_orderkey % 9999 <> 0 THEN 1 - l_discount END AS coverage FROM lineitem"""


def skill_records(spark, sf_dir):
    model = F.when(F.col("l_partkey") % 4 == 0, "persistence").when(F.col("l_partkey") % 4 == 1, "translation").otherwise("lk")
    bonus = F.when(F.col("l_partkey") % 4 > 1, F.col("l_suppkey") % 3 * 2).otherwise(0)
    return load(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("threshold"), model.alias("model"), F.floor(F.col("l_orderkey") / 1000).alias("case"), F.floor(F.col("l_orderkey") / 250).alias("issue"), (F.col("l_linenumber") * 6).alias("lead"),
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_quantity") + bonus).alias("score"), F.when(F.col("l_orderkey") % 9999 != 0, 1 - F.col("l_discount")).alias("coverage"),
    )


_COMPARED_SQL = f"""WITH r AS ({SKILL_SQL}), m AS (SELECT threshold, model, "case", issue, avg(score) AS v FROM r WHERE score IS NOT NULL GROUP BY ALL),
p AS (SELECT b.threshold, b.model AS baseline, b."case", avg(o.v - b.v) AS d FROM m b JOIN m o ON o.model = 'lk' AND b.model <> 'lk' AND o.threshold = b.threshold AND o."case" = b."case" AND o.issue = b.issue GROUP BY ALL),
k AS (SELECT threshold, count(*) AS n, count(c) AS there, min(c) AS least FROM (SELECT threshold, "case", issue, lead, max(coverage) AS c FROM r WHERE model = 'lk' GROUP BY ALL) GROUP BY 1),
e AS (SELECT threshold, count(DISTINCT "case") AS cases FROM r GROUP BY 1),
c AS (SELECT threshold, baseline, count(*) AS evaluable, count(*) FILTER (d > 0) AS positive, avg(d) AS difference FROM p GROUP BY ALL),
compared AS (SELECT threshold, baseline, cases, evaluable, positive, least AS least_coverage, n = there AND least >= 0.9 AS coverage_passes, n = there AND least >= 0.9 AND positive >= 0.8 * 10 AS passes, difference FROM c JOIN k USING (threshold) JOIN e USING (threshold))"""


@query("paired_skill", f"{_COMPARED_SQL} SELECT * REPLACE (round(difference, 6) AS difference) FROM compared")
def paired_skill(spark, sf_dir):
    """The gates of a candidate against its baselines at three thresholds; their
    intervals are those of ``paired_skill_interval``."""
    return resampling.paired_skill(skill_records(spark, sf_dir), ["threshold"], "lk", 8, 0.9, draws=100).withColumn("difference", F.round("difference", 6)).drop("low", "high")


@query("paired_skill_interval")
def paired_skill_interval(spark, sf_dir):
    return resampling.paired_skill(skill_records(spark, sf_dir), ["threshold"], "lk", 8, 0.9).select("threshold", "baseline", "difference", "low", "high")


@query(
    "skill_status",
    f"""{_COMPARED_SQL} SELECT CASE WHEN min(cases) < 5 OR bool_or(evaluable < cases) THEN 'insufficient_evidence' WHEN bool_and(passes) FILTER (baseline = 'persistence') AND bool_and(passes) FILTER (baseline <> 'persistence') THEN 'lk_supported'
    WHEN bool_and(passes) FILTER (baseline = 'persistence') AND NOT bool_and(passes) FILTER (baseline = 'translation') THEN 'translation_baseline_retained' ELSE 'skill_not_demonstrated' END AS status, count(*) AS comparisons, min(cases) AS cases FROM compared""",
)
def skill_status(spark, sf_dir):
    return resampling.skill_status(resampling.paired_skill(skill_records(spark, sf_dir), ["threshold"], "lk", 8, 0.9, draws=100), 5)


@query(
    "calibration_apply",
    "WITH p AS (SELECT l_orderkey AS k, l_linenumber AS n, l_discount * 10 AS p FROM lineitem) SELECT k, n, round(CASE WHEN p <= 0.1 THEN 0.05 WHEN p <= 0.5 THEN 0.05 + (p - 0.1) / 0.4 * 0.35 WHEN p <= 0.9 THEN 0.4 + (p - 0.5) / 0.4 * 0.55 ELSE 0.95 END, 6) AS calibrated FROM p",
)
def calibration_apply(spark, sf_dir):
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.05), (0.5, 0.4), (0.9, 0.95))])
    p = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_discount") * 10).alias("p"))
    return p.select("k", "n", F.round(bs.interpolate(F.col("p"), knots), 6).alias("calibrated"))


@query("calibration_suite_clamp", "SELECT l_orderkey AS k, l_linenumber AS n, l_discount AS p1, least(l_tax, l_discount) AS p2, least(l_discount / 2 + 0.01, l_tax, l_discount) AS p3 FROM lineitem")
def calibration_suite_clamp(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    a, b, c = ver.coherent([F.col("l_discount"), F.col("l_tax"), F.col("l_discount") / 2 + 0.01])
    return line.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), a.alias("p1"), b.alias("p2"), c.alias("p3"))


@query("pava_isotonic")
def pava_isotonic(spark, sf_dir):
    p = members(spark, sf_dir).select("g", (F.size(F.filter("members", lambda m: m > 25)) / F.size("members")).alias("p"), (F.col("observed") > 25).cast("int").alias("event"))
    return ver.isotonic(p, ["g"])


@query("block_bootstrap_ci")
def block_bootstrap_ci(spark, sf_dir):
    return resampling.block_bootstrap(records(spark, sf_dir).filter("value IS NOT NULL"), ["algorithm"], "issue", "lead")


@query("radial_spectrum")
def radial_spectrum(spark, sf_dir):
    return ver.radial_spectrum(pairs(spark, sf_dir).select("c", "y", "x", F.col("observed").alias("value")), ["c"])


@query(
    "polar_labels",
    """WITH RECURSIVE g AS (SELECT DISTINCT l_suppkey % 8 AS sweep, l_orderkey % 90 AS ray, l_partkey % 60 AS gate FROM lineitem), k AS (SELECT sweep, ray, gate, ray * 60 + gate AS id FROM g),
    n AS (SELECT sweep, id AS a, unnest([(ray + 1) % 90 * 60 + gate, (ray + 89) % 90 * 60 + gate, CASE WHEN gate < 59 THEN id + 1 END, CASE WHEN gate > 0 THEN id - 1 END]) AS b FROM k), e AS (SELECT n.sweep, a, b FROM n JOIN k ON k.sweep = n.sweep AND k.id = n.b),
    l(sweep, id, least) USING KEY (sweep, id) AS (SELECT sweep, id, id FROM k UNION SELECT e.sweep, e.b, min(l.least) FROM l JOIN e ON e.sweep = l.sweep AND e.a = l.id JOIN recurring.l AS n ON n.sweep = e.sweep AND n.id = e.b WHERE l.least < n.least GROUP BY 1, 2)
    SELECT sweep, k.ray, k.gate, dense_rank() OVER (PARTITION BY sweep ORDER BY least) AS label, count(*) OVER (PARTITION BY sweep, least) AS size FROM l JOIN k USING (sweep, id)""",
)
def polar_labels(spark, sf_dir):
    """Connected echoes of each sweep, around the circle."""
    g = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("sweep"), (F.col("l_orderkey") % 90).alias("ray"), (F.col("l_partkey") % 60).alias("gate")).distinct()
    return kernels.polar_labels(g, ["sweep"], 90)


@query("phase_correlation")
def phase_correlation(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return kernels.translation(p.select("c", "y", "x", F.col("observed").alias("previous"), F.col("forecast").alias("current")), ["c"])


@query("motion_forecast")
def motion_forecast(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return kernels.advected(p.select("c", "y", "x", F.col("observed").alias("previous"), F.col("forecast").alias("current")), ["c"], [6, 12, 18])


@query("motion_fields")
def motion_fields(spark, sf_dir):
    """Motion by features through a pyramid, of each pair of grids."""
    p = pairs(spark, sf_dir)
    return flow.motion_fields(p.select("c", "y", "x", F.col("observed").alias("previous"), F.col("forecast").alias("current")), ["c"])


@query("six_minute_frames")
def six_minute_frames(spark, sf_dir):
    """Ten-minute frames of two members as six-minute ones."""
    line = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("c"), (F.col("l_linenumber") % 2).alias("member"), (F.col("l_orderkey") % 4 * 10).cast("int").alias("lead_min"), (F.col("l_partkey") % 24).alias("y"), (F.floor(F.col("l_orderkey") / 4) % 24).alias("x"), "l_quantity")
    return flow.resampled(line.groupBy("c", "member", "lead_min", "y", "x").agg(F.avg("l_quantity").alias("rate")), ["c"])


@query("ensemble_forecast")
def ensemble_forecast(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return kernels.perturbed(p.select("c", "y", "x", F.col("observed").alias("previous"), F.col("forecast").alias("current")), ["c"], [6, 12], 3)


@query(
    "persistence_baseline",
    f"SELECT c, y, x, unnest([6, 12, 18]) AS lead_min, observed AS rate FROM ({PAIRS_SQL})",
)
def persistence_baseline(spark, sf_dir):
    return pairs(spark, sf_dir).select("c", "y", "x", F.explode(F.array(*[F.lit(i) for i in (6, 12, 18)])).alias("lead_min"), F.col("observed").alias("rate"))


@query(
    "viterbi_states",
    f"""WITH RECURSIVE g AS (SELECT ray, gate, row_number() OVER (PARTITION BY ray ORDER BY gate) AS i, greatest(0.001::DOUBLE, least(0.999::DOUBLE, coalesce(partial, 0.5::DOUBLE))) AS p FROM ({GATES_SQL})),
    v AS (SELECT ray, 0::BIGINT AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, []::INTEGER[] AS pa, []::INTEGER[] AS pb FROM g GROUP BY 1
     UNION ALL SELECT v.ray, g.i, greatest(a + ln(0.9::DOUBLE), b + ln(1 - 0.9::DOUBLE)) + ln(1 - p), greatest(b + ln(0.9::DOUBLE), a + ln(1 - 0.9::DOUBLE)) + ln(p), list_append(CASE WHEN a + ln(0.9::DOUBLE) >= b + ln(1 - 0.9::DOUBLE) THEN pa ELSE pb END, 0), list_append(CASE WHEN b + ln(0.9::DOUBLE) >= a + ln(1 - 0.9::DOUBLE) THEN pb ELSE pa END, 1)
     FROM v JOIN g ON g.ray = v.ray AND g.i = v.i + 1), w AS (SELECT ray, arg_max(CASE WHEN b > a THEN pb ELSE pa END, i) AS path FROM v GROUP BY 1)
    SELECT ray, gate, path[i] AS state FROM g JOIN w USING (ray)""",
)
def viterbi_states(spark, sf_dir):
    from hydrolith.plans.sequence_queries import gates

    return kernels.ray_states(gates(spark, sf_dir), ["ray"], "gate", "partial")


@query(
    "greedy_holdout",
    f"""WITH RECURSIVE s AS (SELECT t // 864000 AS month, radar, t, value, scan_id FROM ({SCANS_SQL})),
    p AS (SELECT DISTINCT month, 0 AS i, []::STRUCT(radar BIGINT, t BIGINT, value DOUBLE, scan_id BIGINT)[] AS picks FROM s
     UNION ALL SELECT p.month, p.i + 1, list_append(any_value(p.picks), arg_max(struct_pack(radar := s.radar, t := s.t, value := s.value, scan_id := s.scan_id), struct_pack(v := s.value, k := -s.scan_id))) FROM p JOIN s ON s.month = p.month
     WHERE p.i < 5 AND len(list_filter(p.picks, lambda x: x.radar = s.radar OR abs(x.t - s.t) < 86400)) = 0 GROUP BY p.month, p.i),
    f AS (SELECT month, arg_max(picks, i) AS picks FROM p GROUP BY 1), u AS (SELECT month, unnest(picks) AS x, unnest(range(1, len(picks) + 1)) AS k FROM f)
    SELECT month, x.radar AS radar, x.t AS t, x.value AS value, x.scan_id AS scan_id, CAST(k AS INTEGER) AS rank FROM u""",
)
def greedy_holdout(spark, sf_dir):
    from hydrolith.plans.views import scans

    s = scans(spark, sf_dir).withColumn("month", F.floor(F.col("t") / (86400 * 10)).cast("long"))
    return kernels.separated(s.select("month", "radar", "t", "value", "scan_id"), ["month"], "t", "value", "radar", "scan_id", 86400, 5)


@query(
    "sample_plan",
    "SELECT l_orderkey % 6 AS shard, count(*) AS samples, CAST(sum(l_quantity) AS DOUBLE) AS weight FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
)
def sample_plan(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").filter("l_quantity > 10")
    return line.groupBy((F.col("l_orderkey") % 6).alias("shard")).agg(F.count("*").alias("samples"), F.sum("l_quantity").alias("weight"))


@query("weighted_crops")
def weighted_crops(spark, sf_dir):
    p = pairs(spark, sf_dir).select("c", "y", "x", F.coalesce("observed", F.lit(0.0)).alias("score"))
    return kernels.crops(p, ["c"], 6, 8)
