"""Cells: quality control, composites, rain, accumulation, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.functions import basic as bs
from hydrolith.functions import physics as ph
from hydrolith.operators import grids
from hydrolith.plans.registry import load, query
from hydrolith.plans.views import CELLS_SQL, cells, split_columns, spread
from hydrolith.profiles import REJECT, Hybrid, Mosaic, flag

_RATE = "CASE WHEN NOT valid OR dbzh IS NULL THEN NULL WHEN dbzh < 10 THEN 0.0 ELSE least(exp((dbzh / 10 * ln(10.0) - ln(200.0)) / 1.6), 300.0) END"
_REJECT = flag(*REJECT)


@query("zr_qpe", f"SELECT analysis, y, x, source, round(CAST({_RATE} AS DOUBLE), 6) AS rate, valid AND dbzh IS NOT NULL AND dbzh >= 10 AND exp((dbzh / 10 * ln(10.0) - ln(200.0)) / 1.6) > 300 AS capped FROM ({CELLS_SQL})")
def zr_qpe(spark, sf_dir):
    q = grids.qpe(cells(spark, sf_dir))
    return q.select("analysis", "y", "x", "source", F.round("rate", 6).alias("rate"), "capped")


@query(
    "qpe_summary",
    f"""WITH q AS (SELECT analysis, CAST({_RATE} AS DOUBLE) AS rate FROM ({CELLS_SQL})) SELECT analysis, count(*) AS cells, count(rate) AS valid_cells, count(*) FILTER (WHERE rate IS NULL) AS missing_cells, count(*) FILTER (WHERE rate = 0) AS dry_cells,
    round(avg(rate), 6) AS mean, round(max(rate), 6) AS maximum, round(quantile_cont(rate, 0.95), 6) AS p95 FROM q GROUP BY analysis""",
)
def qpe_summary(spark, sf_dir):
    s = grids.field_summary(grids.qpe(cells(spark, sf_dir)), ["analysis"])
    return s.select("analysis", "cells", "valid_cells", "missing_cells", "dry_cells", *[F.round(c, 6).alias(c) for c in ("mean", "maximum", "p95")])


@query(
    "area_statistics",
    f"SELECT count(rate) AS valid_cells, count(*) - count(rate) AS missing_cells, round(avg(rate), 6) AS mean, round(max(rate), 6) AS maximum FROM (SELECT y, x, CAST({_RATE} AS DOUBLE) AS rate FROM ({CELLS_SQL})) WHERE y BETWEEN 10 AND 30 AND x BETWEEN 5 AND 20",
)
def area_statistics(spark, sf_dir):
    a = grids.area_statistics(grids.qpe(cells(spark, sf_dir)), (10, 5, 30, 20))
    return a.select("valid_cells", "missing_cells", F.round("mean", 6).alias("mean"), F.round("maximum", 6).alias("maximum"))


def mosaic_sql(weight: str, keep: str, most_offset: float) -> str:
    return f"""WITH c AS (SELECT *, quality * (0.8 + 0.2 * greatest(0.0, 1.0 - abs(offset_s) / {most_offset})) AS q FROM ({CELLS_SQL})),
    u AS (SELECT *, coalesce(valid AND dbzh IS NOT NULL AND q >= 0.1 AND q > 0 AND (qc_flags & {_REJECT}) = 0, false) AS usable FROM c),
    w AS (SELECT *, CASE WHEN usable THEN {weight} END AS w FROM u), b AS (SELECT *, max(w) OVER (PARTITION BY analysis, y, x) AS best FROM w), k AS (SELECT *, {keep} AS c FROM b),
    g AS (SELECT analysis, y, x, count(c) AS contributors, 10 * log10(sum(pow(10.0, dbzh / 10) * c) / sum(c)) AS dbzh, sum(q * c) / sum(c) AS quality, sum((data_age_min + abs(offset_s) / 60) * c) / sum(c) AS age,
    bit_or(CASE WHEN c IS NOT NULL THEN qc_flags END) AS f, max(CASE WHEN c IS NOT NULL THEN source END) AS code FROM k GROUP BY 1, 2, 3)
    SELECT analysis, y, x, contributors, round(CAST(dbzh AS DOUBLE), 5) AS dbzh, round(CAST(quality AS DOUBLE), 5) AS quality, round(CAST(age AS DOUBLE), 5) AS data_age_min,
    CAST(CASE WHEN contributors = 0 THEN {flag("MISSING")} ELSE f | CASE WHEN quality < 0.45 THEN {flag("LOW_QUALITY")} ELSE 0 END END AS BIGINT) AS qc_flags,
    CAST(CASE WHEN contributors = 0 THEN 0 WHEN contributors = 1 THEN code ELSE 65535 END AS INTEGER) AS source_code, contributors > 0 AS valid FROM g"""


def _mosaic(spark, sf_dir, p: Mosaic):
    m = grids.mosaic(cells(spark, sf_dir).withColumn("code", F.col("source")), ["analysis", "y", "x"], p)
    return m.select("analysis", "y", "x", "contributors", *[F.round(c, 5).alias(c) for c in ("dbzh", "quality", "data_age_min")], "qc_flags", "source_code", "valid")


@query("quality_weighted_linear_mean", mosaic_sql("q", "CASE WHEN w >= best - 0.1 THEN pow(q, 2.0) END", 150.0))
def quality_weighted_linear_mean(spark, sf_dir):
    return _mosaic(spark, sf_dir, Mosaic())


@query("distance_weighted_linear_mean", mosaic_sql("2.0 * ln(q) - pow(distance_m / 100000.0, 2.0)", "exp(w - best)", 300.0))
def distance_weighted_linear_mean(spark, sf_dir):
    return _mosaic(spark, sf_dir, Mosaic(method="distance", most_offset_s=300.0))


@query(
    "first_usable_by_priority",
    f"""WITH c AS (SELECT *, CAST(source % 3 AS DOUBLE) + 0.5 AS elevation_deg, source AS sweep, CAST(x % 10 AS DOUBLE) / 11 AS blockage, CAST(y * 250 AS DOUBLE) AS agl_m, offset_s / 180 AS az, data_age_min / 10 AS rg FROM ({CELLS_SQL})),
    u AS (SELECT *, coalesce(dbzh IS NOT NULL AND valid AND (qc_flags & {_REJECT}) = 0 AND quality >= 0.1 AND blockage <= 0.7 AND agl_m BETWEEN 0 AND 10000 AND az <= 0.75 AND rg <= 0.55, false) AS u FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY analysis, y, x, ray ORDER BY CASE WHEN u THEN 0 ELSE 1 END, elevation_deg, sweep) AS n, max(CASE WHEN blockage > 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY analysis, y, x, ray) AS severe FROM u)
    SELECT analysis, y, x, ray, CASE WHEN u THEN sweep END AS sweep, CASE WHEN u THEN round(quality * (1 - blockage) * exp(-agl_m / 6000), 5) END AS quality,
    CAST(CASE WHEN u THEN qc_flags | CASE WHEN blockage >= 0.1 THEN {flag("BEAM_BLOCKED")} ELSE 0 END ELSE {flag("MISSING")} | CASE WHEN severe = 1 THEN {flag("BEAM_BLOCKED")} ELSE 0 END END AS BIGINT) AS qc_flags, u AS valid FROM r WHERE n = 1""",
)
def first_usable_by_priority(spark, sf_dir):
    c = cells(spark, sf_dir).withColumns({
        "elevation_deg": (F.col("source") % 3).cast("double") + 0.5, "sweep": F.col("source"), "blockage": (F.col("x") % 10).cast("double") / 11, "agl_m": (F.col("y") * 250).cast("double"),
        "azimuth_offset_deg": F.col("offset_s") / 180, "range_offset_gates": F.col("data_age_min") / 10,
    })
    h = grids.hybrid_scan(c, ["analysis", "y", "x", "ray"], Hybrid())
    return h.select("analysis", "y", "x", "ray", "sweep", F.round("quality", 5).alias("quality"), "qc_flags", "valid")


@query(
    "column_max_with_source",
    f"SELECT y, x, max(dbzh) AS dbzh, arg_max(source, dbzh * 100 - source) AS source, count(dbzh) AS layers FROM ({CELLS_SQL}) WHERE dbzh IS NOT NULL GROUP BY 1, 2",
)
def column_max_with_source(spark, sf_dir):
    return grids.column_max(cells(spark, sf_dir), ["y", "x"], "dbzh", "source")


_LEVELS = """analysis, y, x, CAST(source % 3 AS INTEGER) AS level, dbzh, quality, ray * 10 + source AS source, data_age_min AS age_min, 1000.0 + x * 3 AS resolution_m, CAST(1000 AS DOUBLE) AS grid_m, CAST(ray % 17 * 30 AS DOUBLE) AS height_off_m"""


@query(
    "level_winner_column_max",
    f"""WITH c AS (SELECT {_LEVELS} FROM ({CELLS_SQL})), s AS (SELECT *, quality * exp(-age_min / 10) * least(1.0, grid_m / resolution_m) / (1 + abs(height_off_m) / 250) AS score FROM c),
    w AS (SELECT *, row_number() OVER (PARTITION BY analysis, y, x, level ORDER BY score DESC, source, dbzh DESC NULLS LAST) AS n FROM s), t AS (SELECT *, row_number() OVER (PARTITION BY analysis, y, x ORDER BY dbzh DESC, level) AS m, count(*) OVER (PARTITION BY analysis, y, x) AS levels FROM w WHERE n = 1 AND dbzh IS NOT NULL)
    SELECT analysis, y, x, dbzh, level, levels FROM t WHERE m = 1""",
)
def level_winner_column_max(spark, sf_dir):
    c = cells(spark, sf_dir).selectExpr(*split_columns(_LEVELS.replace("1000.0 +", "1000.0D +")))
    return grids.level_winners(c, ["analysis", "y", "x"], "level", 10.0, 250.0).select("analysis", "y", "x", "dbzh", "level", "levels")


@query("bit_or_flags", f"SELECT analysis, y, CAST(bit_or(qc_flags) AS BIGINT) AS flags, count(*) FILTER (WHERE (qc_flags & {_REJECT}) = 0) AS clean, count(*) FILTER (WHERE (qc_flags & 8) <> 0) AS radial FROM ({CELLS_SQL}) GROUP BY 1, 2")
def bit_or_flags(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.groupBy("analysis", "y").agg(F.bit_or("qc_flags").alias("flags"), F.count_if(bs.has_none(F.col("qc_flags"), _REJECT)).alias("clean"), F.count_if(bs.has_any(F.col("qc_flags"), 8)).alias("radial"))


_GATE = """ray, gate, dbzh, CASE WHEN ray % 5 = 0 THEN NULL ELSE CAST(ray % 20 AS DOUBLE) END AS snr, CASE WHEN y % 4 = 0 THEN NULL ELSE 0.6 + CAST(y AS DOUBLE) / 100 END AS rhohv, CASE WHEN x % 3 = 0 THEN NULL ELSE CAST(x % 20 AS DOUBLE) / 20 END AS p_radial,
 CASE WHEN y % 3 = 0 THEN NULL ELSE CAST(y % 10 AS DOUBLE) / 12 END AS p_clutter, CAST(7 AS INTEGER) AS last_gate, CASE WHEN ray % 7 = 0 THEN 'DEGRADED' WHEN ray % 31 = 0 THEN 'UNAVAILABLE' ELSE 'HEALTHY' END AS health"""


@query(
    "basic_quality_control",
    f"""WITH g AS (SELECT {_GATE} FROM ({CELLS_SQL})), v AS (SELECT *, coalesce(dbzh BETWEEN -32 AND 80, false) AS valid, coalesce(dbzh BETWEEN -32 AND 80 AND dbzh < -5, false) AS no_rain FROM g WHERE health <> 'UNAVAILABLE'),
    m AS (SELECT *, CASE WHEN snr IS NOT NULL THEN least(greatest(snr / 12, 0.0), 1.0) END AS a, CASE WHEN rhohv IS NOT NULL THEN least(greatest((rhohv - 0.7) / 0.27, 0.0), 1.0) END AS b FROM v),
    p AS (SELECT *, CASE WHEN NOT valid THEN NULL WHEN no_rain THEN 1.0 WHEN a IS NULL AND b IS NULL THEN 0.6 ELSE (coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT) END AS p_meteo FROM m),
    q AS (SELECT *, CASE WHEN valid THEN coalesce(p_meteo * (1 - coalesce(p_clutter, 0)), 1) * coalesce(1 - p_radial, 1) * (1 - 0.08 * gate / last_gate) * CASE WHEN health = 'DEGRADED' THEN 0.8 ELSE 1.0 END END AS quality, coalesce(valid AND NOT no_rain AND snr < 3, false) AS low FROM p)
    SELECT health, count(*) AS gates, count(quality) AS valid_gates, round(CAST(avg(quality) AS DOUBLE), 5) AS mean_quality, round(CAST(avg(p_meteo) AS DOUBLE), 5) AS mean_meteo, count(*) FILTER (WHERE low) AS low_snr,
    count(*) FILTER (WHERE valid AND coalesce(p_radial, 0) >= 0.8) AS radial, count(*) FILTER (WHERE valid AND coalesce(p_clutter, 0) >= 0.7) AS clutter, count(*) FILTER (WHERE valid AND (quality < 0.45 OR low OR coalesce(p_radial, 0) >= 0.65)) AS low_quality FROM q GROUP BY health""",
)
def basic_quality_control(spark, sf_dir):
    from hydrolith.profiles import Qc

    g = cells(spark, sf_dir).selectExpr(*split_columns(_GATE.replace("0.6 +", "0.6D +")))
    q = grids.basic_qc(g, Qc(dry_dbz=-5.0))
    has = lambda name: F.count_if(bs.has_any(F.col("qc_flags"), flag(name)))
    return q.groupBy("health").agg(
        F.count("*").alias("gates"), F.count("quality").alias("valid_gates"), F.round(F.avg("quality"), 5).alias("mean_quality"), F.round(F.avg("p_meteo"), 5).alias("mean_meteo"),
        has("LOW_SNR").alias("low_snr"), has("RADIAL_INTERFERENCE").alias("radial"), has("GROUND_CLUTTER").alias("clutter"), has("LOW_QUALITY").alias("low_quality"),
    )


@query(
    "scan_health",
    """WITH f AS (SELECT o_orderkey AS scan, CAST(o_orderkey % 60 AS DOUBLE) / 59 AS c, CAST(o_custkey % 5 AS DOUBLE) AS gap, o_orderstatus <> 'P' AS has, o_custkey % 4 = 0 AS miss, o_orderkey % 9 = 0 AS odd, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(-60 - o_custkey % 55 AS DOUBLE) END AS noise FROM orders),
    r AS (SELECT *, list_sort(list_filter([CASE WHEN NOT has THEN 'DBZH_UNAVAILABLE' END, CASE WHEN c < 0.97 THEN 'SCAN_INCOMPLETE' END, CASE WHEN gap > 3 THEN 'AZIMUTH_GAP' END, CASE WHEN miss THEN 'FIELD_UNAVAILABLE' END, CASE WHEN odd THEN 'ANOMALOUS_VALUES' END,
    CASE WHEN noise IS NULL THEN 'NOISE_TELEMETRY_MISSING' WHEN noise < -120 OR noise > -70 THEN 'NOISE_OUT_OF_RANGE' END], lambda x: x IS NOT NULL)) AS reasons FROM f)
    SELECT scan, CASE WHEN NOT has OR c < 0.5 THEN 'UNAVAILABLE' WHEN len(reasons) > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS state, array_to_string(reasons, ',') AS reasons FROM r""",
)
def scan_health(spark, sf_dir):
    o = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS scan", "CAST(o_orderkey % 60 AS DOUBLE) / 59 AS c", "CAST(o_custkey % 5 AS DOUBLE) AS gap", "o_orderstatus <> 'P' AS has", "o_custkey % 4 = 0 AS miss", "o_orderkey % 9 = 0 AS odd", "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(-60 - o_custkey % 55 AS DOUBLE) END AS noise"
    )
    no = F.lit(False)
    h = grids.health_state({
        "completeness": F.col("c"), "gap_deg": F.col("gap"), "step_deg": F.lit(1.0), "has_dbzh": F.col("has"), "fields_missing": F.col("miss").cast("int"), "outlier_ratio": F.lit(0.0), "odd_layers": F.col("odd").cast("int"),
        "noise_low": F.col("noise"), "noise_high": F.col("noise"), "config_ready": ~no, "time_warning": no,
    })
    return o.select("scan", h.alias("h")).select("scan", "h.state", F.array_join("h.reasons", ",").alias("reasons"))


@query(
    "layer_anomalies",
    f"""SELECT analysis, source AS sweep, count(dbzh) AS finite, count(*) AS gates, count(dbzh) = 0 AS all_missing, coalesce(max(dbzh) - min(dbzh) <= 0.000001, false) AS constant, count(*) FILTER (WHERE dbzh > 65 OR dbzh < -9) AS outliers FROM ({CELLS_SQL}) GROUP BY 1, 2""",
)
def layer_anomalies(spark, sf_dir):
    d = F.col("dbzh")
    return cells(spark, sf_dir).groupBy("analysis", F.col("source").alias("sweep")).agg(
        F.count(d).alias("finite"), F.count("*").alias("gates"), (F.count(d) == 0).alias("all_missing"), F.coalesce(F.max(d) - F.min(d) <= 1e-6, F.lit(False)).alias("constant"), F.count_if((d > 65) | (d < -9)).alias("outliers")
    )


@query(
    "stratiform_vpr",
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey % 45 AS DOUBLE) AS z, CAST(l_suppkey % 100 * 80 AS DOUBLE) AS h, 3000.0 AS lo, 4000.0 AS hi, l_orderkey % 3 <> 0 AS s FROM lineitem),
    d AS (SELECT *, CASE WHEN s AND h BETWEEN lo AND hi THEN -6 * (1 - abs(2 * (h - lo) / (hi - lo) - 1)) WHEN s AND h > hi AND h - hi > 1500 THEN NULL WHEN s AND h > hi THEN least((h - hi) / 1000 * 4, 6) ELSE 0 END AS c FROM c)
    SELECT k, n, round(CAST(z + c AS DOUBLE), 5) AS value, round(CAST(CASE WHEN s AND h BETWEEN lo AND hi THEN least(3, 0.5 + abs(c) / 2) WHEN s AND h > hi THEN least(3, 0.5 + (h - hi) / 1000) ELSE 0 END AS DOUBLE), 5) AS uncertainty, s AND h - hi > 1500 AS overshoot FROM d""",
)
def stratiform_vpr(spark, sf_dir):
    c = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS n", "CAST(l_partkey % 45 AS DOUBLE) AS z", "CAST(l_suppkey % 100 * 80 AS DOUBLE) AS h", "l_orderkey % 3 <> 0 AS s")
    v = c.withColumn("v", ph.stratiform_vpr(F.col("z"), F.col("h"), F.lit(3000.0), F.lit(4000.0), F.col("s")))
    return v.select("k", "n", F.round("v.value", 5).alias("value"), F.round("v.uncertainty", 5).alias("uncertainty"), F.col("v.overshoot").alias("overshoot"))


#: Rates of members and leads: run, member, lead, rate.
_LEADS = "l_orderkey AS run, CAST(l_linenumber AS INTEGER) AS member, unnest([6, 12, 18, 24, 30]) AS lead_min, l_partkey AS p"


def leads(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("int").alias("member"), F.col("l_partkey").alias("p"))
    line = spread(line, "run").groupBy("run", "member").agg(F.min("p").alias("p"))
    e = line.withColumn("lead_min", F.explode(F.array(*[F.lit(x) for x in (6, 12, 18, 24, 30)])))
    return e.selectExpr("run", "member", "lead_min", "CASE WHEN (p + lead_min) % 23 = 0 THEN NULL ELSE CAST((p * lead_min) % 40 AS DOUBLE) END AS rate")


LEADS_SQL = "SELECT run, member, lead_min, CASE WHEN (p + lead_min) % 23 = 0 THEN NULL ELSE CAST((p * lead_min) % 40 AS DOUBLE) END AS rate FROM (SELECT run, member, p, unnest([6, 12, 18, 24, 30]) AS lead_min FROM (SELECT l_orderkey AS run, CAST(l_linenumber AS INTEGER) AS member, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2))"


@query("interval_accumulation", f"SELECT run, member, CASE WHEN count(rate) = 3 THEN round(sum(rate) / 10, 6) END AS amount FROM ({LEADS_SQL}) WHERE lead_min > 6 AND lead_min <= 24 GROUP BY 1, 2")
def interval_accumulation(spark, sf_dir):
    return grids.accumulated(leads(spark, sf_dir), ["run", "member"], 6, 24).withColumn("amount", F.round("amount", 6))


@query(
    "member_first_quantile",
    f"""WITH a AS (SELECT run, member, CASE WHEN count(rate) = 5 THEN sum(rate) / 10 END AS amount FROM ({LEADS_SQL}) GROUP BY 1, 2) SELECT run, CASE WHEN count(amount) = 3 THEN round(quantile_cont(amount, 0.5), 6) END AS amount FROM a GROUP BY run""",
)
def member_first_quantile(spark, sf_dir):
    return grids.member_first(leads(spark, sf_dir), ["run"], "member", 0, 30, 0.5, 3).withColumn("amount", F.round("amount", 6))


@query(
    "ensemble_statistics",
    f"""SELECT run, lead_min, count(rate) AS members, CASE WHEN count(rate) >= 2 THEN round(avg(rate), 6) END AS mean, CASE WHEN count(rate) >= 2 THEN round(quantile_cont(rate, 0.1), 6) END AS p10, CASE WHEN count(rate) >= 2 THEN round(quantile_cont(rate, 0.5), 6) END AS p50,
    CASE WHEN count(rate) >= 2 THEN round(quantile_cont(rate, 0.9), 6) END AS p90, CASE WHEN count(rate) >= 2 THEN round((count(*) FILTER (WHERE rate > 5)) / count(rate), 6) END AS over_5 FROM ({LEADS_SQL}) GROUP BY 1, 2""",
)
def ensemble_statistics(spark, sf_dir):
    e = grids.ensemble(leads(spark, sf_dir).withColumn("valid", F.col("rate").isNotNull()), ["run", "lead_min"], [5.0], 2)
    return e.select("run", "lead_min", "members", *[F.round(c, 6).alias(c) for c in ("mean", "p10", "p50", "p90", "over_5")])


@query(
    "input_gates",
    """WITH f AS (SELECT o_custkey AS k, CAST(o_orderkey % 50 AS DOUBLE) / 49 AS c, CAST(o_orderkey % 40 AS DOUBLE) / 39 AS q, CAST(o_orderkey % 12 AS DOUBLE) AS a, o_orderstatus <> 'P' AS o FROM orders),
    g AS (SELECT k, count(*) AS frames, min(c) AS c, min(q) AS q, max(a) AS a, bool_and(o) AS o FROM f GROUP BY k)
    SELECT k, frames, array_to_string(list_filter([CASE WHEN frames < 3 THEN 'TOO_FEW_FRAMES' END, CASE WHEN c < 0.7 THEN 'COVERAGE' END, CASE WHEN q < 0.45 THEN 'QUALITY' END, CASE WHEN a > 10 THEN 'AGE' END, CASE WHEN NOT o THEN 'NOT_OPERATIONAL' END], lambda x: x IS NOT NULL), ',') AS failed FROM g""",
)
def input_gates(spark, sf_dir):
    f = load(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "CAST(o_orderkey % 50 AS DOUBLE) / 49 AS coverage", "CAST(o_orderkey % 40 AS DOUBLE) / 39 AS mean_quality", "CAST(o_orderkey % 12 AS DOUBLE) AS age_min", "o_orderstatus <> 'P' AS operational")
    return grids.input_gates(f, ["k"]).select("k", "frames", F.array_join("failed", ",").alias("failed"))


@query("tile_blend", f"SELECT y, x, round(sum(dbzh * quality) / NULLIF(sum(CASE WHEN dbzh IS NOT NULL THEN quality END), 0), 6) AS dbzh, count(CASE WHEN dbzh IS NOT NULL THEN quality END) AS tiles FROM ({CELLS_SQL}) GROUP BY 1, 2")
def tile_blend(spark, sf_dir):
    return grids.blended_tiles(cells(spark, sf_dir), ["y", "x"], "dbzh", "quality").withColumn("dbzh", F.round("dbzh", 6))


@query(
    "clutter_laplace",
    f"SELECT y, x, count(*) AS samples, count(DISTINCT ray % 30) AS days, count(*) FILTER (WHERE quality > 0.5) AS hits, CASE WHEN count(DISTINCT ray % 30) >= 2 AND count(*) >= 3 THEN round((count(*) FILTER (WHERE quality > 0.5) + 1) / (count(*) + 2), 6) END AS probability FROM ({CELLS_SQL}) GROUP BY 1, 2",
)
def clutter_laplace(spark, sf_dir):
    s = cells(spark, sf_dir).withColumns({"hit": F.col("quality") > 0.5, "day": F.col("ray") % 30})
    return grids.clutter_probability(s, ["y", "x"], "hit", "day", 2, 3).withColumn("probability", F.round("probability", 6))


@query("anchor_recurrence", f"SELECT y, x, count(*) AS volumes, count(*) FILTER (WHERE h) AS hits FROM (SELECT y, x, analysis, bool_or(quality > 0.8) AS h FROM ({CELLS_SQL}) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def anchor_recurrence(spark, sf_dir):
    return grids.recurrence(cells(spark, sf_dir).withColumn("hit", F.col("quality") > 0.8), ["y", "x"], "analysis", "hit")


@query(
    "label_statistics",
    f"SELECT analysis, y, x, source, count(*) OVER (PARTITION BY y) AS size, round(avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY y), 6) AS fraction FROM ({CELLS_SQL})",
)
def label_statistics(spark, sf_dir):
    """Size and share of every label, joined back to its members."""
    c = cells(spark, sf_dir)
    g = c.groupBy("y").agg(F.count("*").alias("size"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("fraction"))
    return c.select("analysis", "y", "x", "source").join(g, "y")


@query("polar_wedge_area", f"SELECT analysis, round(sum(0.5 * radians(1.0) * (pow((gate + 1) * 250.0, 2) - pow(gate * 250.0, 2)) / 1000000), 6) AS area_km2 FROM (SELECT DISTINCT analysis, ray, gate FROM ({CELLS_SQL}) WHERE valid) GROUP BY 1")
def polar_wedge_area(spark, sf_dir):
    g = cells(spark, sf_dir).filter("valid").select("analysis", "ray", "gate").distinct()
    return g.groupBy("analysis").agg(F.round(F.sum(ph.wedge_area_km2(F.col("gate") * F.lit(250.0), (F.col("gate") + 1) * F.lit(250.0), 1.0)), 6).alias("area_km2"))


@query("nearest_cell", "SELECT c_custkey, CAST(floor((c_acctbal + 1000) / 100 + 0.5) AS BIGINT) AS x, CAST(ceil((c_acctbal + 1000) / 250 - 0.000000001) AS BIGINT) AS first_row FROM customer")
def nearest_cell(spark, sf_dir):
    v = F.col("c_acctbal") + 1000
    return load(spark, sf_dir, "customer").select("c_custkey", F.floor(v / 100 + 0.5).cast("long").alias("x"), F.ceil(v / 250 - 1e-9).cast("long").alias("first_row"))


@query("palette_buckets", f"SELECT b AS stop, count(*) AS n FROM (SELECT CASE WHEN dbzh IS NULL OR dbzh < 5 THEN -1 ELSE len(list_filter([0.0, 10.0, 20.0, 30.0, 40.0, 50.0], lambda s: s <= dbzh)) - 1 END AS b FROM ({CELLS_SQL})) GROUP BY 1")
def palette_buckets(spark, sf_dir):
    d = F.col("dbzh")
    at = F.when(d.isNull() | (d < 5), F.lit(-1)).otherwise(bs.bucket(d, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]))
    return cells(spark, sf_dir).groupBy(at.cast("long").alias("stop")).agg(F.count("*").alias("n"))


@query(
    "point_index",
    f"SELECT analysis, y, x, source, CAST(CASE WHEN valid AND dbzh IS NOT NULL THEN round_even(quality * 254, 0) ELSE 255 END AS INTEGER) AS code FROM ({CELLS_SQL})",
)
def point_index(spark, sf_dir):
    """Quantised confidence of every cell, 255 where it is missing."""
    ok = F.col("valid") & F.col("dbzh").isNotNull()
    return cells(spark, sf_dir).select("analysis", "y", "x", "source", F.when(ok, F.bround(F.col("quality") * 254)).otherwise(F.lit(255.0)).cast("int").alias("code"))


@query(
    "grid_to_polar",
    """WITH c AS (SELECT DISTINCT l_partkey % 40 AS y, l_orderkey % 40 AS x FROM lineitem), g AS (SELECT *, (x - 20) * 1000.0 AS dx, (y - 20) * 1000.0 AS dy FROM c), p AS (SELECT *, sqrt(dx * dx + dy * dy) AS r, degrees(atan2(dx, dy)) AS a0 FROM g)
    SELECT y, x, CAST(ceil((CASE WHEN a0 < 0 THEN a0 + 360 ELSE a0 END) - 0.5) AS BIGINT) % 360 AS ray, CAST(floor(r / 250) AS BIGINT) AS gate FROM p WHERE r <= 25000""",
)
def grid_to_polar(spark, sf_dir):
    """Nearest ray (ties to the lower) and gate of each grid cell, by formula:
    regular rays need no search and no join."""
    c = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).alias("y"), (F.col("l_orderkey") % 40).alias("x")).distinct()
    dx, dy = (F.col("x") - 20) * F.lit(1000.0), (F.col("y") - 20) * F.lit(1000.0)
    r, a = F.sqrt(dx * dx + dy * dy), bs.pmod_deg(F.degrees(F.atan2(dx, dy)))
    return c.withColumns({"r": r, "a": a}).filter("r <= 25000").select("y", "x", (F.ceil(F.col("a") - 0.5).cast("long") % 360).alias("ray"), F.floor(F.col("r") / 250).cast("long").alias("gate"))
