"""Interference detectors over the driver's tables, with SQL.

A sweep is 1,000 orders: 36 rays of 40 gates. Of twelve rays one is full of a
source, one strong and one candidate of each kind; between two full ones some rays
are like their fan and some are not; moments vary with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.operators import evidence, interference
from hydrolith.plans.registry import load, query

RAYS, GATES = 36, 40
RADIAL = interference.Radial(rays=RAYS, gates=GATES, run=8, segment=4, short_range_m=30_000.0, difference_db=20.0, broad_dbz=35.0, broad_run=8, broad_growth_db=9.0, broad_iqr_db=7.0)
FANS = interference.Fans(gap_rays=3, seed_fraction=0.3, valid_fraction=0.6, high_dbz=21.0, high_fraction=0.4, high_run=4, growth_db=5.5, extent_valid_fraction=0.5, extent_run=6, edge_rays=2, edge_high_fraction=0.3, edge_iqr_db=5.0, edge_valid_fraction=0.5)
SIGNATURE = interference.Signature(echo_dbz=5.0, samples=5, span_m=8_000.0, log_span_db=1.0, residual_p90_db=4.0, growth_db=1.0, high_dbz=18.0)

_AT = "l_orderkey {div} 1000 AS sweep, l_partkey % 36 AS ray, (l_suppkey * 7 + l_linenumber * 11 + l_orderkey * 3) % 40 AS gate"
_C = "(ray + sweep) % 12"
_VALUE = f"""CASE WHEN (p + o) % 19 = 0 THEN NULL WHEN {_C} = 0 THEN CAST(32 AS DOUBLE) + CAST(gate AS DOUBLE) / 3 + CAST(o % 3 AS DOUBLE) WHEN {_C} = 9 AND sweep % 2 = 0 THEN CAST(30 AS DOUBLE) + CAST(gate % 3 AS DOUBLE)
 WHEN {_C} = 10 THEN CAST(12 AS DOUBLE) + CAST(gate AS DOUBLE) / 3 + CAST(o % 4 AS DOUBLE) WHEN {_C} = 11 AND sweep % 3 = 0 THEN CAST(6 AS DOUBLE) + CAST(gate AS DOUBLE) / 4 + CAST(o % 3 AS DOUBLE) WHEN {_C} = 1 AND sweep % 4 < 2 THEN CAST(10 AS DOUBLE) + 12 * log10(CAST(gate + 1 AS DOUBLE)) + CAST(p % 3 AS DOUBLE)
 WHEN {_C} = 3 THEN CASE WHEN gate <= 24 THEN CAST(36 AS DOUBLE) - CAST(gate AS DOUBLE) / 8 ELSE CAST(o % 3 AS DOUBLE) END WHEN {_C} = 5 AND gate % 13 < 6 THEN CAST(28 AS DOUBLE) + CAST(o % 3 AS DOUBLE) WHEN {_C} = 7 AND gate BETWEEN 2 AND 9 THEN CAST(27 AS DOUBLE) + CAST(p % 3 AS DOUBLE)
 ELSE CAST(2 AS DOUBLE) + CAST(gate AS DOUBLE) / 16 + CAST(o % 7 AS DOUBLE) END"""
_RANGE = "CAST(gate * 2000 + 2000 AS DOUBLE)"
_MOMENTS = "CAST(o % 40 AS DOUBLE) / 80 + 0.5 AS rhohv, CAST(p % 30 AS DOUBLE) AS snr, CASE WHEN o % 13 <> 0 THEN CAST(o % 20 AS DOUBLE) / 20 END AS meteo_score, CASE WHEN p % 7 <> 0 THEN CAST(p % 10 AS DOUBLE) / 10 END AS weather_support, CAST(o % 11 AS DOUBLE) / 10 AS clutter_prior, p % 6 = 0 AS small_object, o % 4 AS pol_moments"
GATES_SQL = f"""g0 AS (SELECT {_AT.format(div="//")}, max(l_orderkey) AS o, max(l_partkey * 3 + l_suppkey) AS p FROM lineitem GROUP BY 1, 2, 3),
gates AS (SELECT sweep, ray, gate, {_RANGE} AS range_m, {_VALUE} AS dbzh, {_MOMENTS} FROM g0), v AS (SELECT * FROM gates WHERE dbzh IS NOT NULL)"""


def _lines(spark, sf_dir):
    from hydrolith.plans.views import split_columns

    return load(spark, sf_dir, "lineitem").selectExpr(*split_columns(_AT.format(div="DIV")), "l_orderkey AS o", "l_partkey * 3 + l_suppkey AS p")


def gates(spark, sf_dir):
    """The gates, dealt by sweep."""
    from hydrolith.plans.views import split_columns, spread

    line = _lines(spark, sf_dir)
    g = spread(line.groupBy("sweep", "ray", "gate").agg(F.max("o").alias("o"), F.max("p").alias("p")), "sweep", of=line)
    return g.selectExpr("sweep", "ray", "gate", f"{_RANGE} AS range_m", f"{_VALUE} AS dbzh", *split_columns(_MOMENTS))


#: What other times, radars and heights say of a ray; unknown for some.
_CONTEXT = "sweep, ray, CASE WHEN (ray + sweep) % 5 <> 0 THEN CAST((ray * 7 + sweep) % 11 AS DOUBLE) / 10 END AS persistence, CASE WHEN (ray * 3 + sweep) % 4 <> 0 THEN CAST((ray * 5 + sweep * 3) % 11 AS DOUBLE) / 10 END AS consistency, CAST((ray + sweep * 5) % 9 AS DOUBLE) / 8 AS vertical"


def context(spark, sf_dir):
    from hydrolith.plans.views import split_columns, spread

    line = _lines(spark, sf_dir)
    return spread(line.select("sweep", "ray").distinct(), "sweep", of=line).selectExpr(*split_columns(_CONTEXT))


def _run_sql(source: str, where: str) -> str:
    return f"(SELECT sweep, ray, max(n) AS n FROM (SELECT sweep, ray, k, count(*) AS n FROM (SELECT sweep, ray, gate - row_number() OVER (PARTITION BY sweep, ray ORDER BY gate) AS k FROM {source} WHERE {where}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"


_EVIDENCE_SQL = f"""{GATES_SQL},
b AS (SELECT a.*, n.baseline FROM v a LEFT JOIN (SELECT sweep, ray, gate, avg(dbzh) AS baseline FROM (SELECT sweep, (ray + 1) % 36 AS ray, gate, dbzh FROM v UNION ALL SELECT sweep, (ray + 35) % 36, gate, dbzh FROM v) GROUP BY 1, 2, 3) n USING (sweep, ray, gate)),
base AS (SELECT sweep, ray, count(*) AS valid_gates, median(abs(dbzh - baseline)) AS difference, median(dbzh) FILTER (WHERE gate < 10) - median(dbzh) FILTER (WHERE gate >= 30) AS fall, count(*) FILTER (WHERE dbzh >= 35) AS high, quantile_cont(dbzh - 20 * log10((gate + 1) / 1000), 0.75) - quantile_cont(dbzh - 20 * log10((gate + 1) / 1000), 0.25) AS iqr FROM b GROUP BY 1, 2),
sg AS (SELECT *, count(*) OVER (PARTITION BY sweep, ray, k) AS n FROM (SELECT *, gate - row_number() OVER (PARTITION BY sweep, ray ORDER BY gate) AS k FROM b WHERE dbzh - baseline >= 12)),
s AS (SELECT sweep, ray, count(DISTINCT k) AS segments, count(*) AS evidence_gates, max(range_m) AS far_m FROM sg WHERE n >= 4 GROUP BY 1, 2),
r AS (SELECT base.*, l.n AS longest_run, coalesce(segments, 0) AS segments, coalesce(evidence_gates, 0) AS evidence_gates, far_m, valid_gates / 40 >= 0.55 AND l.n >= 8 AND coalesce(difference >= 20, false) AS full_, valid_gates / 40 >= 0.4 AND high / valid_gates >= 0.6 AND coalesce(h.n, 0) >= 8 AND coalesce(fall <= -9, false) AND iqr <= 7 AND valid_gates > 1 AS broad
 FROM base JOIN {_run_sql("b", "true")} l USING (sweep, ray) LEFT JOIN {_run_sql("b", "dbzh >= 35")} h USING (sweep, ray) LEFT JOIN s USING (sweep, ray)),
cx AS (SELECT DISTINCT {_CONTEXT} FROM gates),
w AS (SELECT r.*, full_ OR broad AS dense, NOT full_ AND NOT broad AND segments > 0 AS weak, coalesce(consistency >= 0.6, false) AS veto, 1 + CASE WHEN vertical <= 0.2 THEN 1 ELSE 0 END + CASE WHEN persistence >= 0.6 THEN 1 ELSE 0 END + CASE WHEN consistency <= 0.2 THEN 1 ELSE 0 END AS votes FROM r JOIN cx USING (sweep, ray)),
evidence AS (SELECT sweep, ray, valid_gates, longest_run, difference, segments, evidence_gates, coalesce(fall, 0.0) AS "drop", CASE WHEN broad THEN 'broad' WHEN segments = 1 AND evidence_gates >= 0.5 * valid_gates AND fall >= 12 THEN 'reverse' WHEN segments >= 3 THEN 'intermittent' WHEN segments > 0 AND far_m <= 30000 THEN 'short_range' WHEN segments > 0 OR full_ THEN 'narrow' ELSE 'none' END AS type,
CAST(CASE WHEN dense OR weak AND NOT veto AND votes >= 2 THEN 0.95 WHEN weak THEN 0.5 ELSE 0.0 END AS DOUBLE) AS probability, dense, weak AND NOT veto AND votes >= 2 AS promoted, weak AND veto AS vetoed FROM w)"""


def evidence_rays(spark, sf_dir):
    return interference.radial_evidence(gates(spark, sf_dir), ["sweep"], RADIAL, context(spark, sf_dir))


@query("radial_interference", f"WITH {_EVIDENCE_SQL} SELECT * FROM evidence")
def radial_interference(spark, sf_dir):
    return evidence_rays(spark, sf_dir)


_MARKED_SQL = f"{_EVIDENCE_SQL}, marked AS (SELECT b.sweep, b.ray, b.gate, type, probability FROM b JOIN evidence e USING (sweep, ray) LEFT JOIN (SELECT sweep, ray, gate FROM sg WHERE n >= 4) i USING (sweep, ray, gate) WHERE probability > 0 AND (dense OR i.gate IS NOT NULL))"


@query("radial_gates", f"WITH {_MARKED_SQL} SELECT * FROM marked")
def radial_gates(spark, sf_dir):
    """The gates that the rays' evidence marks."""
    return interference.evidence_gates(gates(spark, sf_dir), evidence_rays(spark, sf_dir), ["sweep"], RADIAL)


_FANS_SQL = f"""{_MARKED_SQL},
fv AS (SELECT *, row_number() OVER (PARTITION BY sweep, ray ORDER BY gate) AS i, count(*) OVER (PARTITION BY sweep, ray) AS m FROM v),
fb AS (SELECT sweep, ray, count(*) AS n, count(*) FILTER (WHERE dbzh >= 21) AS high, max(range_m) / 80000 AS extent, median(dbzh) FILTER (WHERE gate >= 30) - median(dbzh) FILTER (WHERE gate < 10) AS growth,
 median(dbzh) FILTER (WHERE i > m - greatest(1, m // 4)) - median(dbzh) FILTER (WHERE i <= greatest(1, m // 4)) AS own, quantile_cont(dbzh - 20 * log10(range_m / 1000), 0.75) FILTER (WHERE range_m >= 20000) - quantile_cont(dbzh - 20 * log10(range_m / 1000), 0.25) FILTER (WHERE range_m >= 20000) AS iqr FROM fv GROUP BY 1, 2),
look AS (SELECT fb.sweep, fb.ray, extent, coalesce(fb.n / 40 >= 0.6 AND high / fb.n >= 0.4 AND coalesce(h.n, 0) >= 4 AND growth >= 5.5, false) AS like_fan, coalesce(fb.n / 40 >= 0.5 AND l.n >= 6 AND fb.n > 1 AND own >= 5.5, false) AS fills,
 coalesce(fb.n / 40 >= 0.5 AND l.n >= 6 AND high / fb.n >= 0.3 AND coalesce(h.n, 0) >= 4 AND fb.n > 1 AND own >= 5.5 AND iqr <= 5, false) AS edge_like FROM fb LEFT JOIN {_run_sql("v", "dbzh >= 21")} h USING (sweep, ray) JOIN {_run_sql("v", "true")} l USING (sweep, ray)),
every AS (SELECT sweep, ray, coalesce(probability >= 0.95, false) AS hard, extent, coalesce(like_fan, false) AS like_fan, coalesce(fills, false) AS fills, coalesce(edge_like, false) AS edge_like FROM (SELECT DISTINCT sweep, unnest(range(36)) AS ray FROM gates) LEFT JOIN evidence USING (sweep, ray) LEFT JOIN look USING (sweep, ray)),
gl AS (SELECT e.sweep, e.ray, min(CASE WHEN (h.ray - e.ray + 36) % 36 > 0 THEN (h.ray - e.ray + 36) % 36 ELSE 36 END) AS up, min(CASE WHEN (e.ray - h.ray + 36) % 36 > 0 THEN (e.ray - h.ray + 36) % 36 ELSE 36 END) AS down, count(*) AS seeds FROM every e JOIN every h ON h.sweep = e.sweep AND h.hard GROUP BY 1, 2),
closed AS (SELECT e.*, coalesce(NOT e.hard AND seeds >= 2 AND up + down - 1 <= 3 AND 2.0 / (up + down + 1.0) >= 0.3 AND (e.like_fan OR e.fills AND e.extent >= least(0.85, least(a.extent, z.extent) * 0.9)), false) AS closed FROM every e LEFT JOIN gl USING (sweep, ray) LEFT JOIN every a ON a.sweep = e.sweep AND a.ray = (e.ray + up) % 36 LEFT JOIN every z ON z.sweep = e.sweep AND z.ray = (e.ray - down + 36) % 36),
nx AS (SELECT e.sweep, e.ray, d, s, e.edge_like AND e.extent >= greatest(0.7, h.extent * 0.8) AS ok FROM every e JOIN (SELECT unnest([1, 1, 2, 2]) AS d, unnest([1, -1, 1, -1]) AS s) ON true JOIN every h ON h.sweep = e.sweep AND h.ray = (e.ray - d * s + 36) % 36 AND h.hard WHERE NOT e.hard),
xt AS (SELECT DISTINCT sweep, ray FROM nx WHERE d = 1 AND ok UNION SELECT n.sweep, n.ray FROM nx n JOIN every k ON k.sweep = n.sweep AND k.ray = (n.ray - n.s + 36) % 36 AND NOT k.hard JOIN nx f ON f.sweep = n.sweep AND f.ray = k.ray AND f.d = 1 AND f.s = n.s AND f.ok WHERE n.d = 2 AND n.ok),
fans AS (SELECT c.*, xt.ray IS NOT NULL AS extended FROM closed c LEFT JOIN xt USING (sweep, ray))"""


def fans(spark, sf_dir):
    r = interference.described(gates(spark, sf_dir), ["sweep"], 80_000.0, RADIAL, FANS, context(spark, sf_dir))
    return interference.extended_fans(interference.closed_fans(r, ["sweep"], RAYS, FANS), ["sweep"], RAYS, FANS)


@query("radial_fan_closure", f"WITH {_FANS_SQL} SELECT * FROM fans")
def radial_fan_closure(spark, sf_dir):
    """Gaps in fans of flagged rays that are closed, and rays at their ends taken in."""
    return fans(spark, sf_dir).drop("type", "probability", "dense")


@query(
    "range_signatures",
    f"""WITH {GATES_SQL}, q AS (SELECT *, 20 * log10(range_m / 1000) AS x, gate - row_number() OVER (PARTITION BY sweep, ray ORDER BY gate) AS k FROM v WHERE dbzh >= 5),
    n AS (SELECT *, count(*) OVER (PARTITION BY sweep, ray, k) AS n, row_number() OVER (PARTITION BY sweep, ray, k ORDER BY gate) AS i FROM q), m AS (SELECT *, greatest(3, n // 5) AS fifth, median(dbzh - x) OVER (PARTITION BY sweep, ray, k) AS intercept FROM n WHERE n >= 5),
    f AS (SELECT sweep, ray, min(gate) AS first_gate, count(*) AS n, max(intercept) AS intercept, median(dbzh) FILTER (WHERE i > n - fifth) - median(dbzh) FILTER (WHERE i <= fifth) AS growth, quantile_cont(abs(dbzh - intercept - x), 0.9) AS residual_p90,
     max(range_m) - min(range_m) AS span_m, max(x) - min(x) AS log_span, avg(CASE WHEN dbzh >= 18 THEN 1.0 ELSE 0.0 END) AS high FROM m GROUP BY sweep, ray, k)
    SELECT sweep, ray, first_gate, n, round(intercept, 6) AS intercept, growth, round(residual_p90, 6) AS residual_p90, span_m, span_m >= 8000 AND log_span >= 1 AND residual_p90 <= 4 AND growth >= 1 AND high >= 0.3 AS matches FROM f""",
)
def range_signatures(spark, sf_dir):
    s = interference.range_signatures(gates(spark, sf_dir), ["sweep"], SIGNATURE)
    return s.withColumns({c: F.round(c, 6) for c in ("intercept", "residual_p90")})


def _curve(c: str, knots: interference.Curve) -> str:
    """A piecewise line in SQL, flat beyond its ends."""
    lines = [f"WHEN {c} <= {knots[0][0]} THEN {knots[0][1]}"]
    for (a, p), (b, q) in zip(knots, knots[1:], strict=False):
        lines.append(f"WHEN {c} <= {b} THEN {p} + ({c} - {a}) / {b - a} * {q - p}")
    return f"CAST(CASE {' '.join(lines)} WHEN {c} IS NOT NULL THEN {knots[-1][1]} END AS DOUBLE)"


def _score(curves: tuple[interference.Curve, ...], weights: tuple[float, ...]) -> str:
    parts = [f"{w} * {_curve(c, k)}" for c, k, w in zip(("coverage", "delta", "texture", "spin"), curves, weights, strict=True) if w]
    return f"({' + '.join(parts)}) / {sum(weights)}"


_E = interference.Echo()
_ECHO_SQL = f"""{GATES_SQL}, a AS (SELECT *, CASE WHEN lead(gate) OVER o = gate + 1 THEN lead(dbzh) OVER o END AS nx, CASE WHEN lag(gate) OVER o = gate - 1 THEN lag(dbzh) OVER o END AS pv, dbzh - 20 * log10(range_m / 1000) AS corrected FROM v WINDOW o AS (PARTITION BY sweep, ray ORDER BY gate)),
t AS (SELECT *, (abs(dbzh - pv) + abs(nx - dbzh)) / 2 > 2 AS turn, CASE WHEN gate >= 36 THEN corrected END AS last FROM a),
e AS (SELECT sweep, ray, gate, dbzh, count(*) OVER w / 40 * 100 AS coverage, CASE WHEN count(nx) OVER s = 11 THEN sum((dbzh - nx) * (dbzh - nx)) OVER s / 11 END AS texture, CASE WHEN count(turn) OVER s = 11 THEN CAST(sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER s AS DOUBLE) END AS spin,
 CASE WHEN count(last) OVER w >= 4 THEN corrected - avg(last) OVER w END AS delta FROM t WINDOW w AS (PARTITION BY sweep, ray), s AS (PARTITION BY sweep, ray ORDER BY gate RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
echo AS (SELECT *, CASE WHEN texture > 3 THEN {_score(_E.rough, _E.rough_weights)} ELSE {_score(_E.smooth, _E.smooth_weights)} END AS score FROM e)"""


@query("echo_formula", f"WITH {_ECHO_SQL} SELECT sweep, ray, gate, round(coverage, 6) AS coverage, round(texture, 6) AS texture, spin, round(delta, 6) AS delta, round(score, 6) AS score FROM echo")
def echo_formula(spark, sf_dir):
    e = interference.echo_formula(gates(spark, sf_dir), ["sweep"], GATES)
    return e.select("sweep", "ray", "gate", *[F.round(c, 6).alias(c) for c in ("coverage", "texture")], "spin", *[F.round(c, 6).alias(c) for c in ("delta", "score")])


@query(
    "interference_decision",
    f"""WITH {_FANS_SQL}, {_ECHO_SQL[len(GATES_SQL) + 2:]}, j AS (SELECT e.sweep, e.ray, e.gate, e.dbzh, m.gate IS NOT NULL OR f.closed OR f.extended AS radial, coalesce(score >= 0.6, false) AS structure, g.* EXCLUDE (sweep, ray, gate, range_m, dbzh) FROM echo e JOIN fans f USING (sweep, ray) LEFT JOIN marked m ON m.sweep = e.sweep AND m.ray = e.ray AND m.gate = e.gate AND m.probability >= 0.95 JOIN gates g ON g.sweep = e.sweep AND g.ray = e.ray AND g.gate = e.gate),
    q AS (SELECT *, coalesce(meteo_score <= 0.35, false) AS low_meteo, coalesce(weather_support >= 0.7, false) AS weather, rhohv < 0.7 AS severe, snr < 3 AS low_snr FROM j WHERE dbzh >= -10)
    SELECT sweep, count(*) AS gates, count(*) FILTER (radial) AS radial, count(*) FILTER (structure) AS structure,
    count(*) FILTER (structure AND low_meteo AND NOT weather OR radial AND severe AND pol_moments >= 2 OR clutter_prior >= 0.7 AND low_meteo AND NOT weather OR small_object AND low_snr AND severe AND dbzh < 35 AND NOT weather) AS rejected FROM q GROUP BY 1""",
)
def interference_decision(spark, sf_dir):
    """What the detectors find, gate by gate, feeds the decision with the other
    moments of each gate."""
    f = fans(spark, sf_dir).withColumn("_fan", F.col("closed") | F.col("extended"))
    m = interference.marked(gates(spark, sf_dir), f, ["sweep"], RADIAL, "_fan")
    e = interference.echo_formula(m, ["sweep"], GATES)
    d = e.withColumns({"radial": F.coalesce(F.col("probability") >= RADIAL.flagged, F.lit(False)) | F.col("_fan"), "structure": F.coalesce(F.col("score") >= 0.6, F.lit(False)), "quality_cap": F.lit(None).cast("double")})
    d = evidence.decide(d).filter("dbzh >= -10")
    return d.groupBy("sweep").agg(F.count("*").alias("gates"), F.count_if("radial").alias("radial"), F.count_if("structure").alias("structure"), F.count_if(F.col("action") == "REJECT").alias("rejected"))
