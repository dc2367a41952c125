"""Range signatures and the broad source over the driver's tables, with SQL.

The sweeps of ``object_queries``; one in four has a ceiling, one a flat tail. Rays of
a source have steady moments, the others do not."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.operators import signatures
from hydrolith.plans.object_queries import _AT, _GATE, _SPIKE, _intervals_sql, GATES, RAYS, SPACING
from hydrolith.plans.registry import load, query

SIGNATURE = signatures.Signature(rays=RAYS, gates=GATES, spacing_m=SPACING, minimum_range_m=4000, echo_dbz=2.0, span_m=12_000, measured_m=8000, growth_db=1.0, log_span_db=2.0, high_dbz=25.0, high_fraction=0.5, gap_m=2000, gap_fraction=0.3, residual_p90_db=2.6, gate_residual_db=2.1, fit_span_m=6000, fit_samples=6, plateau_m=8000, plateau_dbz=35.0, width_deg=100, aspect=2.5, link_residual_db=12.2, link_gap_m=3000, link_fraction=0.3)
BROAD = signatures.Broad(rays=RAYS, spacing_m=SPACING, block_m=8000, minimum_range_m=8000, maximum_range_m=60_000, blocks=3, block_span_m=3000, reference_span_m=20_000, snr_db=15, samples=12, neighbour_deg=30, span_deg=15, neighbours=2, neighbour_db=5.1, plateau_m=8000, plateau_dbz=35, residual_db=3.6)

_OF_SOURCE = f"({_SPIKE} = 0 AND gate >= 8 OR {_SPIKE} = 1 AND gate BETWEEN 18 AND 47)"
_MORE = f"""sweep, ray, gate, range_m, CASE WHEN {_SPIKE} = 0 AND gate >= 8 AND sweep % 4 = 2 THEN least(dbzh, CAST(38 AS DOUBLE)) WHEN {_SPIKE} = 0 AND gate >= 46 AND sweep % 4 = 1 AND dbzh IS NOT NULL THEN CAST(45 AS DOUBLE) ELSE dbzh END AS dbzh,
 CASE WHEN sweep % 4 = 2 THEN CAST(CASE WHEN ray % 2 = 0 THEN 38 ELSE 30 END AS DOUBLE) END AS ceiling, rhohv, rhohv >= 0.97 AS protected, (o + gate) % 37 = 0 AS conflict,
 CAST(CASE WHEN {_OF_SOURCE} THEN 24 + o % 3 ELSE 4 + o % 10 END AS DOUBLE) AS snr, CAST(CASE WHEN {_OF_SOURCE} THEN 10 + p % 5 ELSE p % 40 - 20 END AS DOUBLE) / 10 AS zdr, CAST(CASE WHEN {_OF_SOURCE} THEN (174 + o % 13) % 360 ELSE o * 37 % 360 END AS DOUBLE) AS phidp"""
GATES_SQL = f"""g0 AS (SELECT {_AT.format(div="//")}, max(l_orderkey) AS o, max(l_partkey * 7 + l_suppkey) AS p FROM lineitem GROUP BY ALL), g1 AS (SELECT {_GATE}, o, p FROM g0), gates AS (SELECT {_MORE} FROM g1), v AS (SELECT *, 20 * log10(range_m / 1000) AS x FROM gates WHERE dbzh IS NOT NULL)"""


def gates(spark, sf_dir):
    from hydrolith.plans.views import split_columns, spread

    line = load(spark, sf_dir, "lineitem").selectExpr(*split_columns(_AT.format(div="DIV")), "l_orderkey AS o", "l_partkey * 7 + l_suppkey AS p")
    g = spread(line, "sweep").groupBy("sweep", "ray", "gate").agg(F.max("o").alias("o"), F.max("p").alias("p")).selectExpr(*split_columns(_GATE), "o", "p")
    return g.selectExpr(*split_columns(_MORE))


_W = "PARTITION BY sweep, ray, part"
_FIT_SQL = f"""{GATES_SQL}, e AS (SELECT *, dbzh >= 2 AND range_m >= 4000 AS echo FROM v), {_intervals_sql("sv", "e", "echo", "NOT echo", 2, 0.3)},
m0 AS (SELECT e.*, part, n, row_number() OVER (PARTITION BY e.sweep, e.ray, part ORDER BY gate) AS i FROM e JOIN sv ON sv.sweep = e.sweep AND sv.ray = e.ray AND e.gate BETWEEN first AND last WHERE last - first + 1 >= 12 AND n >= 8),
m1 AS (SELECT *, median(CASE WHEN i > n - 8 THEN dbzh END) OVER ({_W}) AS flat, max(CASE WHEN i > n - 8 THEN dbzh END) OVER ({_W}) - min(CASE WHEN i > n - 8 THEN dbzh END) OVER ({_W}) AS spread, max(dbzh) OVER ({_W}) AS top, max(range_m) OVER ({_W}) AS far FROM m0),
m2 AS (SELECT *, coalesce(max(CASE WHEN abs(dbzh - flat) > 0.01 THEN i END) OVER ({_W}), 0) + 1 AS f0 FROM m1),
m3 AS (SELECT *, CASE WHEN ceiling IS NOT NULL THEN 2 WHEN coalesce(flat >= 35 AND spread <= 0.02 AND far - max(CASE WHEN i = f0 THEN range_m END) OVER ({_W}) >= 8000 AND top <= flat + 0.26, false) THEN 3 ELSE 1 END AS mode FROM m2),
m4 AS (SELECT *, CASE mode WHEN 2 THEN ceiling WHEN 3 THEN flat END AS cap FROM m3), m5 AS (SELECT *, coalesce(dbzh >= cap - 0.26, false) AS cut FROM m4),
m6 AS (SELECT *, median(CASE WHEN NOT cut THEN dbzh - x END) OVER ({_W}) AS intercept, count(CASE WHEN NOT cut THEN x END) OVER ({_W}) AS free, max(CASE WHEN NOT cut THEN range_m END) OVER ({_W}) - min(CASE WHEN NOT cut THEN range_m END) OVER ({_W}) AS rs, max(CASE WHEN NOT cut THEN x END) OVER ({_W}) - min(CASE WHEN NOT cut THEN x END) OVER ({_W}) AS xs FROM m5),
m7 AS (SELECT *, CASE WHEN cut THEN greatest(cap - intercept - x, 0) ELSE abs(dbzh - intercept - x) END AS residual FROM m6),
m8 AS (SELECT *, quantile_cont(residual, 0.9) OVER ({_W}) AS p90_db, avg(CASE WHEN dbzh >= 25 THEN 1.0::DOUBLE ELSE 0 END) OVER ({_W}) AS high, median(CASE WHEN i > n - greatest(3, n // 5) THEN dbzh END) OVER ({_W}) - median(CASE WHEN i <= greatest(3, n // 5) THEN dbzh END) OVER ({_W}) AS growth FROM m7),
fits AS (SELECT *, CASE WHEN mode = 2 AND top > cap + 0.26 THEN 'over_ceiling' WHEN free < 6 THEN 'few_samples' WHEN rs < 6000 OR xs < 2 THEN 'short_range' WHEN p90_db > 2.6 THEN 'shape' WHEN growth < 1 THEN 'growth' WHEN high < 0.5 THEN 'weak' END AS why FROM m8)"""


@query("range_fits", f"WITH RECURSIVE {_FIT_SQL} SELECT sweep, ray, gate, CAST(part AS INTEGER) AS part, mode, cap, round(intercept, 6) AS intercept, round(residual, 6) AS residual, round(p90_db, 6) AS p90_db, round(growth, 6) AS growth, why FROM fits")
def range_fits(spark, sf_dir):
    f = signatures.fitted(gates(spark, sf_dir), ["sweep"], SIGNATURE)
    return f.select("sweep", "ray", "gate", "part", "mode", "cap", *[F.round(c, 6).alias(c) for c in ("intercept", "residual", "p90_db", "growth")], "why")


_GOOD = "residual <= 2.1"
_CROSS = "residual > 2.1 AND residual <= 12.2 AND NOT coalesce(protected, false)"
_RANGE_SQL = f"""{_FIT_SQL}, fk AS (SELECT * EXCLUDE (ray, part, n, i), ray AS true_ray, ray * 1000 + part AS ray FROM fits WHERE why IS NULL), {_intervals_sql("rv", "fk", _GOOD, f"NOT ({_GOOD}) AND NOT ({_CROSS})", 3, 0.3)},
rp AS (SELECT sweep, ray // 1000 AS ray, ray AS key, part, first, last, n, row_number() OVER (PARTITION BY sweep ORDER BY ray // 1000, first) AS id FROM rv WHERE n >= 8),
re AS (SELECT a.sweep, a.id AS a, b.id AS b FROM rp a JOIN rp b ON b.sweep = a.sweep AND (b.ray = (a.ray + 1) % 24 OR a.ray = (b.ray + 1) % 24) AND least(a.last, b.last) >= greatest(a.first, b.first)),
rl(sweep, id, least) USING KEY (sweep, id) AS (SELECT sweep, id, id FROM rp UNION SELECT re.sweep, re.b, min(rl.least) FROM rl JOIN re ON re.sweep = rl.sweep AND re.a = rl.id JOIN recurring.rl AS n ON n.sweep = re.sweep AND n.id = re.b WHERE rl.least < n.least GROUP BY 1, 2),
ro AS (SELECT rp.*, dense_rank() OVER (PARTITION BY rp.sweep ORDER BY least) AS object FROM rp JOIN rl ON rl.sweep = rp.sweep AND rl.id = rp.id),
rg AS (SELECT f.sweep, f.true_ray AS ray, f.gate, o.object, f.mode, f.p90_db, f.growth, NOT ({_GOOD}) AS linked, f.range_m FROM fk f JOIN ro o ON o.sweep = f.sweep AND o.key = f.ray AND f.gate BETWEEN o.first AND o.last WHERE ({_GOOD}) OR ({_CROSS})),
rw AS (SELECT sweep, object, CAST((24 - max(after) + 1) * 15 AS DOUBLE) AS width_deg, CAST(count(*) AS INTEGER) AS rays FROM (SELECT sweep, object, ray, coalesce(lead(ray) OVER w, min(ray) OVER (PARTITION BY sweep, object) + 24) - ray AS after FROM (SELECT DISTINCT sweep, object, ray FROM ro) WINDOW w AS (PARTITION BY sweep, object ORDER BY ray)) GROUP BY ALL),
rs0 AS (SELECT sweep, object, min(first) AS first, max(last) AS last, CAST(max(last - first + 1) * 1000 AS DOUBLE) AS span_m FROM ro GROUP BY ALL),
rs1 AS (SELECT sweep, object, min(range_m) AS near, max(range_m) AS far, max(p90_db) AS p90_db, count(*) AS gates, list_sort(list(DISTINCT mode)) AS modes FROM rg WHERE NOT linked GROUP BY ALL),
rk AS (SELECT sweep, object, rays, width_deg, first, last, span_m, span_m / greatest(1000, (near + far) / 2 * radians(width_deg)) AS aspect, gates, p90_db, modes FROM rs0 JOIN rs1 USING (sweep, object) JOIN rw USING (sweep, object) WHERE width_deg <= 100 AND span_m / greatest(1000, (near + far) / 2 * radians(width_deg)) >= 2.5)"""


@query("range_objects", f"WITH RECURSIVE {_RANGE_SQL} SELECT sweep, object, rays, width_deg, first, last, span_m, round(aspect, 6) AS aspect, gates, round(p90_db, 6) AS p90_db, array_to_string(modes, ',') AS modes FROM rk")
def range_objects(spark, sf_dir):
    o = signatures.range_objects(gates(spark, sf_dir), ["sweep"], SIGNATURE)[0]
    return o.withColumns({"aspect": F.round("aspect", 6), "p90_db": F.round("p90_db", 6), "modes": F.array_join(F.col("modes").cast("array<string>"), ",")})


@query("range_object_gates", f"WITH RECURSIVE {_RANGE_SQL} SELECT sweep, ray, gate, object, mode, round(rg.p90_db, 6) AS p90_db, round(growth, 6) AS growth, linked FROM rg SEMI JOIN rk USING (sweep, object)")
def range_object_gates(spark, sf_dir):
    g = signatures.range_objects(gates(spark, sf_dir), ["sweep"], SIGNATURE)[1]
    return g.withColumns({"p90_db": F.round("p90_db", 6), "growth": F.round("growth", 6)})


def _flat_sql(name: str, source: str, by: str) -> str:
    return f"""{name}_a AS (SELECT *, sum(CASE WHEN coalesce(same, false) THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY gate) AS run FROM (SELECT *, gate - lag(gate) OVER w = 1 AND abs(dbzh - lag(dbzh) OVER w) < 1e-6 AND dbzh >= 35 AS same FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY gate))),
{name} AS (SELECT * EXCLUDE (same, run), count(*) OVER (PARTITION BY {by}, run) > 1 AND max(range_m) OVER (PARTITION BY {by}, run) - min(range_m) OVER (PARTITION BY {by}, run) >= 8000 AS plateau FROM {name}_a)"""


_T = "PARTITION BY sweep, ray, t"
_BROAD_SQL = f"""{GATES_SQL}, {_flat_sql("pl", "v", "sweep, ray")},
me AS (SELECT *, dbzh - x AS power, CAST(floor((range_m - 8000) / 8000) AS INTEGER) AS block FROM pl WHERE snr >= 8 AND rhohv IS NOT NULL AND zdr IS NOT NULL AND phidp IS NOT NULL AND range_m >= 8000 AND range_m < 60000),
me0 AS (SELECT * EXCLUDE (plateau) FROM me), {_flat_sql("rf", "me0", "sweep, ray, block")},
t0 AS (SELECT *, count(*) OVER (PARTITION BY sweep, ray, t, block) AS nb FROM (SELECT rf.*, t FROM rf, range(7) r(t) WHERE abs(t - block) > 1 AND NOT plateau)),
t1 AS (SELECT *, median(power) OVER ({_T}) AS intercept, degrees(atan2(avg(sin(radians(phidp))) OVER ({_T}), avg(cos(radians(phidp))) OVER ({_T}))) AS phase_deg, median(zdr) OVER ({_T}) AS zm FROM t0 WHERE nb >= 3),
t2 AS (SELECT *, (phidp - phase_deg + 180) - 360 * floor((phidp - phase_deg + 180) / 360) - 180 AS pc FROM t1),
bl AS (SELECT sweep, ray, t, count(*) AS n_blocks, max(mid) AS snr_mid, quantile_cont(abs(m - mid), 0.9) AS steady FROM (SELECT *, median(m) OVER ({_T}) AS mid FROM (SELECT sweep, ray, t, block, median(snr) AS m FROM t2 GROUP BY ALL)) GROUP BY ALL),
f0 AS (SELECT sweep, ray, t, max(intercept) AS intercept, max(phase_deg) AS phase_deg, count(*) AS samples, max(range_m) - min(range_m) AS span, quantile_cont(abs(power - intercept), 0.9) AS p90_db, quantile_cont(abs(pc), 0.9) AS pp, quantile_cont(abs(zdr - zm), 0.9) AS zp,
 quantile_cont(pc, 0.05) AS p0, quantile_cont(pc, 0.95) AS p1, quantile_cont(zdr, 0.05) AS z0, quantile_cont(zdr, 0.95) AS z1, quantile_cont(rhohv, 0.05) AS h0, quantile_cont(rhohv, 0.95) AS h1, quantile_cont(snr, 0.05) AS s0, quantile_cont(snr, 0.95) AS s1 FROM t2 GROUP BY ALL),
f1 AS (SELECT * FROM f0 JOIN bl USING (sweep, ray, t) WHERE n_blocks >= 3 AND samples >= 12 AND span >= 20000 AND p90_db <= 3.6 AND snr_mid >= 15 AND steady <= 2 AND pp <= 10 AND zp <= 1),
nr AS (SELECT a.sweep, a.ray, a.t, d FROM f1 a JOIN (SELECT unnest([1, 2, -1, -2]) AS d) ON true JOIN f1 b ON b.sweep = a.sweep AND b.t = a.t AND b.ray = (a.ray + d + 24) % 24 AND abs(b.intercept - a.intercept) <= 5.1),
sd AS (SELECT sweep, ray, t, CASE WHEN bool_or(d = 1) THEN CASE WHEN bool_or(d = 2) THEN 2 ELSE 1 END ELSE 0 END AS "right", CASE WHEN bool_or(d = -1) THEN CASE WHEN bool_or(d = -2) THEN 2 ELSE 1 END ELSE 0 END AS "left" FROM nr GROUP BY ALL),
folds AS (SELECT f1.*, CAST(coalesce("left", 0) AS INTEGER) AS "left", CAST(coalesce("right", 0) AS INTEGER) AS "right", coalesce("left", 0) + coalesce("right", 0) >= 1 AS agrees FROM f1 LEFT JOIN sd USING (sweep, ray, t))"""


@query("broad_folds", f'WITH {_BROAD_SQL} SELECT sweep, ray, CAST(t AS INTEGER) AS t, n_blocks, samples, round(intercept, 6) AS intercept, round(phase_deg, 6) AS phase_deg, round(p90_db, 6) AS p90_db, "left", "right", agrees FROM folds')
def broad_folds(spark, sf_dir):
    f = signatures.broad_folds(gates(spark, sf_dir), ["sweep"], BROAD)
    return f.select("sweep", "ray", "t", "n_blocks", "samples", *[F.round(c, 6).alias(c) for c in ("intercept", "phase_deg", "p90_db")], "left", "right", "agrees")


@query(
    "broad_source",
    f"""WITH {_BROAD_SQL}, q AS (SELECT me.*, f.intercept, agrees, power - f.intercept AS delta, agrees AND abs(power - f.intercept) <= 3.6 AND me.snr BETWEEN s0 - 1 AND s1 + 1 AND (me.phidp - phase_deg + 180) - 360 * floor((me.phidp - phase_deg + 180) / 360) - 180 BETWEEN p0 - 0.5 AND p1 + 0.5
     AND me.zdr BETWEEN z0 - 0.125 AND z1 + 0.125 AND me.rhohv BETWEEN greatest(0, h0 - 0.01) AND least(1, h1 + 0.01) AS matched FROM me JOIN folds f ON f.sweep = me.sweep AND f.ray = me.ray AND f.t = me.block)
    SELECT sweep, ray, gate, block, CASE WHEN agrees THEN round(delta, 6) END AS residual_db, 1 | CASE WHEN agrees THEN 2 ELSE 0 END | CASE WHEN matched THEN 4 ELSE 0 END | CASE WHEN agrees AND NOT matched THEN 16 ELSE 0 END | CASE WHEN coalesce(protected, false) THEN 8 ELSE 0 END | CASE WHEN plateau THEN 32 ELSE 0 END AS reason,
    matched AND NOT coalesce(protected, false) AND NOT coalesce(conflict, false) AND NOT plateau AS candidate FROM q""",
)
def broad_source(spark, sf_dir):
    return signatures.broad_source(gates(spark, sf_dir), ["sweep"], BROAD).withColumn("residual_db", F.round("residual_db", 6))
