"""Radial objects, hypotheses and fragments over the driver's tables, with SQL.

A sweep is 1,250 orders: 24 rays of 60 gates, a kilometre each. Two of eight rays
carry a source's spike, whole or in part; some sweeps have rain, which holds some of
the spikes; some gates are missing, and every row's numbers scatter the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.operators import objects
from hydrolith.plans.registry import load, query

RAYS, GATES, SPACING = 24, 60, 1000.0
OBJECTS = objects.Objects(rays=RAYS, gates=GATES, spacing_m=SPACING, minimum_range_m=4000, segment_m=6000, gap_m=2000, gap_fraction=0.25, window_m=5000, support=0.6, offsets_deg=(15.0, 30.0, 45.0), rough=True, own_span_m=15_000, aspect=1.2, width_deg=40, contrast_fraction=0.95, rough_fraction=0.6, overlap_m=2000, edge_m=4000, review=True)
GRAPH = objects.Graph(rays=RAYS, gates=GATES, spacing_m=SPACING, minimum_range_m=4000, echo_dbz=0.0, offsets_deg=(15.0, 30.0), atom_m=3000, gap_m=3000, gap_fraction=0.3, bundle_deg=45, narrow_deg=15, span_m=8000, measured_m=6000, aspect=0.7, model_m=8000, model_deg=15, model_p90_db=5.0, shoulder_fraction=0.6, far_m=40_000)
FRAGMENTS = objects.Fragments(spacing_m=SPACING, minimum_range_m=4000, echo_dbz=0.0, anchor_m=4000, distance_m=5000, difference_db=4.0)

_AT = "l_orderkey {div} 1250 AS sweep, l_partkey % 24 AS ray, (l_suppkey * 7 + l_linenumber * 13 + l_orderkey * 3) % 60 AS gate"
_SPIKE = "(ray + sweep * 5) % 8"
_GATE = f"""sweep, ray, gate, CAST((gate + 1) * 1000 AS DOUBLE) AS range_m,
 CASE WHEN (gate * 7 + ray * 3 + sweep) % 29 = 5 OR (p + o) % 41 = 0 THEN NULL
  WHEN {_SPIKE} = 0 AND gate >= 8 THEN 8 + 20 * log10(CAST(gate + 1 AS DOUBLE)) + CAST((o + p) % 5 AS DOUBLE) / 2 + CASE WHEN (gate + ray + sweep) % 13 = 0 THEN -9 ELSE 0 END
  WHEN {_SPIKE} = 1 AND gate BETWEEN 18 AND 47 THEN 6 + 20 * log10(CAST(gate + 1 AS DOUBLE)) + CAST((o * 3 + p) % 7 AS DOUBLE)
  WHEN {_SPIKE} = 2 AND sweep % 4 = 3 AND gate BETWEEN 20 AND 44 THEN 12 + 20 * log10(CAST(gate + 1 AS DOUBLE)) + CAST((o + p) % 9 AS DOUBLE)
  WHEN {_SPIKE} = 4 AND gate % 20 BETWEEN 3 AND 12 AND sweep % 2 = 1 THEN 24 + CAST(p % 9 AS DOUBLE)
  WHEN ray BETWEEN 10 AND 16 AND gate BETWEEN 15 AND 40 AND sweep % 3 <> 1 THEN 22 + CAST(o % 9 AS DOUBLE) / 2
  ELSE -9 + CAST((o + p * 3) % 13 AS DOUBLE) END AS dbzh,
 CASE WHEN o % 23 = 0 THEN NULL WHEN {_SPIKE} = 0 AND gate >= 8 AND gate NOT BETWEEN 30 AND 32 THEN 0.7 + CAST(p % 20 AS DOUBLE) / 100 WHEN {_SPIKE} IN (1, 2) AND gate BETWEEN 18 AND 47 THEN 0.83 + CAST(o % 13 AS DOUBLE) / 100
  WHEN {_SPIKE} = 4 THEN 0.86 + CAST(p % 8 AS DOUBLE) / 100 ELSE 0.9 + CAST(o % 10 AS DOUBLE) / 100 END AS rhohv,
 {_SPIKE} IN (0, 1) AND p % 3 <> 0 AND gate >= 8 AS pol_bad, ray BETWEEN 10 AND 16 AND gate BETWEEN 15 AND 40 AND sweep % 3 <> 1 AS weather, {_SPIKE} = 0 AND gate % 30 < 12 AS parent, (o + gate) % 17 <> 0 AS donor, p % 10 <> 0 AS reliable,
 CASE WHEN {_SPIKE} = 0 AND gate % 30 = 20 THEN 'REJECT' WHEN (o + p) % 31 = 0 THEN 'DOWNWEIGHT' ELSE 'KEEP' END AS old_action, {_SPIKE} = 1 AND gate > 40 AS plateau, {_SPIKE} IN (0, 4) AND gate % 15 < 6 AS anchor, {_SPIKE} = 0 AS grows"""
GATES_SQL = f"""g0 AS (SELECT {_AT.format(div="//")}, max(l_orderkey) AS o, max(l_partkey * 7 + l_suppkey) AS p FROM lineitem GROUP BY ALL), gates AS (SELECT {_GATE} FROM g0), v AS (SELECT * FROM gates WHERE dbzh IS NOT NULL)"""


def gates(spark, sf_dir):
    from hydrolith.plans.views import split_columns, spread

    line = load(spark, sf_dir, "lineitem").selectExpr(*split_columns(_AT.format(div="DIV")), "l_orderkey AS o", "l_partkey * 7 + l_suppkey AS p")
    return spread(line, "sweep").groupBy("sweep", "ray", "gate").agg(F.max("o").alias("o"), F.max("p").alias("p")).selectExpr(*split_columns(_GATE))


def _turn(ray: str, n: int) -> str:
    return f"(({ray} + {n % RAYS}) % {RAYS})"


def _shoulders_sql(name: str, source: str, offsets: tuple[float, ...], donor: str) -> str:
    """Contrast with both gates beside, at each offset, by self joins."""
    steps = [round(d * RAYS / 360) for d in offsets]
    joins = " ".join(f"LEFT JOIN {source} {s}{n} ON {s}{n}.sweep = g.sweep AND {s}{n}.gate = g.gate AND {s}{n}.ray = {_turn('g.ray', n if s == 'a' else -n)} AND {s}{n}.dbzh IS NOT NULL{donor.format(t=f'{s}{n}')}" for n in steps for s in "ab")
    both = ", ".join(f"CASE WHEN a{n}.dbzh IS NOT NULL AND b{n}.dbzh IS NOT NULL THEN g.dbzh - greatest(a{n}.dbzh, b{n}.dbzh) END" for n in steps)
    one = " OR ".join(f"(a{n}.dbzh IS NULL) <> (b{n}.dbzh IS NULL)" for n in steps)
    return f"{name} AS (SELECT g.*, greatest({both}) AS contrast, {one} AS one_sided FROM {source} g {joins})"


def _intervals_sql(name: str, source: str, seed: str, blocked: str, gap: int, fraction: float) -> str:
    """Runs of seeds, bridged one after another along each ray."""
    return f"""{name}_s AS (SELECT *, sum(CASE WHEN ({blocked}) AND NOT ({seed}) THEN 1 ELSE 0 END) OVER (PARTITION BY sweep, ray ORDER BY gate) AS blocks FROM {source}),
{name}_r AS (SELECT sweep, ray, min(gate) AS first, max(gate) AS last, count(*) AS n, max(blocks) AS b, row_number() OVER (PARTITION BY sweep, ray ORDER BY min(gate)) AS i FROM (SELECT *, gate - row_number() OVER (PARTITION BY sweep, ray ORDER BY gate) AS k FROM {name}_s WHERE {seed}) GROUP BY sweep, ray, k),
{name}_f AS (SELECT sweep, ray, i, 0 AS part, first, last, n, b FROM {name}_r WHERE i = 1 UNION ALL
 SELECT sweep, ray, i, CASE WHEN j THEN part ELSE part + 1 END, CASE WHEN j THEN f0 ELSE first END, last, CASE WHEN j THEN n0 + n ELSE n END, b FROM (
  SELECT r.*, f.part, f.first AS f0, f.n AS n0, r.first - f.last - 1 <= {gap} AND r.b = f.b AND 1 - (f.n + r.n) / (r.last - f.first + 1) <= {fraction} + 1e-12 AS j FROM {name}_f f JOIN {name}_r r ON r.sweep = f.sweep AND r.ray = f.ray AND r.i = f.i + 1)),
{name} AS (SELECT sweep, ray, CAST(part AS INTEGER) AS part, min(first) AS first, max(last) AS last, max(n) AS n FROM {name}_f GROUP BY sweep, ray, part)"""


_SEEDS_SQL = f"""{GATES_SQL}, {_shoulders_sql("sh", "v", OBJECTS.offsets_deg, "")},
ax AS (SELECT *, count(*) OVER w / (least(gate + 2, 59) - greatest(gate - 2, 0) + 1) AS support, stddev_pop(corrected) OVER w AS axial_std FROM (SELECT *, dbzh - 20 * log10(range_m / 1000) AS corrected FROM sh) WINDOW w AS (PARTITION BY sweep, ray ORDER BY gate RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
fl AS (SELECT *, dbzh >= 5 AND range_m >= 4000 AS echo, coalesce(rhohv < 0.9, false) AS low, coalesce(rhohv >= 0.95, false) AS protected, coalesce(contrast >= 10, false) AS stands, support >= 0.6 AND axial_std <= 4 AS smooth, support >= 0.6 AND axial_std <= 10 AS rough FROM ax),
seeds AS (SELECT *, echo AND NOT protected AND (smooth OR rough) AND (stands OR low) AS seed FROM fl)"""


def seeds(spark, sf_dir):
    return objects.object_seeds(gates(spark, sf_dir), ["sweep"], OBJECTS)


@query("object_seeds", f"WITH {_SEEDS_SQL} SELECT sweep, ray, gate, round(contrast, 6) AS contrast, round(support, 6) AS support, round(axial_std, 6) AS axial_std, echo, low, protected, stands, smooth, rough, seed FROM seeds")
def object_seeds(spark, sf_dir):
    s = seeds(spark, sf_dir)
    return s.select("sweep", "ray", "gate", *[F.round(c, 6).alias(c) for c in ("contrast", "support", "axial_std")], "echo", "low", "protected", "stands", "smooth", "rough", "seed")


_BRIDGED_SQL = _intervals_sql("iv", "seeds", "seed", "protected", 2, 0.25)


@query("bridged_intervals", f"WITH RECURSIVE {_SEEDS_SQL}, {_BRIDGED_SQL} SELECT * FROM iv")
def bridged_intervals(spark, sf_dir):
    return objects.intervals(seeds(spark, sf_dir), ["sweep", "ray"], F.col("seed"), F.col("protected"), 2, 0.25)


_OBJECTS_SQL = f"""{_SEEDS_SQL}, {_BRIDGED_SQL}, long AS (SELECT * FROM iv WHERE n >= 6),
mem AS (SELECT s.*, l.part, l.first, l.last, l.n, row_number() OVER (PARTITION BY s.sweep, s.ray, part ORDER BY gate) AS i, coalesce(gate - lag(gate) OVER (PARTITION BY s.sweep, s.ray, part ORDER BY gate) - 1, 0) AS hole FROM seeds s JOIN long l ON l.sweep = s.sweep AND l.ray = s.ray AND s.gate BETWEEN l.first AND l.last WHERE seed),
st AS (SELECT sweep, ray, part, first, last, n, min(range_m) AS near_m, max(range_m) AS far_m, max(hole) AS hole, avg(CAST(stands AS INTEGER)) AS c, avg(CAST(low AS INTEGER)) AS low, avg(CAST(rough AS INTEGER)) AS r, stddev_pop(corrected) AS std,
 median(dbzh) FILTER (i > n - greatest(1, n // 5)) - median(dbzh) FILTER (i <= greatest(1, n // 5)) AS growth FROM mem GROUP BY ALL),
has AS (SELECT *, c >= 0.95 AS has_contrast, r >= 0.6 AND low >= 0.6 AS has_rough, last - first + 1 >= 15 AND std <= 6 AND growth >= 3 AND low >= 0.8 AS has_own FROM st),
ok AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY ray, first) AS id FROM has WHERE has_contrast OR has_rough OR has_own),
ed AS (SELECT a.sweep, a.id AS a, b.id AS b FROM ok a JOIN ok b ON b.sweep = a.sweep AND (b.ray = (a.ray + 1) % 24 OR a.ray = (b.ray + 1) % 24) AND least(a.last, b.last) - greatest(a.first, b.first) + 1 >= 2),
lb(sweep, id, least) USING KEY (sweep, id) AS (SELECT sweep, id, id FROM ok UNION SELECT ed.sweep, ed.b, min(lb.least) FROM lb JOIN ed ON ed.sweep = lb.sweep AND ed.a = lb.id JOIN recurring.lb AS n ON n.sweep = ed.sweep AND n.id = ed.b WHERE lb.least < n.least GROUP BY 1, 2),
ob AS (SELECT ok.*, dense_rank() OVER (PARTITION BY ok.sweep ORDER BY least) AS object FROM ok JOIN lb ON lb.sweep = ok.sweep AND lb.id = ok.id),
wi AS (SELECT sweep, object, (24 - max(after) + 1) * 15.0 AS width_deg, count(*) AS rays FROM (SELECT sweep, object, ray, coalesce(lead(ray) OVER w, min(ray) OVER (PARTITION BY sweep, object) + 24) - ray AS after FROM (SELECT DISTINCT sweep, object, ray FROM ob) WINDOW w AS (PARTITION BY sweep, object ORDER BY ray)) GROUP BY ALL),
og AS (SELECT sweep, object, min(first) AS first, max(last) AS last, CAST(max(last - first + 1) * 1000 AS DOUBLE) AS span_m, CAST(sum(n) AS BIGINT) AS seeds, CAST(max(hole) * 1000 AS DOUBLE) AS longest_hole_m, bool_or(has_own) AS has_own, bool_or(has_contrast) AS has_contrast, bool_or(has_rough) AS has_rough, min(near_m) AS near_m, max(far_m) AS far_m FROM ob GROUP BY ALL),
kept AS (SELECT og.*, rays, CAST(width_deg AS DOUBLE) AS width_deg, span_m / greatest(1000, (near_m + far_m) / 2 * radians(width_deg)) AS aspect FROM og JOIN wi USING (sweep, object)),
objs AS (SELECT * FROM kept WHERE width_deg <= 40 AND aspect >= 1.2),
inside AS (SELECT s.sweep, s.ray, s.gate, o.object, NOT seed AS linked, has_own AND seed AS own FROM seeds s JOIN (SELECT ob.sweep, ob.ray, ob.object, ob.first, ob.last, ob.has_own FROM ob JOIN objs USING (sweep, object)) o ON o.sweep = s.sweep AND o.ray = s.ray AND s.gate BETWEEN o.first AND o.last WHERE seed OR echo AND NOT protected)"""


@query(
    "radial_objects",
    f"""WITH RECURSIVE {_OBJECTS_SQL} SELECT sweep, object, CAST(rays AS INTEGER) AS rays, width_deg, first, last, span_m, round(aspect, 6) AS aspect, seeds, linked, longest_hole_m, has_own, has_contrast, has_rough FROM objs JOIN (SELECT sweep, object, count(*) FILTER (linked) AS linked FROM inside GROUP BY ALL) USING (sweep, object)""",
)
def radial_objects(spark, sf_dir):
    o, _ = objects.radial_objects(seeds(spark, sf_dir), ["sweep"], OBJECTS)
    return o.withColumn("aspect", F.round("aspect", 6)).drop("has_high_rho")


_MEMBERS_SQL = f"""{_OBJECTS_SQL}, mb AS (SELECT i.*, has_rough AS rough, corrected FROM inside i JOIN ob ON ob.sweep = i.sweep AND ob.ray = i.ray AND ob.object = i.object AND i.gate BETWEEN ob.first AND ob.last JOIN seeds s ON s.sweep = i.sweep AND s.ray = i.ray AND s.gate = i.gate),
en AS (SELECT sweep, ray, object, side, CASE WHEN side < 0 THEN min(gate) ELSE max(gate) END AS o, median(corrected) FILTER (CASE WHEN side < 0 THEN i <= 5 ELSE i > n - 5 END) AS m FROM (SELECT *, row_number() OVER (PARTITION BY sweep, ray, object ORDER BY gate) AS i, count(*) OVER (PARTITION BY sweep, ray, object) AS n FROM mb), (VALUES (-1), (1)) AS d(side) GROUP BY sweep, ray, object, side),
es AS (SELECT e.*, k, s.gate IS NULL AS lost, CASE WHEN b.gate IS NOT NULL THEN true WHEN s.gate IS NOT NULL THEN NOT s.echo OR NOT s.low OR abs(s.corrected - m) > 4 END AS bad FROM (SELECT *, o + side * k AS gate FROM en, range(1, 3) AS t(k)) e LEFT JOIN seeds s ON s.sweep = e.sweep AND s.ray = e.ray AND s.gate = e.gate LEFT JOIN mb b ON b.sweep = e.sweep AND b.ray = e.ray AND b.gate = e.gate WHERE e.gate BETWEEN 0 AND 59),
ew AS (SELECT *, coalesce(bad, k - coalesce(max(k) FILTER (NOT lost) OVER w, 0) > 2 OR count(*) FILTER (lost) OVER w > 2 * 0.25) AS wrong FROM es WINDOW w AS (PARTITION BY sweep, ray, object, side ORDER BY k)),
er AS (SELECT *, min(object) OVER (PARTITION BY sweep, ray, gate) < object AS late FROM (SELECT *, bool_or(wrong) OVER (PARTITION BY sweep, ray, object, side ORDER BY k) AS stop FROM ew) WHERE NOT stop AND NOT lost),
al AS (SELECT sweep, ray, gate, object, linked, own, rough, false AS edge FROM mb UNION ALL SELECT sweep, ray, gate, object, true, false, false, true FROM (SELECT *, bool_or(late) OVER (PARTITION BY sweep, ray, object, side ORDER BY k) AS gone FROM er) WHERE NOT gone),
pe AS (SELECT sweep, ray, gate FROM seeds SEMI JOIN (SELECT sweep, ray + a AS ray, gate + b AS gate FROM al, range(-1, 2) AS t(a), range(-2, 3) AS u(b)) USING (sweep, ray, gate) ANTI JOIN al USING (sweep, ray, gate) WHERE echo AND support >= 0.6 AND NOT protected AND (rough OR stands OR low))"""


@query("object_members", f"WITH RECURSIVE {_MEMBERS_SQL} SELECT *, false AS review FROM al UNION ALL SELECT sweep, ray, gate, 0, false, false, false, false, true FROM pe")
def object_members(spark, sf_dir):
    """Members of objects, what these gain beyond their ends, and what is to be checked
    around them. Seeds and members are stored, and dealt by sweep again."""
    from hydrolith.plans.views import spread
    from hydrolith.sources.shared import stored

    s = spread(stored(seeds(spark, sf_dir)), "sweep")
    inner = spread(stored(objects.radial_objects(s, ["sweep"], OBJECTS)[1]), "sweep")
    return objects.object_gates(s, inner, ["sweep"], OBJECTS).drop("high_rho")


@query("object_edges")
def object_edges(spark, sf_dir):
    """What objects gain beyond their ends."""
    s = seeds(spark, sf_dir)
    return objects.with_edges(s, objects.radial_objects(s, ["sweep"], OBJECTS)[1], ["sweep"], OBJECTS).filter("edge").select("sweep", "ray", "gate", "object")


@query("object_growth")
def object_growth(spark, sf_dir):
    """Gates of low correlation that confirmed seeds reach within their object."""
    s = seeds(spark, sf_dir)
    inner = objects.radial_objects(s, ["sweep"], OBJECTS)[1].select("sweep", "ray", "gate", "object")
    g = s.join(inner, ["sweep", "ray", "gate"], "left").select("sweep", "ray", "gate", F.coalesce("object", F.lit(0)).alias("object"), (F.coalesce(F.col("rhohv") < 0.74, F.lit(False)) & F.col("object").isNotNull()).alias("seed"), F.coalesce(F.col("rhohv") < 0.85, F.lit(False)).alias("allowed"))
    return objects.grown(g, ["sweep"], RAYS, 3)


def _widths_sql(name: str, source: str, where: str, column: str) -> str:
    return f"""{name}_r AS (SELECT *, count(*) OVER (PARTITION BY sweep, gate, k) AS n, min(ray) OVER (PARTITION BY sweep, gate, k) AS lo, max(ray) OVER (PARTITION BY sweep, gate, k) AS hi FROM (SELECT sweep, ray, gate, ray - row_number() OVER (PARTITION BY sweep, gate ORDER BY ray) AS k FROM {source} WHERE {where})),
{name}_w AS (SELECT a.sweep, a.ray, a.gate, CASE WHEN n < 24 AND (lo = 0 OR hi = 23) AND h.head IS NOT NULL AND h.tail IS NOT NULL THEN head + tail ELSE n END * 15.0 AS {column} FROM {name}_r a JOIN (SELECT sweep, gate, max(n) FILTER (lo = 0) AS head, max(n) FILTER (hi = 23) AS tail FROM {name}_r GROUP BY ALL) h USING (sweep, gate)),
{name} AS (SELECT s.*, w.{column} FROM {source} s LEFT JOIN {name}_w w ON w.sweep = s.sweep AND w.ray = s.ray AND w.gate = s.gate)"""


_R = objects.REASONS
_GRAPH_SQL = f"""{GATES_SQL}, {_shoulders_sql("hs", "v", GRAPH.offsets_deg, " AND {t}.donor")},
h0 AS (SELECT *, dbzh >= 0 AND range_m >= 4000 AS echo, weather AND NOT pol_bad AS protected, coalesce(contrast >= 8, false) AS stands, dbzh - 20 * log10(range_m / 1000) AS corrected FROM hs),
h1 AS (SELECT *, echo AND NOT protected AND (stands OR parent OR pol_bad) AS raw FROM h0), {_widths_sql("h2", "h1", "raw", "wide")}, {_widths_sql("h3", "h2", "raw AND stands", "inn")},
h4 AS (SELECT *, stands AND coalesce(inn <= 15, false) AS corridor, protected OR NOT echo AS barrier FROM h3), h5 AS (SELECT *, raw AND (wide <= 45 OR corridor) AS allowed, CASE WHEN corridor THEN least(wide, inn) ELSE wide END AS width FROM h4),
h6 AS (SELECT *, allowed AND count(*) OVER (PARTITION BY sweep, ray, allowed, k) >= 3 AS proposal FROM (SELECT *, gate - row_number() OVER (PARTITION BY sweep, ray, allowed ORDER BY gate) AS k FROM h5)),
{_intervals_sql("hv", "h6", "proposal", "barrier", 3, 0.3)},
hm AS (SELECT s.*, l.part, l.first, l.last, l.n, coalesce(gate - lag(gate) OVER (PARTITION BY s.sweep, s.ray, part ORDER BY gate) > 1, true) AS begins, lag(gate) OVER (PARTITION BY s.sweep, s.ray, part ORDER BY gate) AS before, median(corrected) OVER (PARTITION BY s.sweep, s.ray, part) AS mid FROM h6 s JOIN hv l ON l.sweep = s.sweep AND l.ray = s.ray AND s.gate BETWEEN l.first AND l.last WHERE proposal),
ht AS (SELECT sweep, ray, part, first, last, n, CAST(max(width) AS DOUBLE) AS width_deg, quantile_cont(abs(corrected - mid), 0.9) AS p90_db, avg(CAST(stands AS INTEGER)) AS shoulder_fraction, count(*) FILTER (begins) AS atoms, min(range_m) AS near_m, max(range_m) AS far_m, CAST((last - first + 1) * 1000 AS DOUBLE) AS span_m, CAST(n * 1000 AS DOUBLE) AS measured_m FROM hm GROUP BY ALL),
hu AS (SELECT *, span_m < 8000 OR measured_m < 6000 AS short, span_m / greatest(1000, (near_m + far_m) / 2 * radians(width_deg)) AS aspect, measured_m >= 8000 AND width_deg <= 15 AND p90_db <= 5 AND shoulder_fraction >= 0.6 AS model, CAST(CASE WHEN near_m >= 40000 THEN 4 WHEN atoms > 1 THEN 3 WHEN width_deg > 15 THEN 2 ELSE 1 END AS INTEGER) AS kind FROM ht),
groups AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY ray, first) AS hypothesis FROM hu WHERE NOT short AND aspect >= 0.7),
hg AS (SELECT g.sweep, g.ray, g.gate, m.part, u.short, q.hypothesis, coalesce(q.kind, 0) AS kind, q.hypothesis IS NOT NULL AS review, coalesce(q.model, false) AS model, g.proposal,
 CASE WHEN g.echo AND g.protected THEN {_R["protected"]} ELSE 0 END | CASE WHEN g.echo AND NOT g.raw AND NOT g.protected THEN {_R["no_evidence"]} ELSE 0 END | CASE WHEN g.raw AND NOT g.allowed OR coalesce(NOT u.short AND q.hypothesis IS NULL, false) THEN {_R["wide"]} ELSE 0 END
 | CASE WHEN g.echo AND g.one_sided AND g.contrast IS NULL THEN {_R["one_shoulder"]} ELSE 0 END | CASE WHEN g.allowed AND NOT g.proposal THEN {_R["short_atom"]} ELSE 0 END | CASE WHEN coalesce(u.short, false) THEN {_R["short_group"]} ELSE 0 END
 | CASE WHEN q.hypothesis IS NOT NULL THEN {_R["review"]} | CASE WHEN q.model THEN {_R["model"]} ELSE 0 END | CASE WHEN NOT g.reliable THEN {_R["unavailable"]} ELSE 0 END ELSE 0 END AS reason, g.pol_bad, g.plateau, g.weather, g.old_action
 FROM h6 g LEFT JOIN hm m ON m.sweep = g.sweep AND m.ray = g.ray AND m.gate = g.gate LEFT JOIN hu u ON u.sweep = m.sweep AND u.ray = m.ray AND u.part = m.part LEFT JOIN groups q ON q.sweep = m.sweep AND q.ray = m.ray AND q.part = m.part)"""


@query("hypotheses", f"WITH RECURSIVE {_GRAPH_SQL} SELECT sweep, hypothesis, ray, first, last, atoms, kind, measured_m, span_m, width_deg, round(p90_db, 6) AS p90_db, round(shoulder_fraction, 6) AS shoulder_fraction, round(aspect, 6) AS aspect, model FROM groups")
def hypotheses(spark, sf_dir):
    h = objects.hypotheses(gates(spark, sf_dir), ["sweep"], GRAPH)[1]
    return h.withColumns({c: F.round(c, 6) for c in ("p90_db", "shoulder_fraction", "aspect")})


@query("hypothesis_links", f'WITH RECURSIVE {_GRAPH_SQL}, hl AS (SELECT sweep, ray, part, gate AS "to", CAST((gate - before - 1) * 1000 AS DOUBLE) AS gap_m, lag(gate) OVER (PARTITION BY sweep, ray, part ORDER BY gate) AS "from" FROM hm WHERE begins) SELECT sweep, ray, "from", "to", gap_m FROM hl WHERE "from" IS NOT NULL')
def hypothesis_links(spark, sf_dir):
    return objects.hypotheses(gates(spark, sf_dir), ["sweep"], GRAPH)[2]


@query(
    "hypothesis_gates",
    f"""WITH RECURSIVE {_GRAPH_SQL}, ha AS (SELECT *, review AND pol_bad AND NOT plateau AS confirmed, model AND NOT weather AND NOT (review AND pol_bad AND NOT plateau) AS isolated FROM hg)
    SELECT sweep, ray, gate, coalesce(hypothesis, 0) AS hypothesis, kind, proposal, CAST(reason | CASE WHEN confirmed THEN {_R["confirmed"]} WHEN isolated THEN {_R["quarantined"]} WHEN review THEN {_R["unresolved"]} ELSE 0 END AS INTEGER) AS reason,
    CASE WHEN old_action = 'REJECT' OR confirmed THEN 'REJECT' WHEN old_action = 'DOWNWEIGHT' OR isolated THEN 'DOWNWEIGHT' ELSE 'KEEP' END AS action FROM ha""",
)
def hypothesis_gates(spark, sf_dir):
    g = objects.arbitrated(objects.hypotheses(gates(spark, sf_dir), ["sweep"], GRAPH)[0])
    return g.select("sweep", "ray", "gate", "hypothesis", "kind", "proposal", "reason", "action")


@query(
    "fragment_links",
    f"""WITH {GATES_SQL}, e AS (SELECT *, gate - row_number() OVER (PARTITION BY sweep, ray, anchor ORDER BY gate) AS k FROM v WHERE dbzh >= 0 AND range_m >= 4000), a AS (SELECT *, anchor AND count(*) OVER (PARTITION BY sweep, ray, anchor, k) >= 4 AS seed FROM e),
    r AS (SELECT sweep, ray, k, min(gate) AS first, row_number() OVER (PARTITION BY sweep ORDER BY ray, min(gate)) AS fragment FROM a WHERE seed GROUP BY sweep, ray, k), s AS (SELECT a.*, r.fragment FROM a JOIN r USING (sweep, ray, k) WHERE seed),
    n AS (SELECT t.sweep, t.ray, t.gate, arg_min(struct_pack(f := s.fragment, g := s.gate, d := abs(t.range_m - s.range_m), r := abs(t.dbzh - s.dbzh - CASE WHEN s.grows THEN 20 * log10(t.range_m / s.range_m) ELSE 0 END)), struct_pack(d := abs(t.gate - s.gate), g := s.gate)) AS p FROM a t JOIN s ON s.sweep = t.sweep AND s.ray = t.ray WHERE NOT t.anchor GROUP BY ALL)
    SELECT sweep, ray, gate, fragment, false AS linked, NULL::BIGINT AS parent, NULL::DOUBLE AS distance_m, NULL::DOUBLE AS residual_db FROM s UNION ALL SELECT sweep, ray, gate, p.f, true, p.g, p.d, round(p.r, 6) FROM n WHERE p.d <= 5000 AND p.r <= 4""",
)
def fragment_links(spark, sf_dir):
    return objects.associated(gates(spark, sf_dir), ["sweep"], FRAGMENTS).withColumn("residual_db", F.round("residual_db", 6))


FEATURES = ["dbzh", "rhohv", "range_m", "contrast", "support", "axial_std"]


@query("gate_classifier")
def gate_classifier(spark, sf_dir):
    """Of each sweep that is held out and of those that are not: how a forest on
    measured features tells gates of bad polarimetry from the others."""
    from hydrolith.operators import classifier
    from hydrolith.operators.verification import confusion

    s = seeds(spark, sf_dir)
    forest = classifier.fit(s, FEATURES, "pol_bad", ["sweep"])
    scored = s.withColumns({"held_out": classifier.held_out(["sweep"]), "p": classifier.probability(forest, FEATURES)})
    return confusion(scored, ["held_out", "sweep"], F.col("pol_bad"), F.col("p") >= 0.5)
