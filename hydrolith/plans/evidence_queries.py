"""Evidence, matching, terrain and audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolith.operators import evidence as ev
from hydrolith.plans.registry import load, query
from hydrolith.plans.views import SCANS_SQL, scans, split_columns
from hydrolith.sources.tables import sampled_terrain

_GATE = """l_orderkey AS ray, l_linenumber AS gate, l_partkey AS p, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey % 60 AS DOUBLE) - 15 END AS dbzh, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey % 10 AS DOUBLE) / 10 END AS rhohv, CAST(l_orderkey % 15 AS DOUBLE) AS snr,
 CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE CAST(l_orderkey % 10 AS DOUBLE) / 10 END AS meteo_score, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_partkey % 10 AS DOUBLE) / 10 END AS weather_support, CAST(l_suppkey % 11 AS DOUBLE) / 11 AS clutter_prior,
 l_partkey % 5 = 0 AS radial, l_orderkey % 3 = 0 AS structure, l_linenumber % 2 = 0 AS small_object, CAST(l_linenumber AS INTEGER) AS pol_moments, CASE WHEN l_linenumber = 3 THEN 0.5 END AS quality_cap"""
_DECIDED_SQL = f"""WITH g AS (SELECT {_GATE} FROM lineitem), e AS (SELECT *, dbzh IS NOT NULL AS o, coalesce(dbzh >= -10, false) AS rain, coalesce(weather_support >= 0.7, false) AS w, coalesce(meteo_score <= 0.35, false) AS lm, coalesce(rhohv < 0.7, false) AS sv, coalesce(dbzh >= -10 AND snr < 3, false) AS ls, clutter_prior >= 0.7 AS pr FROM g),
 d AS (SELECT *, rain AND structure AND lm AND NOT w AS a, rain AND radial AND sv AND pol_moments >= 2 AS b, rain AND pr AND lm AND NOT w AS c, rain AND small_object AND ls AND sv AND coalesce(dbzh < 35, false) AND NOT w AS dd, rain AND w AND lm AND (structure OR pr) AS f, rain AND structure AND NOT lm AS h, o AND (meteo_score IS NULL OR rhohv IS NULL) AS i FROM e),
 r AS (SELECT *, CASE WHEN NOT o THEN 'MISSING' WHEN a OR b OR c OR dd THEN 'REJECT' WHEN f OR h OR i OR ls THEN 'DOWNWEIGHT' ELSE 'KEEP' END AS action,
 CAST((NOT o)::INT + 2 * a::INT + 4 * b::INT + 8 * c::INT + 16 * dd::INT + 32 * f::INT + 64 * (rain AND w AND small_object AND ls)::INT + 128 * h::INT + 256 * i::INT + 512 * ls::INT AS INTEGER) AS reasons,
 CAST(CASE WHEN NOT o THEN NULL WHEN a OR b OR c OR dd THEN 0 ELSE least(coalesce(quality_cap, 1.0), CASE WHEN f OR h OR i OR ls THEN 0.6 ELSE 1.0 END) END AS DOUBLE) AS quality FROM d)"""


def decided(spark, sf_dir):
    return ev.decide(load(spark, sf_dir, "lineitem").selectExpr(*split_columns(_GATE.replace("THEN 0.5 END", "THEN 0.5D END"))))


@query("evidence_decision", _DECIDED_SQL + " SELECT ray, gate, p, action, reasons, quality, o AND action <> 'REJECT' AS trusted, coalesce(o AND action <> 'REJECT' AND quality >= 0.45, false) AS eligible FROM r")
def evidence_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("ray", "gate", "p", "action", "reasons", "quality", "trusted", "eligible")


@query(
    "action_comparison",
    _DECIDED_SQL + " SELECT p % 5 AS label, count(*) AS gates, count(*) FILTER (WHERE action = 'REJECT') AS rejected, count(*) FILTER (WHERE action = 'REJECT' AND dbzh >= 35) AS strong_rejected, count(*) FILTER (WHERE action = 'DOWNWEIGHT') AS withheld, count(*) FILTER (WHERE dbzh >= 35) AS strong FROM r GROUP BY 1",
)
def action_comparison(spark, sf_dir):
    return ev.action_counts(decided(spark, sf_dir).withColumn("label", F.col("p") % 5), "label")


@query(
    "temporal_votes",
    f"""WITH h AS (SELECT radar, t // 3600 AS volume, max(value) > 60 AS hit FROM ({SCANS_SQL}) GROUP BY 1, 2) SELECT radar, volume, count(hit) OVER w AS available, round(sum(hit::INT) OVER w / NULLIF(count(hit) OVER w, 0), 6) AS persistence FROM h WINDOW w AS (PARTITION BY radar ORDER BY volume ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def temporal_votes(spark, sf_dir):
    h = scans(spark, sf_dir).groupBy("radar", F.floor(F.col("t") / 3600).cast("long").alias("volume")).agg((F.max("value") > 60).alias("hit"))
    return ev.votes(h, ["radar"], "volume", "hit", 3).select("radar", "volume", "available", F.round("persistence", 6).alias("persistence"))


@query(
    "nearest_azimuth",
    """WITH r AS (SELECT l_suppkey % 3 AS sweep, l_partkey % 360 AS ray, min(l_partkey % 360 + CAST(l_partkey % 7 AS DOUBLE) / 10) AS az FROM lineitem GROUP BY 1, 2), t AS (SELECT DISTINCT sweep, CAST(k * 7 AS DOUBLE) AS azimuth FROM r, (SELECT unnest(generate_series(0, 51)) AS k)),
    d AS (SELECT t.sweep, t.azimuth, r.ray, round(least(abs(r.az - t.azimuth), 360 - abs(r.az - t.azimuth)), 9) AS d FROM t JOIN r ON r.sweep = t.sweep), n AS (SELECT *, row_number() OVER (PARTITION BY sweep, azimuth ORDER BY d, ray) AS n FROM d WHERE d <= 1.0) SELECT sweep, azimuth, ray, round(d, 6) AS offset_deg FROM n WHERE n = 1""",
)
def nearest_azimuth(spark, sf_dir):
    az = F.col("l_partkey") % 360 + (F.col("l_partkey") % 7).cast("double") / 10
    r = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 3).alias("sweep"), (F.col("l_partkey") % 360).alias("ray")).agg(F.min(az).alias("azimuth"))
    t = r.select("sweep").distinct().select("sweep", F.explode(F.sequence(F.lit(0), F.lit(51))).alias("k")).select("sweep", (F.col("k") * 7).cast("double").alias("azimuth"))
    return ev.nearest_azimuth(r, t, ["sweep"], 2.0, 1.0).withColumn("offset_deg", F.round("offset_deg", 6))


@query(
    "beam_overlap",
    """WITH b AS (SELECT c_nationkey AS y, c_custkey % 5 AS x, c_custkey % 7 AS radar, max(c_acctbal) AS h FROM customer GROUP BY 1, 2, 3) SELECT a.y, a.x, a.radar, b.radar AS other, round(greatest(abs(a.h - b.h) - 200, 0.0), 6) AS gap_m FROM b a JOIN b ON a.y = b.y AND a.x = b.x AND a.radar <> b.radar WHERE abs(a.h - b.h) - 200 <= 1000""",
)
def beam_overlap(spark, sf_dir):
    b = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("y"), (F.col("c_custkey") % 5).alias("x"), (F.col("c_custkey") % 7).alias("radar")).agg(F.max("c_acctbal").alias("height_m")).withColumn("radius_m", F.lit(100.0))
    return ev.beams_overlap(b, b, ["y", "x"], 1000.0).withColumn("gap_m", F.round("gap_m", 6))


@query(
    "observation_match",
    """WITH p AS (SELECT o_orderkey AS k, o_orderkey % 500 AS t, CAST(o_custkey % 97 * 100 AS DOUBLE) AS x, CAST(o_orderkey % 89 * 100 AS DOUBLE) AS y FROM orders), f AS (SELECT c_custkey AS id, c_custkey * 3 % 500 AS t, CAST(c_custkey % 91 * 100 AS DOUBLE) AS x, CAST(c_custkey * 7 % 83 * 100 AS DOUBLE) AS y, c_acctbal AS v FROM customer),
    d AS (SELECT k, id, v, sqrt(pow(p.x - f.x, 2) + pow(p.y - f.y, 2)) AS d, abs(p.t - f.t) AS s FROM p JOIN f ON abs(p.t - f.t) <= 60 AND abs(p.x - f.x) <= 500 AND abs(p.y - f.y) <= 500), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, s, id) AS n FROM d WHERE d <= 500)
    SELECT k, id AS field_id, v AS value, round(d, 6) AS distance_m, s AS offset_s FROM n WHERE n = 1""",
)
def observation_match(spark, sf_dir):
    p = load(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderkey % 500 AS t", "CAST(o_custkey % 97 * 100 AS DOUBLE) AS x_m", "CAST(o_orderkey % 89 * 100 AS DOUBLE) AS y_m")
    f = load(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey * 3 % 500 AS t", "CAST(c_custkey % 91 * 100 AS DOUBLE) AS x_m", "CAST(c_custkey * 7 % 83 * 100 AS DOUBLE) AS y_m", "c_acctbal AS value")
    return ev.matched_observations(p, f, "k", 60, 500.0).withColumn("distance_m", F.round("distance_m", 6))


@query(
    "terrain_sample",
    """WITH p AS (SELECT c_custkey AS k, 118 + CAST(c_custkey % 400 AS DOUBLE) / 128 AS longitude, 25 + CAST(c_custkey * 3 % 256 AS DOUBLE) / 128 AS latitude FROM customer), t AS (SELECT 118 + p_partkey % 3 AS tx, 25 + p_partkey % 2 AS ty, p_partkey % 32 AS r, p_partkey // 32 % 32 AS c, max(p_retailprice) AS h FROM part GROUP BY 1, 2, 3, 4)
    SELECT k, CASE WHEN longitude <= 121 THEN coalesce(h, 0) END AS terrain_m FROM p LEFT JOIN t ON tx = floor(longitude) AND ty = floor(latitude) AND r = least(floor((latitude - floor(latitude)) * 32), 31) AND c = least(floor((longitude - floor(longitude)) * 32), 31)""",
)
def terrain_sample(spark, sf_dir):
    p = load(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "118 + CAST(c_custkey % 400 AS DOUBLE) / 128 AS longitude", "25 + CAST(c_custkey * 3 % 256 AS DOUBLE) / 128 AS latitude")
    t = load(spark, sf_dir, "part").selectExpr("CAST(118 + p_partkey % 3 AS INT) AS tile_x", "CAST(25 + p_partkey % 2 AS INT) AS tile_y", "CAST(p_partkey % 32 AS INT) AS row", "CAST(p_partkey div 32 % 32 AS INT) AS col", "p_retailprice AS height").groupBy("tile_x", "tile_y", "row", "col").agg(F.max("height").alias("height"))
    return sampled_terrain(p, t, (118.0, 25.0, 121.0, 27.0), 32).select("k", "terrain_m")


@query(
    "hourly_screening",
    f"""WITH h AS (SELECT radar, t // 3600 AS hour, round(count(*) FILTER (WHERE value >= 1) / count(*), 12) AS ge1, round(count(*) FILTER (WHERE value >= 50) / count(*), 12) AS ge10 FROM ({SCANS_SQL}) GROUP BY 1, 2), b AS (SELECT radar, hour, avg(ge1) OVER w + 2 * avg(ge10) OVER w AS s FROM h WINDOW w AS (PARTITION BY radar ORDER BY hour RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT radar, hour, round(s, 6) AS wet_score, rank() OVER (PARTITION BY radar ORDER BY round(s, 6) DESC, hour) AS rank FROM b""",
)
def hourly_screening(spark, sf_dir):
    share = lambda x: F.round(F.count_if(F.col("value") >= x) / F.count("*"), 12)
    h = scans(spark, sf_dir).groupBy("radar", F.floor(F.col("t") / 3600).cast("long").alias("hour")).agg(share(1).alias("a"), share(50).alias("b"))
    w = Window.partitionBy("radar").orderBy("hour").rangeBetween(-2, 2)
    s = h.withColumn("wet_score", F.round(F.avg("a").over(w) + F.lit(2.0) * F.avg("b").over(w), 6))
    return s.select("radar", "hour", "wet_score", F.rank().over(Window.partitionBy("radar").orderBy(F.col("wet_score").desc(), "hour")).cast("long").alias("rank"))


@query(
    "archive_audit",
    f"""WITH d AS (SELECT DISTINCT radar, t // 86400 AS day FROM ({SCANS_SQL})), r AS (SELECT radar, min(day) AS a, max(day) AS b, count(*) AS present FROM d GROUP BY 1), i AS (SELECT radar, day - row_number() OVER (PARTITION BY radar ORDER BY day) AS g FROM d), s AS (SELECT radar, g, count(*) AS n FROM i GROUP BY 1, 2),
    k AS (SELECT radar, count(*) AS segments, max(n) AS longest, CAST(sum(greatest(n - 3 + 1, 0)) AS BIGINT) AS windows FROM s GROUP BY 1) SELECT r.radar, present, b - a + 1 - present AS missing, segments, longest, windows FROM r JOIN k ON r.radar = k.radar""",
)
def archive_audit(spark, sf_dir):
    """Days present and missing, runs without a gap and the windows in them."""
    d = scans(spark, sf_dir).select("radar", F.floor(F.col("t") / 86400).cast("long").alias("day")).distinct()
    s = d.withColumn("g", F.col("day") - F.row_number().over(Window.partitionBy("radar").orderBy("day"))).groupBy("radar", "g").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    return s.groupBy("radar").agg(
        F.sum("n").alias("present"), (F.max("b") - F.min("a") + 1 - F.sum("n")).alias("missing"), F.count("*").alias("segments"), F.max("n").alias("longest"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("windows")
    )


@query(
    "missing_leads",
    "WITH h AS (SELECT o_custkey AS run, list_distinct(list(CAST(o_orderkey % 6 + 1 AS INTEGER))) AS have FROM orders GROUP BY 1) SELECT run, array_to_string(list_sort(list_filter([1, 2, 3, 4, 5, 6], lambda x: NOT list_contains(have, x))), ',') AS missing FROM h",
)
def missing_leads(spark, sf_dir):
    from hydrolith.operators.catalogue import missing_members

    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderkey") % 6 + 1).cast("int").alias("lead"))
    m = missing_members(o, ["run"], "lead", F.sequence(F.lit(1), F.lit(6)))
    return m.select("run", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))

