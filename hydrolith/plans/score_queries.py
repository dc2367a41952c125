"""Scores by band, scale and amount, geometry and tiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydrolith.operators import scores
from hydrolith.plans.registry import load, query
from hydrolith.plans.verification_queries import PAIRS_SQL, pairs, rounded
from hydrolith.sources.contracts import CONTRACTS, violations


@query(
    "precipitation_retention",
    "SELECT l_returnflag AS flag, count(*) FILTER (WHERE e) AS eligible, count(*) FILTER (WHERE e AND l_quantity > 5) AS kept, round(count(*) FILTER (WHERE e AND l_quantity > 5) / NULLIF(count(*) FILTER (WHERE e), 0), 6) AS retention FROM (SELECT *, l_partkey % 3 = 0 AND l_suppkey % 5 <> 0 AS e FROM lineitem) GROUP BY 1",
)
def precipitation_retention(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return rounded(scores.retention(line.withColumn("flag", F.col("l_returnflag")), ["flag"], F.col("l_partkey") % 3 == 0, F.col("l_quantity") > 5, F.col("l_suppkey") % 5 != 0), ["flag"])


@query(
    "spatial_scores",
    f"""WITH e AS (SELECT c, unnest([5.0, 20.0]::DOUBLE[]) AS threshold, y, x, observed, forecast FROM ({PAIRS_SQL}) WHERE observed >= 0 AND forecast >= 0), b AS (SELECT *, CAST(observed > threshold AS INT) AS o, CAST(forecast > threshold AS INT) AS f FROM e),
    p AS (SELECT c, threshold, CAST(sum(o * f) AS BIGINT) AS hits, CAST(sum(o * (1 - f)) AS BIGINT) AS misses, CAST(sum((1 - o) * f) AS BIGINT) AS false_alarms FROM b GROUP BY 1, 2),
    w AS (SELECT a.c, a.threshold, k.size, a.y, a.x, count(*) AS n, CAST(sum(b.o) AS DOUBLE) AS o, CAST(sum(b.f) AS DOUBLE) AS f FROM b a JOIN (SELECT unnest([3, 5]) AS size) k ON true JOIN b ON a.c = b.c AND a.threshold = b.threshold AND abs(a.y - b.y) <= k.size // 2 AND abs(a.x - b.x) <= k.size // 2 GROUP BY 1, 2, 3, 4, 5),
    s AS (SELECT c, threshold, size, count(*) AS cells, sum(pow((f - o) / n, 2)) AS d, sum(pow(f / n, 2) + pow(o / n, 2)) AS s, count(*) FILTER (WHERE o > 0 AND f > 0) AS bo, count(*) FILTER (WHERE o > 0 OR f > 0) AS an FROM w WHERE n = size * size GROUP BY 1, 2, 3)
    SELECT c, threshold, size AS "window", cells, hits, misses, false_alarms, round(hits / NULLIF(hits + misses + false_alarms, 0), 6) AS csi, round(CASE WHEN s > 1e-20 THEN greatest(0.0, least(1.0, 1 - d / s)) END, 6) AS fss, round(bo / NULLIF(an, 0), 6) AS neighbourhood_csi FROM s JOIN p USING (c, threshold)""",
)
def spatial_scores(spark, sf_dir):
    return rounded(scores.spatial_scores(pairs(spark, sf_dir), ["c"], [5.0, 20.0], [3, 5]), ["c", "threshold", "window"])


_RATES = "l_suppkey % 4 AS c, l_partkey % 24 AS y, l_orderkey % 24 AS x, l_linenumber * 6 AS lead_min, CAST(min(l_partkey) % 30 AS DOUBLE) AS observed, CASE WHEN min(l_suppkey) % 19 = 0 THEN NULL ELSE CAST(min(l_orderkey) % 30 AS DOUBLE) END AS forecast"
_RATES_SQL = f"SELECT {_RATES} FROM lineitem GROUP BY 1, 2, 3, 4"


@query(
    "accumulation_scores",
    f"""WITH r AS ({_RATES_SQL}), a AS (SELECT c, y, x, u AS until_min, CASE WHEN count(observed) = u // 6 THEN sum(observed) / 10 END AS observed, CASE WHEN count(forecast) = u // 6 THEN sum(forecast) / 10 END AS forecast FROM r JOIN (SELECT unnest([12, 18]) AS u) ON lead_min <= u GROUP BY 1, 2, 3, 4),
    t AS (SELECT *, unnest([1.0, 3.0]::DOUBLE[]) AS threshold FROM a WHERE observed IS NOT NULL AND forecast IS NOT NULL)
    SELECT c, until_min, threshold, hits, misses, false_alarms, correct_negatives, mae, rmse, bias, coverage, round(hits / NULLIF(hits + misses + false_alarms, 0), 6) AS csi, round(hits / NULLIF(hits + misses, 0), 6) AS pod, round(false_alarms / NULLIF(hits + false_alarms, 0), 6) AS far FROM
    (SELECT c, until_min, threshold, count(*) FILTER (WHERE observed >= threshold AND forecast >= threshold) AS hits, count(*) FILTER (WHERE observed >= threshold AND forecast < threshold) AS misses, count(*) FILTER (WHERE observed < threshold AND forecast >= threshold) AS false_alarms,
     count(*) FILTER (WHERE observed < threshold AND forecast < threshold) AS correct_negatives, round(avg(abs(forecast - observed)), 6) AS mae, round(sqrt(avg(pow(forecast - observed, 2))), 6) AS rmse, round(avg(forecast - observed), 6) AS bias, 1.0::DOUBLE AS coverage FROM t GROUP BY 1, 2, 3)""",
)
def accumulation_scores(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 4 AS c", "l_partkey % 24 AS y", "l_orderkey % 24 AS x", "l_linenumber * 6 AS lead_min", "l_partkey AS p", "l_orderkey AS o", "l_suppkey AS s")
    g = line.groupBy("c", "y", "x", "lead_min").agg(F.min("p").alias("p"), F.min("o").alias("o"), F.min("s").alias("s"))
    rates = g.selectExpr("c", "y", "x", "lead_min", "CAST(p % 30 AS DOUBLE) AS observed", "CASE WHEN s % 19 = 0 THEN NULL ELSE CAST(o % 30 AS DOUBLE) END AS forecast")
    return rounded(scores.accumulation_scores(rates, ["c"], [12, 18], [1.0, 3.0]), ["c", "until_min", "threshold"])


_BAND = "l_suppkey % 3 AS model, l_linenumber * 15 AS lead_min, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS crps, CASE WHEN l_partkey % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(l_discount AS DOUBLE) END AS rmse, l_orderkey % 5 AS cells"
_BANDS_SQL = f"""SELECT model, band, sum(crps * cells) FILTER (WHERE cells > 0) / NULLIF(sum(cells) FILTER (WHERE cells > 0 AND crps IS NOT NULL), 0) AS crps, sum(rmse * cells) FILTER (WHERE cells > 0 AND NOT isnan(rmse)) / NULLIF(sum(cells) FILTER (WHERE cells > 0 AND NOT isnan(rmse)), 0) AS rmse, CAST(sum(cells) AS BIGINT) AS cells
 FROM (SELECT *, CASE WHEN lead_min <= 60 THEN 'near' ELSE 'far' END AS band FROM (SELECT {_BAND} FROM lineitem)) GROUP BY 1, 2"""


@query("band_summary", f"SELECT b.model, b.band, round(b.crps, 6) AS crps, round(b.rmse, 6) AS rmse, b.cells, round(CASE WHEN z.crps > 0 THEN 1 - b.crps / z.crps END, 6) AS crps_skill FROM ({_BANDS_SQL}) b LEFT JOIN ({_BANDS_SQL}) z ON z.band = b.band AND z.model = 0")
def band_summary(spark, sf_dir):
    """Skill is against model 0 in the same band."""
    from hydrolith.plans.views import split_columns

    b = scores.band_means(load(spark, sf_dir, "lineitem").selectExpr(*split_columns(_BAND)), ["model"], ["crps", "rmse"])
    base = b.filter("model = 0").select("band", F.col("crps").alias("_z"))
    return rounded(b.join(base, "band", "left").select("model", "band", "crps", "rmse", "cells", scores.skill(F.col("crps"), F.col("_z")).alias("crps_skill")), ["model", "band"])


@query("mercator_lonlat", "SELECT c_custkey AS k, round(degrees(x / 6378137.0), 9) AS lon, round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 9) AS lat FROM (SELECT c_custkey, c_custkey * 1000.0 AS x, c_acctbal * 500.0 AS y FROM customer)")
def mercator_lonlat(spark, sf_dir):
    lon, lat = scores.from_mercator(F.col("c_custkey") * 1000.0, F.col("c_acctbal") * 500.0)
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("grid_metric")
def grid_metric(spark, sf_dir):
    lat = load(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2.5).alias("latitude"))
    return scores.grid_metric(lat, 0.01, 0.01, 30.0)


@query("covering_tiles")
def covering_tiles(spark, sf_dir):
    p = pairs(spark, sf_dir).filter("observed IS NOT NULL").select("c", "y", "x")
    return scores.covering_tiles(p, ["c"], 4, 2, 8, multiple=2)


@query(
    "sample_plan_shards",
    """WITH c AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, o_orderpriority AS split FROM orders WHERE o_totalprice > 100000)
    SELECT split, k, day, place AS shard_index, sha256('{"split":"' || split || '","shard_index":' || place || ',"key":' || k || ',"day":"' || day || '"}') AS plan_id FROM c WHERE place < 20""",
)
def sample_plan_shards(spark, sf_dir):
    """The rows of a plan: 20 windows of each split, their shards by order, and
    an id that is the hash of the row's canonical JSON."""
    from pyspark.sql import Window

    o = load(spark, sf_dir, "orders").filter("o_totalprice > 100000")
    best = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    r = o.withColumn("place", (F.row_number().over(best) - 1).cast("long")).filter("place < 20")
    r = r.select(F.col("o_orderpriority").alias("split"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("place").alias("shard_index"))
    canonical = F.to_json(F.struct("split", "shard_index", F.col("k").alias("key"), "day"))
    return r.withColumn("plan_id", F.sha2(canonical, 256))


_FORECAST = """l_orderkey AS run, CAST(l_linenumber AS INTEGER) AS member, CAST(l_suppkey % 31 * 3 AS INTEGER) AS lead_min, l_partkey AS y, CASE WHEN l_partkey % 997 = 0 THEN NULL ELSE l_suppkey END AS x,
 CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) - 1.5 END AS value, l_partkey % 11 <> 0 OR l_suppkey % 41 = 0 AS valid, CAST(l_discount * 12 AS DOUBLE) AS confidence"""


@query(
    "contract_violations",
    f"""WITH f AS (SELECT {_FORECAST} FROM lineitem UNION ALL SELECT {_FORECAST} FROM lineitem WHERE l_orderkey % 50 = 0), k AS (SELECT run, member, lead_min, y, x, count(*) AS n FROM f GROUP BY ALL)
    SELECT 'key_is_not_null' AS rule, CAST(count(*) FILTER (WHERE x IS NULL) AS BIGINT) AS "rows" FROM f UNION ALL SELECT 'key_is_unique', CAST(coalesce(sum(n - 1) FILTER (WHERE x IS NOT NULL), 0) AS BIGINT) FROM k UNION ALL SELECT 'missing_is_null', count(*) FROM f WHERE valid <> (value IS NOT NULL)
    UNION ALL SELECT 'not_negative', count(*) FROM f WHERE value < 0 UNION ALL SELECT 'confidence_in_range', count(*) FROM f WHERE confidence NOT BETWEEN 0 AND 1 UNION ALL SELECT 'on_the_step', count(*) FROM f WHERE lead_min % 6 <> 0""",
)
def contract_violations(spark, sf_dir):
    from hydrolith.plans.views import split_columns

    line = load(spark, sf_dir, "lineitem")
    f = line.unionByName(line.filter("l_orderkey % 50 = 0")).selectExpr(*split_columns(_FORECAST))
    return violations(f, CONTRACTS["forecast_cell"])
