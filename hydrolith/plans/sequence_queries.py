"""Joins in time and ordered operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolith.functions import basic as bs
from hydrolith.functions import physics as ph
from hydrolith.operators import asof, sequences as seq
from hydrolith.plans.registry import load, query
from hydrolith.plans.views import SCANS_SQL, scans, split_columns
from hydrolith.profiles import Waterline

#: Lines of an order as gates along a ray, one for each line number.
_GATE = """ray, gate, CAST(gate AS DOUBLE) / 4 AS km, CAST(p % 50 AS DOUBLE) AS dbzh, CASE WHEN p % 9 = 0 THEN NULL ELSE CAST(s % 10 AS DOUBLE) / 10 END AS partial, CAST(p % 360 AS DOUBLE) AS phase"""
GATES_SQL = f"SELECT {_GATE} FROM (SELECT l_orderkey AS ray, l_linenumber AS gate, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2)"


def gates(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ray"), F.col("l_linenumber").alias("gate")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return line.selectExpr(*split_columns(_GATE))


@query(
    "asof_closest_per_key",
    f"""WITH s AS (SELECT *, (t + 180) // 360 * 360 AS slot_s FROM ({SCANS_SQL})), c AS (SELECT *, abs(t - slot_s) AS d FROM s WHERE abs(t - slot_s) <= 150),
    r AS (SELECT *, row_number() OVER (PARTITION BY radar, slot_s ORDER BY d, t, scan_id) AS n, count(*) OVER (PARTITION BY radar, slot_s) AS candidates FROM c) SELECT radar, slot_s, scan_id, t, candidates FROM r WHERE n = 1""",
)
def asof_closest_per_key(spark, sf_dir):
    return asof.closest(scans(spark, sf_dir), "radar", "t", "scan_id", 360, 150)


@query(
    "asof_backward_bounded",
    f"""WITH s AS ({SCANS_SQL}), i AS (SELECT DISTINCT radar, t // 3600 * 3600 + 3600 AS at_s FROM s),
    r AS (SELECT i.radar, i.at_s, s.scan_id, s.t, row_number() OVER (PARTITION BY i.radar, i.at_s ORDER BY s.t DESC, s.scan_id) AS n FROM i JOIN s ON s.radar = i.radar AND s.t <= i.at_s AND i.at_s - s.t <= 1200)
    SELECT radar, at_s, scan_id, t FROM r WHERE n = 1""",
)
def asof_backward_bounded(spark, sf_dir):
    """The last scan of twenty minutes before each full hour with scans."""
    s = scans(spark, sf_dir)
    instants = s.select("radar", (F.floor(F.col("t") / 3600) * 3600 + 3600).cast("long").alias("at_s")).distinct()
    return asof.last_before(instants, s, ["radar"], "at_s", "t", "scan_id", 1200)


@query(
    "asof_bitemporal",
    f"""WITH s AS (SELECT *, t + scan_id % 900 AS arrived FROM ({SCANS_SQL})), i AS (SELECT DISTINCT radar, t // 7200 * 7200 AS at_s FROM s),
    r AS (SELECT i.radar, i.at_s, s.scan_id, s.t, row_number() OVER (PARTITION BY i.radar, i.at_s ORDER BY s.t DESC, s.scan_id) AS n FROM i JOIN s ON s.radar = i.radar AND s.t <= i.at_s AND i.at_s - s.t <= 3600 AND s.arrived <= 1705276800)
    SELECT radar, at_s, scan_id, t FROM r WHERE n = 1""",
)
def asof_bitemporal(spark, sf_dir):
    """Only what had arrived by a cutoff counts, whatever its own time."""
    s = scans(spark, sf_dir).withColumn("arrived", F.col("t") + F.col("scan_id") % 900)
    instants = s.select("radar", (F.floor(F.col("t") / 7200) * 7200).cast("long").alias("at_s")).distinct()
    return asof.last_before(instants, s, ["radar"], "at_s", "t", "scan_id", 3600, "arrived", 1705276800)


@query(
    "context_same_site",
    f"""WITH s AS ({SCANS_SQL}), p AS (SELECT a.scan_id AS id, a.radar AS site, a.t AS at, b.scan_id AS other_id, b.radar AS other_site, b.t AS other_at,
    row_number() OVER (PARTITION BY a.scan_id ORDER BY abs(a.t - b.t), b.t, b.scan_id) AS rank FROM s a JOIN s b ON a.radar = b.radar AND a.scan_id <> b.scan_id AND abs(a.t - b.t) <= 900) SELECT * FROM p WHERE rank <= 2""",
)
def context_same_site(spark, sf_dir):
    return asof.context(scans(spark, sf_dir), "radar", "t", "scan_id", 900, 2, True).withColumn("rank", F.col("rank").cast("long"))


@query(
    "context_other_sites",
    f"""WITH s AS ({SCANS_SQL}), p AS (SELECT a.scan_id AS id, a.radar AS site, a.t AS at, b.scan_id AS other_id, b.radar AS other_site, b.t AS other_at,
    row_number() OVER (PARTITION BY a.scan_id ORDER BY abs(a.t - b.t), b.t, b.scan_id) AS rank FROM s a JOIN s b ON a.radar <> b.radar AND a.scan_id <> b.scan_id AND abs(a.t - b.t) <= 120) SELECT * FROM p WHERE rank <= 3""",
)
def context_other_sites(spark, sf_dir):
    return asof.context(scans(spark, sf_dir), "radar", "t", "scan_id", 120, 3, False).withColumn("rank", F.col("rank").cast("long"))


@query(
    "lead_alignment",
    f"""WITH s AS ({SCANS_SQL}), i AS (SELECT radar, t AS issue, scan_id AS run FROM s WHERE status = 'signup'), j AS (SELECT i.run, s.t - i.issue AS lead_s, s.scan_id, row_number() OVER (PARTITION BY i.run, s.t ORDER BY s.scan_id DESC) AS n
    FROM i JOIN s ON s.radar = i.radar AND s.t > i.issue AND s.t <= i.issue + 10800) SELECT run, lead_s, scan_id FROM j WHERE n = 1""",
)
def lead_alignment(spark, sf_dir):
    """Truth within three hours of an issue, the newest for each time; bucketed
    by three hours, so the range join is an equality join on two buckets."""
    s = scans(spark, sf_dir)
    bucket = lambda c: F.floor(c / 10800).cast("long")
    i = s.filter("status = 'signup'").select("radar", F.col("t").alias("issue"), F.col("scan_id").alias("run")).withColumn("b", F.explode(F.array(bucket(F.col("issue")), bucket(F.col("issue")) + 1)))
    truth = s.select("radar", "t", "scan_id", bucket(F.col("t")).alias("b"))
    j = i.join(truth, ["radar", "b"]).filter("t > issue AND t <= issue + 10800")
    return j.groupBy("run", (F.col("t") - F.col("issue")).alias("lead_s")).agg(F.max("scan_id").alias("scan_id"))


@query(
    "ready_sequences",
    f"""WITH f AS (SELECT DISTINCT radar, t // 3600 * 3600 AS t FROM ({SCANS_SQL})), b AS (SELECT *, CASE WHEN t - lag(t) OVER w = 3600 THEN 0 ELSE 1 END AS nw FROM f WINDOW w AS (PARTITION BY radar ORDER BY t)),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY radar ORDER BY t) AS g FROM b), c AS (SELECT radar, t, least(row_number() OVER (PARTITION BY radar, g ORDER BY t), 6) AS frames FROM i) SELECT * FROM c WHERE frames >= 3""",
)
def ready_sequences(spark, sf_dir):
    f = scans(spark, sf_dir).select("radar", (F.floor(F.col("t") / 3600) * 3600).cast("long").alias("t"))
    return asof.ready_sequences(f, "radar", "t", 3600, 3, 6).withColumn("frames", F.col("frames").cast("long"))


@query("tumbling_cycle", f"SELECT (t + 180) // 360 * 360 AS cycle_s, count(*) AS scans, count(DISTINCT radar) AS radars FROM ({SCANS_SQL}) WHERE abs(t - (t + 180) // 360 * 360) <= 150 GROUP BY 1")
def tumbling_cycle(spark, sf_dir):
    s = scans(spark, sf_dir).withColumn("cycle_s", (F.floor((F.col("t") + 180) / 360) * 360).cast("long")).filter("abs(t - cycle_s) <= 150")
    return s.groupBy("cycle_s").agg(F.count("*").alias("scans"), F.countDistinct("radar").alias("radars"))


@query(
    "waterline_batch",
    f"""WITH c AS (SELECT (t + 1800) // 3600 * 3600 AS cycle_s, count(DISTINCT radar) AS n FROM ({SCANS_SQL}) GROUP BY 1), a AS (SELECT *, CAST(cycle_s % 300 + n * 37 AS BIGINT) AS age FROM c)
    SELECT cycle_s, n, n >= 2 AS complete, CASE WHEN n >= 2 AND age < 30 THEN 'waiting_earliest_delay' WHEN n >= 2 THEN 'all_radars_arrived' WHEN age < 40 THEN 'waiting_maximum_watermark' ELSE 'maximum_wait_elapsed' END AS reason,
    (n >= 2 AND age >= 30) OR (n < 2 AND age >= 40) AS ready FROM a""",
)
def waterline_batch(spark, sf_dir):
    s = scans(spark, sf_dir).withColumn("cycle_s", (F.floor((F.col("t") + 1800) / 3600) * 3600).cast("long"))
    c = s.groupBy("cycle_s").agg(F.countDistinct("radar").alias("n")).withColumn("age", F.col("cycle_s") % 300 + F.col("n") * 37)
    w = asof.waterline(F.col("n"), F.col("age"), Waterline(expected=2, earliest_s=30, most_s=40))
    return c.select("cycle_s", "n", w.alias("w")).select("cycle_s", "n", "w.complete", "w.reason", "w.ready")


@query(
    "gaps_and_islands",
    f"""WITH s AS (SELECT *, value > 30 AS up FROM ({SCANS_SQL})), f AS (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY radar ORDER BY t, scan_id) THEN 0 ELSE 1 END AS nw FROM s),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY radar ORDER BY t, scan_id) AS g FROM f) SELECT radar, up, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM i GROUP BY radar, g, up""",
)
def gaps_and_islands(spark, sf_dir):
    s = scans(spark, sf_dir).withColumns({"up": F.col("value") > 30, "place": F.col("t") * 1_000_000 + F.col("scan_id")})
    i = seq.islands(s, ["radar"], "place", F.col("up"))
    return i.groupBy("radar", "island", "up").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n")).drop("island")


@query(
    "bridged_segments",
    f"""WITH v AS (SELECT ray, gate, CASE WHEN gate - lag(gate) OVER (PARTITION BY ray ORDER BY gate) <= 2 THEN 0 ELSE 1 END AS nw FROM ({GATES_SQL}) WHERE partial IS NOT NULL AND partial < 0.6),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY ray ORDER BY gate) AS g FROM v) SELECT ray, min(gate) AS first, max(gate) AS last, count(*) AS valid_count FROM i GROUP BY ray, g""",
)
def bridged_segments(spark, sf_dir):
    g = gates(spark, sf_dir).withColumn("ok", F.coalesce(F.col("partial") < 0.6, F.lit(False)))
    return seq.bridged(g, ["ray"], "gate", "ok", 1)


@query(
    "running_max",
    f"""SELECT ray, gate, partial, CASE WHEN max(CASE WHEN partial IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN max(partial) OVER w END AS cumulative FROM ({GATES_SQL}) WINDOW w AS (PARTITION BY ray ORDER BY gate ROWS UNBOUNDED PRECEDING)""",
)
def running_max(spark, sf_dir):
    return seq.running_blockage(gates(spark, sf_dir), ["ray"], "gate", "partial").select("ray", "gate", "partial", "cumulative")


@query(
    "cumulative_trapezoid",
    f"""WITH g AS (SELECT *, sum(CASE WHEN partial IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY ray ORDER BY gate) AS r FROM ({GATES_SQL})),
    a AS (SELECT *, coalesce((partial + lag(partial) OVER w) / 2 * (km - lag(km) OVER w), 0) AS area FROM g WINDOW w AS (PARTITION BY ray, r, partial IS NULL ORDER BY gate))
    SELECT ray, gate, CASE WHEN partial IS NOT NULL THEN round(CAST(2 * sum(area) OVER (PARTITION BY ray, r, partial IS NULL ORDER BY gate) AS DOUBLE), 6) END AS pia FROM a""",
)
def cumulative_trapezoid(spark, sf_dir):
    return seq.two_way_path(gates(spark, sf_dir), ["ray"], "km", "partial").select("ray", "gate", F.round("pia", 6).alias("pia"))


@query(
    "zphi_path",
    f"""WITH g AS (SELECT *, pow(10.0, dbzh * 0.078) AS z, 5.0 + ray % 40 AS dp FROM ({GATES_SQL})), a AS (SELECT *, coalesce((z + lag(z) OVER w) / 2 * (km - lag(km) OVER w), 0) AS area FROM g WINDOW w AS (PARTITION BY ray ORDER BY gate)),
    j AS (SELECT *, sum(area) OVER (PARTITION BY ray ORDER BY gate) AS j, sum(area) OVER (PARTITION BY ray) AS e, ln(10) * 0.078 AS k FROM a)
    SELECT ray, gate, abs(round(CAST(-ln(1 - (1 - exp(-k * 0.3 * dp)) * CASE WHEN e > 0 THEN j / e ELSE 0 END) / k AS DOUBLE), 5)) AS pia FROM j""",
)
def zphi_path(spark, sf_dir):
    g = gates(spark, sf_dir).withColumn("dp", F.lit(5.0) + F.col("ray") % 40)
    return seq.zphi(g, ["ray"], "km", "dbzh", "dp", 0.3, 0.78).select("ray", "gate", F.abs(F.round("pia", 5)).alias("pia"))


@query(
    "phase_unwrap",
    f"""WITH g AS (SELECT *, phase - lag(phase) OVER (PARTITION BY ray ORDER BY gate) AS jump FROM ({GATES_SQL})),
    t AS (SELECT *, CASE WHEN jump > 180 THEN -1 WHEN jump < -180 THEN 1 ELSE 0 END AS turns FROM g) SELECT ray, gate, CAST(phase + 360 * sum(turns) OVER (PARTITION BY ray ORDER BY gate) AS DOUBLE) AS unwrapped FROM t""",
)
def phase_unwrap(spark, sf_dir):
    return seq.unwrapped(gates(spark, sf_dir), ["ray"], "gate", "phase").select("ray", "gate", "unwrapped")


@query(
    "moving_statistics",
    f"""SELECT ray, gate, round(avg(dbzh) OVER w, 6) AS mean, round(stddev_pop(dbzh) OVER w, 6) AS deviation, round(count(dbzh) OVER w / 3.0, 6) AS available FROM ({GATES_SQL}) WINDOW w AS (PARTITION BY ray ORDER BY gate ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def moving_statistics(spark, sf_dir):
    m = seq.moving(gates(spark, sf_dir), ["ray"], "gate", "dbzh", 1)
    return m.select("ray", "gate", *[F.round(c, 6).alias(c) for c in ("mean", "deviation", "available")])


@query(
    "local_slope",
    f"""SELECT ray, gate, round(regr_slope(phase, km) OVER w, 5) AS slope FROM ({GATES_SQL}) WINDOW w AS (PARTITION BY ray ORDER BY km ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) QUALIFY count(*) OVER w > 1""",
)
def local_slope(spark, sf_dir):
    s = seq.slope(gates(spark, sf_dir), ["ray"], "km", "phase", 2)
    n = F.count("*").over(Window.partitionBy("ray").orderBy("km").rowsBetween(-2, 2))
    return s.withColumn("_n", n).filter("_n > 1").select("ray", "gate", F.round("slope", 5).alias("slope"))


@query(
    "time_interpolation",
    f"""WITH g AS (SELECT ray, gate, CAST(gate * 360 AS BIGINT) AS t, CASE WHEN gate % 2 = 0 OR dbzh < 5 THEN NULL ELSE dbzh END AS v FROM ({GATES_SQL})),
    k AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t0, last_value(v IGNORE NULLS) OVER a AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t1, first_value(v IGNORE NULLS) OVER b AS v1
    FROM g WINDOW a AS (PARTITION BY ray ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY ray ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT ray, gate, round(CASE WHEN v IS NOT NULL THEN v ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS filled FROM k""",
)
def time_interpolation(spark, sf_dir):
    g = gates(spark, sf_dir).withColumns({"t": (F.col("gate") * 360).cast("long"), "v": F.when((F.col("gate") % 2 == 0) | (F.col("dbzh") < 5), None).otherwise(F.col("dbzh"))})
    return seq.interpolated(g, ["ray"], "t", "v").select("ray", "gate", F.round("filled", 6).alias("filled"))


@query(
    "fixed_windows",
    f"""WITH f AS (SELECT DISTINCT radar, t // 3600 * 3600 AS t FROM ({SCANS_SQL})), w AS (SELECT radar, t AS start_s, lead(t, 3) OVER (PARTITION BY radar ORDER BY t) AS end_s FROM f)
    SELECT radar, start_s, end_s, sha256(radar || '|' || start_s || '|' || end_s) AS window_id FROM w WHERE end_s - start_s = 10800""",
)
def fixed_windows(spark, sf_dir):
    f = scans(spark, sf_dir).select("radar", (F.floor(F.col("t") / 3600) * 3600).cast("long").alias("t"))
    return seq.fixed_windows(f, ["radar"], "t", 3600, 4)


@query(
    "complete_blocks",
    f"""WITH h AS (SELECT radar, t // 3600 AS hour, max(value) AS v FROM ({SCANS_SQL}) GROUP BY 1, 2), b AS (SELECT radar, hour, avg(v) OVER w AS m, max(v) OVER w AS x, count(v) OVER w AS n FROM h WINDOW w AS (PARTITION BY radar ORDER BY hour RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT radar, hour, round(m, 6) AS block_mean, x AS block_max FROM b WHERE n = 3""",
)
def complete_blocks(spark, sf_dir):
    h = scans(spark, sf_dir).groupBy("radar", F.floor(F.col("t") / 3600).cast("long").alias("hour")).agg(F.max("value").alias("v"))
    return seq.complete_blocks(h, ["radar"], "hour", "v", 1, 1).select("radar", "hour", F.round("block_mean", 6).alias("block_mean"), "block_max")


@query(
    "neighbour_rays",
    f"""WITH v AS (SELECT ray % 16 AS sweep, CAST(ray % 360 AS INTEGER) AS azimuth, max(dbzh) AS value FROM ({GATES_SQL}) GROUP BY 1, 2)
    SELECT v.sweep, v.azimuth, v.value, l.value AS "left", r.value AS "right" FROM v LEFT JOIN v l ON l.sweep = v.sweep AND l.azimuth = (v.azimuth + 359) % 360 LEFT JOIN v r ON r.sweep = v.sweep AND r.azimuth = (v.azimuth + 1) % 360""",
)
def neighbour_rays(spark, sf_dir):
    v = gates(spark, sf_dir).groupBy((F.col("ray") % 16).alias("sweep"), (F.col("ray") % 360).cast("int").alias("azimuth")).agg(F.max("dbzh").alias("value"))
    return seq.neighbours(v, ["sweep"], "azimuth", "value", F.lit(360)).select("sweep", "azimuth", "value", "left", "right")


@query(
    "vertical_neighbour",
    f"""SELECT y, x, sweep, dbzh, lead(dbzh) OVER (PARTITION BY y, x ORDER BY sweep) AS above FROM (SELECT ray % 40 AS y, gate AS x, ray // 40 % 5 AS sweep, max(dbzh) AS dbzh FROM ({GATES_SQL}) GROUP BY 1, 2, 3)""",
)
def vertical_neighbour(spark, sf_dir):
    g = gates(spark, sf_dir).groupBy((F.col("ray") % 40).alias("y"), F.col("gate").alias("x"), (F.floor(F.col("ray") / 40) % 5).cast("long").alias("sweep")).agg(F.max("dbzh").alias("dbzh"))
    return g.withColumn("above", F.lead("dbzh").over(Window.partitionBy("y", "x").orderBy("sweep")))


@query(
    "largest_azimuth_gap",
    f"""WITH a AS (SELECT DISTINCT ray % 50 AS sweep, phase AS az FROM ({GATES_SQL})), n AS (SELECT *, lead(az) OVER (PARTITION BY sweep ORDER BY az) - az AS gap FROM a)
    SELECT sweep, CASE WHEN count(*) < 2 THEN 360 ELSE greatest(max(gap), min(az) + 360 - max(az)) END AS gap FROM n GROUP BY sweep""",
)
def largest_azimuth_gap(spark, sf_dir):
    a = gates(spark, sf_dir).select((F.col("ray") % 50).alias("sweep"), bs.pmod_deg(F.col("phase")).alias("az")).distinct()
    n = a.withColumn("gap", F.lead("az").over(Window.partitionBy("sweep").orderBy("az")) - F.col("az"))
    wrap = F.min("az") + F.lit(360.0) - F.max("az")
    return n.groupBy("sweep").agg(F.when(F.count("*") < 2, F.lit(360.0)).otherwise(F.greatest(F.max("gap"), wrap)).alias("gap"))


@query(
    "mad_texture",
    f"""WITH m AS (SELECT ray, median(dbzh) AS m FROM ({GATES_SQL}) GROUP BY 1) SELECT g.ray, round(1.4826 * median(abs(dbzh - m)), 6) AS texture, round(count(*) / 7.0, 6) AS support FROM ({GATES_SQL}) g JOIN m ON g.ray = m.ray GROUP BY 1""",
)
def mad_texture(spark, sf_dir):
    """Scaled median distance from the median, from one aggregation: the values
    of a neighbourhood (at most a window's) are an array."""
    g = gates(spark, sf_dir).groupBy("ray").agg(F.collect_list("dbzh").alias("v"))
    middle = lambda a: (F.element_at(F.array_sort(a), (F.floor((F.size(a) + 1) / 2)).cast("int")) + F.element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int"))) / F.lit(2.0)
    g = g.withColumn("m", middle(F.col("v"))).withColumn("d", F.transform("v", lambda x: F.abs(x - F.col("m"))))
    return g.select("ray", F.round(F.lit(1.4826) * middle(F.col("d")), 6).alias("texture"), F.round(F.size("v") / F.lit(7.0), 6).alias("support"))


@query(
    "circular_variance",
    f"""SELECT ray, round(1 - sqrt(pow(avg(cos(radians(phase))), 2) + pow(avg(sin(radians(phase))), 2)), 6) AS variance FROM ({GATES_SQL}) GROUP BY 1""",
)
def circular_variance(spark, sf_dir):
    a = F.radians("phase")
    return gates(spark, sf_dir).groupBy("ray").agg(F.round(F.lit(1.0) - F.hypot(F.avg(F.cos(a)), F.avg(F.sin(a))), 6).alias("variance"))


@query(
    "split_assignment",
    f"""SELECT CASE WHEN t % 2592000 < 1296000 THEN 'training' WHEN t % 2592000 < 1944000 THEN 'development' ELSE 'reserve' END AS split, count(*) AS n FROM ({SCANS_SQL}) GROUP BY 1""",
)
def split_assignment(spark, sf_dir):
    t = F.col("t") % 2592000
    return scans(spark, sf_dir).groupBy(F.when(t < 1296000, "training").when(t < 1944000, "development").otherwise("reserve").alias("split")).agg(F.count("*").alias("n"))


@query(
    "state_machine_check",
    f"""WITH p AS (SELECT radar, t, scan_id, status, lag(status) OVER (PARTITION BY radar ORDER BY t, scan_id) AS before FROM ({SCANS_SQL}))
    SELECT before, status, before IS NULL OR before = status OR (before <> 'purchase' AND (status = 'error' OR (before = 'view' AND status = 'click') OR (before = 'click' AND status = 'signup') OR (before = 'signup' AND status = 'purchase'))) AS legal, count(*) AS n FROM p GROUP BY 1, 2, 3""",
)
def state_machine_check(spark, sf_dir):
    from hydrolith.streaming.cycles import legal_move

    w = Window.partitionBy("radar").orderBy("t", "scan_id")
    p = scans(spark, sf_dir).withColumn("before", F.lag("status").over(w))
    moves = {"view": ["click"], "click": ["signup"], "signup": ["purchase"]}
    return p.groupBy("before", "status", legal_move(F.col("before"), F.col("status"), moves, ["purchase"], ["error"]).alias("legal")).agg(F.count("*").alias("n"))


@query(
    "cadence_thinning",
    f"""WITH r AS (SELECT radar, t // 21600 * 21600 AS slot_s, scan_id, row_number() OVER (PARTITION BY radar, t // 21600 ORDER BY t, scan_id) AS n FROM ({SCANS_SQL})) SELECT radar, slot_s, min(CASE WHEN n = 1 THEN scan_id END) AS kept, count(*) - 1 AS omitted FROM r GROUP BY 1, 2""",
)
def cadence_thinning(spark, sf_dir):
    """The first volume of each slot, and how many are left out."""
    s = scans(spark, sf_dir).withColumn("slot_s", (F.floor(F.col("t") / 21600) * 21600).cast("long"))
    return s.groupBy("radar", "slot_s").agg(F.min_by("scan_id", F.struct("t", "scan_id")).alias("kept"), (F.count("*") - 1).alias("omitted"))


@query(
    "beam_geometry",
    f"""WITH g AS (SELECT ray, gate, CAST(gate AS DOUBLE) * 15000 AS r, CAST(ray % 20 AS DOUBLE) / 2 AS e, 6371000 * CAST(4 AS DOUBLE) / 3 AS a FROM ({GATES_SQL})), h AS (SELECT *, sqrt(r * r + a * a + 2 * r * a * sin(radians(e))) - a AS height FROM g)
    SELECT ray, gate, round(height, 3) AS height, round(a * asin(r * cos(radians(e)) / (a + height)), 3) AS arc, round(r * tan(radians(0.5)), 3) AS radius FROM h""",
)
def beam_geometry(spark, sf_dir):
    g = gates(spark, sf_dir).select("ray", "gate", (F.col("gate") * 15000.0).alias("r"), ((F.col("ray") % 20).cast("double") / 2).alias("e"))
    return g.select("ray", "gate", F.round(ph.beam_height(F.col("r"), F.col("e")), 3).alias("height"), F.round(ph.ground_arc(F.col("r"), F.col("e")), 3).alias("arc"), F.round(ph.beam_radius(F.col("r")), 3).alias("radius"))


@query(
    "beam_blockage",
    """WITH g AS (SELECT l_orderkey AS ray, l_linenumber AS gate, CAST(l_partkey % 900 AS DOUBLE) AS terrain, 450.0 + l_linenumber AS centre, 100.0 + l_suppkey % 50 AS radius FROM lineitem), n AS (SELECT *, (terrain - centre) / radius AS u FROM g)
    SELECT ray, gate, round(CASE WHEN u <= -1 THEN 0.0 WHEN u >= 1 THEN 1.0 ELSE (u * sqrt(greatest(0.0, 1 - u * u)) + asin(u) + pi() / 2) / pi() END, 6) AS blocked FROM n""",
)
def beam_blockage(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS ray", "l_linenumber AS gate", "CAST(l_partkey % 900 AS DOUBLE) AS terrain", "450.0D + l_linenumber AS centre", "100.0D + l_suppkey % 50 AS radius")
    return g.select("ray", "gate", F.round(ph.partial_blockage(F.col("terrain"), F.col("centre"), F.col("radius")), 6).alias("blocked"))
