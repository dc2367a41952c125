"""Catalogue reads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydrolith.functions import basic as bs
from hydrolith.operators import catalogue as cat
from hydrolith.plans.registry import QUERIES, SQL, load, query
from hydrolith.plans.views import SCANS_SQL, scans

__all__ = ["QUERIES", "SQL"]


@query(
    "latest_per_key",
    "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def latest_per_key(spark, sf_dir):
    """The newest row of each key; ties go to the larger id."""
    return cat.newest(load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("group_status_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_status_count(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "filtered_aggregates",
    """SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) FILTER (WHERE l_discount = 0) AS full_price,
    count(NULLIF(l_linestatus, 'O')) AS closed, round(CAST(sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS DOUBLE), 2) AS closed_quantity FROM lineitem GROUP BY l_returnflag""",
)
def filtered_aggregates(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    return line.groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.count_if(F.col("l_discount") == 0).alias("full_price"), F.count(F.nullif("l_linestatus", F.lit("O"))).alias("closed"),
        F.round(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), 2).alias("closed_quantity"),
    )


@query("semi_join_exists", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def semi_join_exists(spark, sf_dir):
    pending = load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    c = load(spark, sf_dir, "customer")
    return c.join(pending, c.c_custkey == pending.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("anti_join_unreferenced", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def anti_join_unreferenced(spark, sf_dir):
    """Customers that no urgent order refers to."""
    c, o = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query(
    "catalogue_inner_join",
    """SELECT n_name, r_name, count(*) AS customers, round(CAST(sum(c_acctbal) AS DOUBLE), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
def catalogue_inner_join(spark, sf_dir):
    """Customers are summed by nation before the dimension tables are joined."""
    sums = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    j = sums.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query(
    "left_join_optional_metrics",
    f"""WITH s AS ({SCANS_SQL}), latest AS (SELECT radar, arg_max(scan_id, t * 1000000 + scan_id % 1000000) AS scan_id FROM s GROUP BY radar),
    m AS (SELECT radar, count(*) AS errors, max(t) AS last_error FROM s WHERE status = 'error' GROUP BY radar)
    SELECT latest.radar, scan_id, errors, last_error FROM latest LEFT JOIN m ON latest.radar = m.radar""",
)
def left_join_optional_metrics(spark, sf_dir):
    s = scans(spark, sf_dir)
    key = F.col("t") * 1_000_000 + F.col("scan_id") % 1_000_000
    latest = s.groupBy("radar").agg(F.max_by("scan_id", key).alias("scan_id"))
    errors = s.filter("status = 'error'").groupBy("radar").agg(F.count("*").alias("errors"), F.max("t").alias("last_error"))
    return latest.join(errors, "radar", "left")


@query(
    "lateral_top_one",
    """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""",
)
def lateral_top_one(spark, sf_dir):
    """Each customer with the newest order, or with none."""
    top = cat.newest(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])
    c = load(spark, sf_dir, "customer").select("c_custkey")
    return c.join(top, c.c_custkey == top.o_custkey, "left").drop("o_custkey")


@query(
    "zero_preserving_group",
    """SELECT k.n AS nation, count(c_custkey) AS volumes, coalesce(round(CAST(sum(c_acctbal) AS DOUBLE), 2), 0) AS balance FROM (SELECT n_nationkey AS n FROM nation UNION SELECT c_nationkey FROM customer) k LEFT JOIN customer ON c_nationkey = k.n GROUP BY k.n""",
)
def zero_preserving_group(spark, sf_dir):
    stations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    volumes = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return cat.zero_preserving(stations, volumes, "nation", [F.coalesce(F.round(F.sum("c_acctbal"), 2), F.lit(0.0)).alias("balance")])


@query(
    "keyset_page",
    """SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-06-01', 1000) AND o_orderdate >= TIMESTAMP '1993-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51""",
)
def keyset_page(spark, sf_dir):
    """A page of 50 and one row that tells of a next page."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    after = (F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"), F.lit(1000).cast("long"))
    return cat.page(o, "o_orderdate", "o_orderkey", after, 50, F.col("o_orderdate") >= F.lit("1993-01-01 00:00:00").cast("timestamp_ntz"))


@query(
    "retention_rank",
    """SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS kind_rank,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS version_rank FROM orders""",
)
def retention_rank(spark, sf_dir):
    r = cat.retention_ranks(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return r.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("kind_rank").cast("long"), F.col("version_rank").cast("long"))


@query(
    "version_retention_plan",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 3",
)
def version_retention_plan(spark, sf_dir):
    return cat.expired(load(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(
    "nearest_rank_quantiles",
    """SELECT l_shipmode_like AS kind, count(v) AS samples, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS maximum FROM
    (SELECT l_returnflag || l_linestatus AS l_shipmode_like, CASE WHEN l_quantity - 3 >= 0 THEN l_quantity - 3 END AS v FROM lineitem) GROUP BY 1""",
)
def nearest_rank_quantiles(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.col("l_quantity") - 3).alias("elapsed"))
    return cat.runtimes(line, ["kind"], "elapsed")


@query(
    "stage_trend_buckets",
    f"""SELECT status, t // 1800 * 1800 AS bucket_s, median(value) AS median_value, count(*) AS n, count(*) FILTER (WHERE value < 5) AS failures FROM ({SCANS_SQL}) GROUP BY 1, 2""",
)
def stage_trend_buckets(spark, sf_dir):
    s = scans(spark, sf_dir).withColumn("bucket_s", (F.floor(F.col("t") / 1800) * 1800).cast("long"))
    return s.groupBy("status", "bucket_s").agg(F.median("value").alias("median_value"), F.count("*").alias("n"), F.count_if(F.col("value") < 5).alias("failures"))


@query(
    "trend_with_empty_buckets",
    f"""WITH s AS ({SCANS_SQL}), b AS (SELECT unnest(generate_series((SELECT min(t) // 86400 FROM s), (SELECT max(t) // 86400 FROM s))) AS day), k AS (SELECT DISTINCT status FROM s),
    c AS (SELECT status, t // 86400 AS day, count(*) AS n FROM s WHERE value > 90 GROUP BY 1, 2)
    SELECT k.status, b.day, coalesce(n, 0) AS n FROM k CROSS JOIN b LEFT JOIN c ON c.status = k.status AND c.day = b.day""",
)
def trend_with_empty_buckets(spark, sf_dir):
    """Every status for every day from the first to the last, also at none; the
    series is made from two numbers and is as long as the period in days."""
    s = scans(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400).cast("long"))
    days = s.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    grid = s.select("status").distinct().withColumn("_k", F.lit(1)).join(days.withColumn("_k", F.lit(1)), "_k").drop("_k")
    n = s.filter("value > 90").groupBy("status", "day").agg(F.count("*").alias("n"))
    return grid.join(n, ["status", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query(
    "generated_series_coverage",
    f"""WITH s AS ({SCANS_SQL}), have AS (SELECT DISTINCT radar, CAST(t // 86400 % 30 + 1 AS INTEGER) AS lead FROM s)
    SELECT radar, list_sort(list_filter(generate_series(1, 30), lambda x: NOT list_contains(list(lead), x)))::VARCHAR AS missing, count(*) AS present FROM have GROUP BY radar""",
)
def generated_series_coverage(spark, sf_dir):
    """Leads of 1 to 30 that a run does not have."""
    s = scans(spark, sf_dir).withColumn("lead", (F.floor(F.col("t") / 86400) % 30 + 1).cast("int"))
    g = s.groupBy("radar").agg(F.collect_set("lead").alias("have"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(30)), "have"))
    return g.select("radar", F.concat(F.lit("["), F.array_join(missing.cast("array<string>"), ", "), F.lit("]")).alias("missing"), F.size("have").cast("long").alias("present"))


@query("json_path_group", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, max(event_id) AS last_id FROM events WHERE json_type(props, '$.k') = 'UBIGINT' OR json_type(props, '$.k') = 'BIGINT' GROUP BY 1")
def json_path_group(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("k", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"))
    return e.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query(
    "json_aggregate",
    """SELECT user_id, CAST(to_json(list({'id': event_id, 'type': event_type} ORDER BY event_id)) AS VARCHAR) AS rows FROM events WHERE value > 99 GROUP BY user_id""",
)
def json_aggregate(spark, sf_dir):
    """Filtered rows of each key as one JSON array in order."""
    e = load(spark, sf_dir, "events").filter("value > 99")
    rows = F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))))
    return e.groupBy("user_id").agg(F.to_json(rows).alias("rows"))


@query(
    "json_object_aggregate",
    "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS states FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
)
def json_object_aggregate(spark, sf_dir):
    n = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("n").cast("string"))))
    return n.groupBy("user_id").agg(F.array_join(pairs, ",").alias("states"))


@query(
    "unnest_json_array",
    """SELECT r, count(*) AS n FROM (SELECT unnest(string_split(trim('[' || l_linenumber || ',' || (l_partkey % 5) || ']', '[]'), ',')) AS r FROM lineitem) GROUP BY r""",
)
def unnest_json_array(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("["), F.col("l_linenumber"), F.lit(","), F.col("l_partkey") % 5, F.lit("]")).alias("j"))
    return line.select(F.explode(F.from_json("j", "array<string>")).alias("r")).groupBy("r").agg(F.count("*").alias("n"))


@query(
    "merge_windows",
    f"""WITH w AS (SELECT radar, t AS s, t + 3600 + scan_id % 7 * 600 AS e FROM ({SCANS_SQL})),
    f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY radar ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM w),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY radar ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT radar, min(s) AS s, max(e) AS e FROM i GROUP BY radar, g""",
)
def merge_windows(spark, sf_dir):
    w = scans(spark, sf_dir).select("radar", F.col("t").alias("s"), (F.col("t") + 3600 + F.col("scan_id") % 7 * 600).alias("e"))
    return cat.merged_windows(w, ["radar"], "s", "e")


@query(
    "half_open_windows",
    "SELECT event_type, count(*) AS n FROM events WHERE (ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-05') OR (ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21') GROUP BY 1",
)
def half_open_windows(spark, sf_dir):
    day = lambda d: F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz")
    e = load(spark, sf_dir, "events").filter(bs.in_windows(F.col("ts"), [(day("03"), day("05")), (day("20"), day("21"))]))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("allow_list", "SELECT event_id, user_id, event_type FROM events WHERE lower(event_type) IN ('click', 'error') AND value > 50")
def allow_list(spark, sf_dir):
    e = cat.allowed(load(spark, sf_dir, "events"), "event_type", [" Click", "ERROR ", "click"])
    return e.filter("value > 50").select("event_id", "user_id", "event_type")


@query("optional_predicates", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def optional_predicates(spark, sf_dir):
    o = cat.optional(load(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_custkey": None, "o_orderpriority": ""})
    return o.filter(F.col("o_orderpriority").startswith("1")).select("o_orderkey", "o_totalprice")


@query("substring_search", "SELECT p_partkey, p_name FROM part WHERE position(lower('Brand#1') IN lower(concat_ws(' ', p_name, p_brand))) > 0 AND regexp_matches(p_type, '^[A-Z]+')")
def substring_search(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.filter(bs.contains("Brand#1", F.col("p_name"), F.col("p_brand")) & F.col("p_type").rlike("^[A-Z]+")).select("p_partkey", "p_name")


@query("distinct_local_days", "SELECT user_id, count(DISTINCT CAST(ts + INTERVAL 8 HOUR AS DATE)) AS days FROM events GROUP BY user_id")
def distinct_local_days(spark, sf_dir):
    local = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"))
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(local).alias("days"))


@query(
    "run_state_rollup",
    """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS q, count(*) FILTER (WHERE o_orderstatus = 'F') AS s, count(*) FILTER (WHERE o_orderstatus = 'P') AS f FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN o_custkey % 17 = 0 THEN 'CANCELLED' WHEN o_custkey % 19 = 0 THEN 'PAUSED' WHEN q > 9 THEN 'QUEUED' WHEN f > 0 AND s > 0 THEN 'PARTIAL_SUCCESS' WHEN f > 0 THEN 'FAILED' WHEN s > 0 THEN 'SUCCEEDED' ELSE 'QUEUED' END AS state FROM c""",
)
def run_state_rollup(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    is_ = lambda x: F.count_if(F.col("o_orderstatus") == x)
    c = o.groupBy("o_custkey").agg(is_("O").alias("q"), is_("F").alias("s"), is_("P").alias("f"))
    mode = F.when(F.col("o_custkey") % 17 == 0, "CANCELLED").when(F.col("o_custkey") % 19 == 0, "PAUSED").otherwise("ACTIVE")
    none = F.lit(0)
    n = {"RUNNING": none, "COMMITTING": none, "QUEUED": F.greatest(F.col("q") - 9, F.lit(0)), "WAITING": none, "FAILED": F.col("f"), "BLOCKED": none, "SUCCEEDED": F.col("s")}
    return c.select("o_custkey", cat.run_state(mode, n).alias("state"))


@query("top_slowest", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def top_slowest(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", "user_id", "value").orderBy(F.col("value").desc(), "event_id").limit(20)


@query("nulls_last_order", "SELECT event_type, n, rank_in_kind FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY NULLIF(user_id % 3, 0) ASC NULLS LAST, user_id) AS rank_in_kind FROM events GROUP BY event_type, user_id)")
def nulls_last_order(spark, sf_dir):
    g = load(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.nullif(F.col("user_id") % 3, F.lit(0).cast("long")).asc_nulls_last(), "user_id")
    return g.withColumn("rank_in_kind", F.row_number().over(w).cast("long")).select("event_type", "n", "rank_in_kind")


@query("union_distinct_keys", "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct_keys(spark, sf_dir):
    t = [load(spark, sf_dir, name).select(F.col(c).alias("k")) for name, c in (("nation", "n_nationkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return t[0].union(t[1]).union(t[2]).distinct()


@query("union_all_catalogue", "SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2")
def union_all_catalogue(spark, sf_dir):
    one = lambda name, c: load(spark, sf_dir, name).groupBy(F.col(c).alias("nation")).agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "nation", "n")
    return one("customer", "c_nationkey").unionByName(one("supplier", "s_nationkey"))


@query("intersect_masks", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersect_masks(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("k").intersect(o.filter("o_orderstatus = 'P'").select("k"))


@query("except_masks", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_masks(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("k").subtract(o.filter("o_orderstatus = 'P'").select("k"))


@query(
    "cycle_catalogue_merge",
    """WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS run FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS analysis FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, run, analysis FROM a FULL JOIN b ON a.k = b.k""",
)
def cycle_catalogue_merge(spark, sf_dir):
    """Several tagged sources by cycle in one aggregation, no full outer join."""
    o = load(spark, sf_dir, "orders").filter("o_orderstatus IN ('F', 'O')")
    of = lambda x: F.max(F.when(F.col("o_orderstatus") == x, F.col("o_orderkey")))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(of("F").alias("run"), of("O").alias("analysis"))


@query("grouping_sets_revenue", "SELECT l_returnflag, l_linestatus, round(CAST(sum(l_quantity) AS DOUBLE), 2) AS quantity, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets_revenue(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    g = line.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus")
    return g.agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"))


@query("cube_status", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_status(spark, sf_dir):
    return load(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("rollup_days", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def rollup_days(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return e.rollup("event_type", "day").agg(F.count("*").alias("n"))


@query("revision_feed", "SELECT event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') || ':' || count(*) AS revision FROM events GROUP BY event_type")
def revision_feed(spark, sf_dir):
    """A text that changes when a kind's rows do."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.concat_ws(":", bs.iso(F.max("ts")), F.count("*").cast("string")).alias("revision"))


@query(
    "metrics_exposition",
    """SELECT 'scans_total{status="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT '# TYPE scans_total counter'""",
)
def metrics_exposition(spark, sf_dir):
    from hydrolith.sources.sinks import exposition

    n = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("value"))
    return exposition(spark, "scans_total", "counter", n, ["status"])


@query(
    "stalled_leases",
    f"""WITH s AS ({SCANS_SQL}), l AS (SELECT radar, t, lead(t) OVER (PARTITION BY radar ORDER BY t, scan_id) AS nt FROM s) SELECT radar, count(*) AS stalls, max(nt - t) AS longest_s FROM l WHERE nt - t > 7200 GROUP BY radar""",
)
def stalled_leases(spark, sf_dir):
    """Gaps between heartbeats that are longer than the lease."""
    w = Window.partitionBy("radar").orderBy("t", "scan_id")
    s = scans(spark, sf_dir).withColumn("gap", F.lead("t").over(w) - F.col("t")).filter("gap > 7200")
    return s.groupBy("radar").agg(F.count("*").alias("stalls"), F.max("gap").alias("longest_s"))


@query(
    "tolerant_metric_filter",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount * 10 - 0.5) < 0.000001 AND abs(l_tax - 0.04) < 0.000000001",
)
def tolerant_metric_filter(spark, sf_dir):
    line = load(spark, sf_dir, "lineitem")
    near = lambda c, x, e: F.abs(c - F.lit(x)) < F.lit(e)
    return line.filter(near(F.col("l_discount") * 10, 0.5, 1e-6) & near(F.col("l_tax"), 0.04, 1e-9)).select("l_orderkey", "l_linenumber", "l_discount")


@query(
    "deterministic_ids",
    """SELECT o_orderkey, sha256('["' || o_orderkey || '","' || o_orderstatus || '"]') AS digest, replace(replace(rtrim(base64(encode(o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'))), '='), '+', '-'), '/', '_') AS cycle FROM orders""",
)
def deterministic_ids(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select("o_orderkey", bs.digest(F.col("o_orderkey"), F.col("o_orderstatus")).alias("digest"), bs.cycle_id(F.col("o_orderstatus"), F.col("o_orderdate")).alias("cycle"))


@query(
    "redacted_text",
    r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(https?://|postgres(?:ql)?://)[^\s/@:]+:[^\s/@]+@', '\1[REDACTED]@', 'g'), 'Bearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [REDACTED]', 'gi'),
    '(password|passwd|secret|access_key|api_key|token|authorization)(["'']?\s*[:=]\s*["'']?)([^\s,"''}]+)', '\1\2[REDACTED]', 'gi') AS t FROM documents)
    SELECT doc_id, sha256(CASE WHEN length(t) > 8192 THEN substr(t, 1, 8192) || ' [truncated]' ELSE t END) AS redacted_sha256 FROM r""",
)
def redacted_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(bs.redact(F.col("text")), 256).alias("redacted_sha256"))
