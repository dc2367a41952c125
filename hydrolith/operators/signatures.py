"""Signatures of a source's power with range, by interval and by blocks held out.

Gates are as in ``objects``; windows and groups are over one ray of one sweep.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.operators.objects import angular_width, half, intervals, linked, members, placed


# The detectors' default parameters.
@dataclass(frozen=True)
class Signature:
    rays: int = 360
    gates: int = 1000
    spacing_m: float = 250.0
    minimum_range_m: float = 20_000.0
    echo_dbz: float = 10.0
    span_m: float = 100_000.0
    measured_m: float = 80_000.0
    growth_db: float = 10.0
    log_span_db: float = 8.0
    high_dbz: float = 45.0
    high_fraction: float = 0.6
    gap_m: float = 1000.0
    gap_fraction: float = 0.10
    residual_p90_db: float = 2.5
    gate_residual_db: float = 3.5
    fit_span_m: float = 50_000.0
    fit_samples: int = 30
    plateau_m: float = 20_000.0
    tolerance_db: float = 0.26
    spread_db: float = 0.02
    plateau_dbz: float = 60.0
    width_deg: float = 70.0
    aspect: float = 2.0
    link_residual_db: float | None = None
    link_gap_m: float = 2000.0
    link_fraction: float = 0.2


@dataclass(frozen=True)
class Broad:
    rays: int = 360
    spacing_m: float = 250.0
    block_m: float = 50_000.0
    minimum_range_m: float = 50_000.0
    maximum_range_m: float = 450_000.0
    blocks: int = 5
    block_span_m: float = 7500.0
    reference_span_m: float = 200_000.0
    residual_db: float = 2.5
    stationary_db: float = 2.0
    snr_db: float = 20.0
    least_snr_db: float = 8.0
    samples: int = 100
    phase_p90_deg: float = 10.0
    zdr_p90_db: float = 1.0
    neighbour_deg: float = 5.0
    span_deg: float = 3.0
    neighbours: int = 3
    neighbour_db: float = 3.0
    plateau_m: float = 25_000.0
    plateau_dbz: float = 55.0


#: Bits of a gate's reason in the broad source model.
BROAD_REASONS = dict(fit=1, agreement=2, match=4, protected=8, conflict=16, plateau=32)


def log_range() -> Column:
    return F.lit(20.0) * F.log10(F.col("range_m") / 1000.0)


def fitted(gates: DataFrame, sweep: list[str], p: Signature = Signature()) -> DataFrame:
    """The gates of the long intervals of echo along rays, with the fit of their
    interval: part, mode, intercept, residual, p90_db, growth and why (null if it
    fits, else what it failed first).

    The value follows 20 log10 of range. mode 1: freely; 2: up to the sweep's
    ``ceiling``, where gates at it only bound the value from below (a value over it is
    a contradiction); 3: up to a flat tail, which may be a ceiling that nobody has
    told. Without an echo of the least length there are no rows; a missing gate may be
    bridged, an observed one without echo ends an interval. The intercept is a median,
    so a share of wild gates does not move it."""
    ray = [*sweep, "ray"]
    dr = p.spacing_m
    g = placed(gates, sweep).filter("dbzh IS NOT NULL").withColumn("echo", (F.col("dbzh") >= p.echo_dbz) & (F.col("range_m") >= p.minimum_range_m))
    parts = intervals(g, ray, F.col("echo"), ~F.col("echo"), int(p.gap_m // dr), p.gap_fraction)
    parts = parts.filter(((F.col("last") - F.col("first") + 1) * dr >= p.span_m) & (F.col("n") * dr >= p.measured_m))
    w = Window.partitionBy(*ray, "part")
    m = members(g, parts, ray).withColumns({"i": F.row_number().over(w.orderBy("gate")), "x": log_range()})
    tail = F.col("i") > F.col("n") - max(3, -int(-p.plateau_m // dr))
    last = F.when(tail, F.col("dbzh"))
    m = m.withColumns({"_flat": half(last).over(w), "_spread": F.max(last).over(w) - F.min(last).over(w), "_top": F.max("dbzh").over(w), "_end": F.max("range_m").over(w)})
    m = m.withColumn("_from", F.coalesce(F.max(F.when(F.abs(F.col("dbzh") - F.col("_flat")) > p.spread_db / 2, F.col("i"))).over(w), F.lit(0)) + 1)
    begins = F.max(F.when(F.col("i") == F.col("_from"), F.col("range_m"))).over(w)
    flat = (F.col("_flat") >= p.plateau_dbz) & (F.col("_spread") <= p.spread_db) & (F.col("_end") - begins >= p.plateau_m) & (F.col("_top") <= F.col("_flat") + p.tolerance_db)
    m = m.withColumn("mode", F.when(F.col("ceiling").isNotNull(), 2).when(F.coalesce(flat, F.lit(False)), 3).otherwise(1))
    m = m.withColumn("cap", F.when(F.col("mode") == 2, F.col("ceiling")).when(F.col("mode") == 3, F.col("_flat")))
    m = m.withColumn("_cut", F.coalesce(F.col("dbzh") >= F.col("cap") - p.tolerance_db, F.lit(False)))
    free = lambda c: F.when(~F.col("_cut"), c)
    spread = lambda c: F.max(free(F.col(c))).over(w) - F.min(free(F.col(c))).over(w)
    m = m.withColumns({"intercept": half(free(F.col("dbzh") - F.col("x"))).over(w), "_n": F.count(free(F.col("x"))).over(w), "_rs": spread("range_m"), "_xs": spread("x")})
    off = lambda c: F.col(c) - F.col("intercept") - F.col("x")  # noqa: E731  in this order: limits are met to the last bit
    m = m.withColumn("residual", F.when(F.col("_cut"), F.greatest(off("cap"), F.lit(0.0))).otherwise(F.abs(off("dbzh"))))
    fifth = F.greatest(F.lit(3), F.floor(F.col("n") / 5))
    m = m.withColumns({
        "p90_db": F.percentile("residual", F.lit(0.9)).over(w), "_high": F.avg((F.col("dbzh") >= p.high_dbz).cast("double")).over(w),
        "growth": half(F.when(F.col("i") > F.col("n") - fifth, F.col("dbzh"))).over(w) - half(F.when(F.col("i") <= fifth, F.col("dbzh"))).over(w),
    })
    why = (
        F.when((F.col("mode") == 2) & (F.col("_top") > F.col("cap") + p.tolerance_db), "over_ceiling").when(F.col("_n") < p.fit_samples, "few_samples")
        .when((F.col("_rs") < p.fit_span_m) | (F.col("_xs") < p.log_span_db), "short_range").when(F.col("p90_db") > p.residual_p90_db, "shape").when(F.col("growth") < p.growth_db, "growth").when(F.col("_high") < p.high_fraction, "weak")
    )
    return m.withColumn("why", why).select(*gates.columns, "part", "first", "last", "mode", "cap", "intercept", "residual", "p90_db", "growth", "why")


def range_objects(gates: DataFrame, sweep: list[str], p: Signature = Signature()) -> tuple[DataFrame, DataFrame]:
    """Objects of ``fitted`` gates, and their gates.

    A gate that does not fit is no part of its object: the inliers of an interval are
    cut into intervals again, and with ``p.link_residual_db`` outliers up to it, which
    are not ``protected``, are crossed as links. Intervals that are long enough and
    share a gate with one on the next ray are one object, which is narrow and longer
    than wide. Objects: object, rays, width_deg, first, last, span_m, aspect, gates,
    p90_db (the most), modes. Gates: ray, gate, object, mode, p90_db, growth, linked."""
    ray = [*sweep, "ray"]
    dr = p.spacing_m
    f = fitted(gates, sweep, p).filter("why IS NULL").drop("first", "last")
    good = F.col("residual") <= p.gate_residual_db
    cross = F.lit(False) if p.link_residual_db is None else ~good & (F.col("residual") <= p.link_residual_db) & ~F.coalesce(F.col("protected"), F.lit(False))
    gap, fraction = (p.gap_m, p.gap_fraction) if p.link_residual_db is None else (p.link_gap_m, p.link_fraction)
    f = f.withColumns({"_good": good, "_cross": cross}).withColumnRenamed("part", "_part")
    parts = intervals(f, [*ray, "_part"], F.col("_good"), ~F.col("_good") & ~F.col("_cross"), int(gap // dr), fraction).filter(F.col("n") * dr >= p.measured_m)
    parts = linked(parts, sweep, p.rays, 1)
    inner = members(f, parts.drop("n"), [*ray, "_part"]).filter("_good OR _cross")
    own = inner.filter("_good")
    reach = own.groupBy(*sweep, "object").agg(F.min("range_m").alias("_near"), F.max("range_m").alias("_far"), F.max("p90_db").alias("p90_db"), F.count("*").alias("gates"), F.array_sort(F.collect_set("mode")).alias("modes"))
    o = parts.groupBy(*sweep, "object").agg(F.array_sort(F.collect_set("ray")).alias("_rays"), F.min("first").alias("first"), F.max("last").alias("last"), (F.max(F.col("last") - F.col("first") + 1) * dr).alias("span_m"))
    o = o.join(reach, [*sweep, "object"]).withColumn("width_deg", angular_width(F.col("_rays"), p.rays))
    o = o.withColumn("aspect", F.col("span_m") / F.greatest(F.lit(dr), (F.col("_near") + F.col("_far")) / 2 * F.radians("width_deg"))).filter((F.col("width_deg") <= p.width_deg) & (F.col("aspect") >= p.aspect))
    kept = inner.join(o.select(*sweep, "object"), [*sweep, "object"], "left_semi")
    return o.select(*sweep, "object", F.size("_rays").alias("rays"), "width_deg", "first", "last", "span_m", "aspect", "gates", "p90_db", "modes"), kept.select(*ray, "gate", "object", "mode", "p90_db", "growth", F.col("_cross").alias("linked"))


def plateaus(gates: DataFrame, ray: list[str], p: Broad, name: str) -> DataFrame:
    """Adds ``name``: the gate is in a run of one equal value, high and long."""
    o = Window.partitionBy(*ray).orderBy("gate")
    same = (F.col("gate") - F.lag("gate").over(o) == 1) & (F.abs(F.col("dbzh") - F.lag("dbzh").over(o)) < 1e-6) & (F.col("dbzh") >= p.plateau_dbz)
    g = gates.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(o))
    run = Window.partitionBy(*ray, "_run")
    return g.withColumn(name, (F.count("*").over(run) > 1) & (F.max("range_m").over(run) - F.min("range_m").over(run) >= p.plateau_m)).drop("_new", "_run")


def wrapped(deg: Column) -> Column:
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def broad_folds(gates: DataFrame, sweep: list[str], p: Broad = Broad()) -> DataFrame:
    """The source model of each ray and target block, from the ray's other blocks but
    those beside it: intercept, phase_deg and bounds of snr, phase, zdr and rho (5 and
    95 per cent), left and right (rays on either side, one after another, whose model
    for the block is near) and agrees.

    A block teaches if it is measured long enough; a model needs enough blocks,
    samples and span, a small residual, and steady snr, phase and zdr. What the target
    and its neighbours hold never counts. Gates need all moments."""
    ray = [*sweep, "ray"]
    w = Window.partitionBy(*ray, "t")
    v = _measured(gates, sweep, p).filter((F.col("range_m") >= p.minimum_range_m) & (F.col("range_m") < p.maximum_range_m))
    v = plateaus(v, [*ray, "block"], p, "_flat").filter("NOT _flat")
    blocks = int((p.maximum_range_m - p.minimum_range_m - 1e-9) // p.block_m) + 1
    targets = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda t: F.abs(t - F.col("block")) > 1)
    t = v.withColumn("t", F.explode(targets)).withColumn("_b", F.count("*").over(Window.partitionBy(*ray, "t", "block"))).filter(F.col("_b") * p.spacing_m >= p.block_span_m)
    t = t.withColumns({"intercept": half(F.col("power")).over(w), "phase_deg": F.degrees(F.atan2(F.avg(F.sin(F.radians("phidp"))).over(w), F.avg(F.cos(F.radians("phidp"))).over(w))), "_z": half(F.col("zdr")).over(w)})
    t = t.withColumn("pc", wrapped(F.col("phidp") - F.col("phase_deg")))
    level = t.groupBy(*ray, "t", "block").agg(half(F.col("snr")).alias("m")).withColumn("_mid", half(F.col("m")).over(w)).groupBy(*ray, "t").agg(F.count("*").alias("n_blocks"), F.first("_mid").alias("_snr"), F.percentile(F.abs(F.col("m") - F.col("_mid")), F.lit(0.9)).alias("_steady"))
    ends = lambda c: F.percentile(c, F.array(F.lit(0.05), F.lit(0.95)))
    p90 = lambda c: F.percentile(F.abs(c), F.lit(0.9))
    f = t.groupBy(*ray, "t").agg(
        F.first("intercept").alias("intercept"), F.first("phase_deg").alias("phase_deg"), F.count("*").alias("samples"), (F.max("range_m") - F.min("range_m")).alias("_span"), p90(F.col("power") - F.col("intercept")).alias("p90_db"),
        p90(F.col("pc")).alias("_pp"), p90(F.col("zdr") - F.col("_z")).alias("_zp"), ends(F.col("pc")).alias("pc"), ends(F.col("zdr")).alias("zdr"), ends(F.col("rhohv")).alias("rho"), ends(F.col("snr")).alias("snr"),
    ).join(level, [*ray, "t"])
    f = f.filter((F.col("n_blocks") >= p.blocks) & (F.col("samples") >= p.samples) & (F.col("_span") >= p.reference_span_m) & (F.col("p90_db") <= p.residual_db) & (F.col("_snr") >= p.snr_db) & (F.col("_steady") <= p.stationary_db) & (F.col("_pp") <= p.phase_p90_deg) & (F.col("_zp") <= p.zdr_p90_db))
    f = f.select(*ray, "t", "n_blocks", "samples", "intercept", "phase_deg", "p90_db", "pc", "zdr", "rho", "snr")
    most = min(int(p.neighbour_deg * p.rays / 360 + 1e-9), (p.rays - 1) // 2)
    sent = f.select(*sweep, "t", F.col("intercept").alias("_i"), F.col("ray").alias("_ray"), F.explode(F.array(*[F.lit(s * k) for k in range(1, most + 1) for s in (1, -1)])).alias("d")).withColumn("ray", F.pmod(F.col("_ray") - F.col("d"), F.lit(p.rays)))
    near = f.select(*ray, "t", "intercept").join(sent, [*ray, "t"]).filter(F.abs(F.col("_i") - F.col("intercept")) <= p.neighbour_db)
    upto = lambda s: F.size(F.filter(F.array_sort(F.collect_list(F.when(F.signum("d") == s, F.abs("d")))), lambda x, i: x == i + 1))
    side = near.groupBy(*ray, "t").agg(upto(1).alias("right"), upto(-1).alias("left"))
    f = f.join(side, [*ray, "t"], "left").na.fill(0, ["left", "right"])
    return f.withColumn("agrees", (F.col("left") + F.col("right") + 1 >= p.neighbours) & ((F.col("left") + F.col("right")) * (360.0 / p.rays) >= p.span_deg))


def _measured(gates: DataFrame, sweep: list[str], p: Broad) -> DataFrame:
    v = placed(gates, sweep).filter((F.col("snr") >= p.least_snr_db) & F.col("dbzh").isNotNull() & F.col("rhohv").isNotNull() & F.col("zdr").isNotNull() & F.col("phidp").isNotNull())
    return v.withColumns({"power": F.col("dbzh") - log_range(), "block": F.floor((F.col("range_m") - p.minimum_range_m) / p.block_m).cast("int")})


def broad_source(gates: DataFrame, sweep: list[str], p: Broad = Broad()) -> DataFrame:
    """Measured gates in blocks for which their ray has a model: residual_db (null
    without agreement of neighbours), reason (bits of ``BROAD_REASONS``) and candidate:
    like the model in all moments, not ``protected`` by weather, no ``conflict`` and no
    plateau. Nulls of the two are false."""
    ray = [*sweep, "ray"]
    seen = plateaus(placed(gates, sweep).filter("dbzh IS NOT NULL"), ray, p, "plateau")
    v = _measured(seen, sweep, p).filter((F.col("range_m") >= p.minimum_range_m) & (F.col("range_m") < p.maximum_range_m))
    f = broad_folds(gates, sweep, p).withColumnsRenamed({"pc": "_pc", "zdr": "_zdr", "rho": "_rho", "snr": "_snr", "t": "block"})
    g = v.join(f, [*ray, "block"])
    delta = F.col("power") - F.col("intercept")
    within = lambda c, b, slack: (c >= F.get(b, 0) - slack) & (c <= F.get(b, 1) + slack)
    like = (F.abs(delta) <= p.residual_db) & within(F.col("snr"), F.col("_snr"), 1.0) & within(wrapped(F.col("phidp") - F.col("phase_deg")), F.col("_pc"), 0.5) & within(F.col("zdr"), F.col("_zdr"), 0.125)
    like = like & (F.col("rhohv") >= F.greatest(F.lit(0.0), F.get("_rho", 0) - 0.01)) & (F.col("rhohv") <= F.least(F.lit(1.0), F.get("_rho", 1) + 0.01))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = g.withColumns({"_match": F.col("agrees") & like, "residual_db": F.when(F.col("agrees"), delta)})
    b = BROAD_REASONS
    on = lambda c, name: F.when(c, b[name]).otherwise(0)
    reason = F.lit(b["fit"]).bitwiseOR(on(F.col("agrees"), "agreement")).bitwiseOR(on(F.col("_match"), "match")).bitwiseOR(on(F.col("agrees") & ~F.col("_match"), "conflict")).bitwiseOR(on(yes("protected"), "protected")).bitwiseOR(on(F.col("plateau"), "plateau"))
    return g.select(*ray, "gate", "block", "residual_db", reason.alias("reason"), (F.col("_match") & ~yes("protected") & ~yes("conflict") & ~F.col("plateau")).alias("candidate"))
