"""Radial interference and echo evidence on rays of gates, in DataFrame steps.

A table of gates has sweep keys, ``ray`` (0 to ``rays`` - 1 around the circle),
``gate`` (0 outwards), ``range_m`` and ``dbzh``; a gate without a value, or
without a row, is not valid. Windows are over one ray or over the rays of one
sweep, which the instrument bounds. What comes out are the columns that
``evidence.decide`` takes as ``radial`` and ``structure``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.functions.basic import interpolate


# The detectors' default parameters.
@dataclass(frozen=True)
class Radial:
    rays: int = 360
    gates: int = 1000
    valid_fraction: float = 0.55
    run: int = 80
    difference_db: float = 12.0
    candidate_db: float = 12.0
    segment: int = 12
    intermittent: int = 3
    short_range_m: float = 60_000.0
    drop_db: float = 12.0
    flagged: float = 0.95
    diagnostic: float = 0.5
    broad_valid: float = 0.40
    broad_dbz: float = 45.0
    broad_fraction: float = 0.60
    broad_run: int = 350
    broad_growth_db: float = 12.0
    broad_iqr_db: float = 6.0
    context_evidence: int = 2
    persistence: float = 0.6
    veto_consistency: float = 0.6
    promotion_consistency: float = 0.2
    vertical_support: float = 0.2


@dataclass(frozen=True)
class Fans:
    gap_rays: int = 4
    seed_fraction: float = 0.30
    valid_fraction: float = 0.90
    high_dbz: float = 35.0
    high_fraction: float = 0.30
    high_run: int = 40
    growth_db: float = 6.0
    extent_valid_fraction: float = 0.35
    extent_run: int = 40
    extent_fraction: float = 0.85
    extent_ratio: float = 0.9
    edge_rays: int = 2
    edge_valid_fraction: float = 0.35
    edge_high_fraction: float = 0.2
    edge_extent_fraction: float = 0.7
    edge_extent_ratio: float = 0.8
    edge_iqr_db: float = 6.0
    edge_range_m: float = 20_000.0


@dataclass(frozen=True)
class Signature:
    echo_dbz: float = 5.0
    samples: int = 12
    span_m: float = 20_000.0
    log_span_db: float = 3.0
    residual_p90_db: float = 3.0
    growth_db: float = 3.0
    high_dbz: float = 20.0
    high_fraction: float = 0.3


Curve = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Echo:
    """Curves are knots (x, y) of coverage, delta, texture and spin, for smooth
    echoes and for rough ones, with the weights of the four."""

    spin_jump_db: float = 2.0
    rough_db2: float = 3.0
    tail_fraction: float = 0.1
    tail_support: float = 0.8
    smooth: tuple[Curve, ...] = (((90.0, 0.0), (95.0, 1.0)), ((-90.0, 0.0), (-20.0, 1.0), (50.0, 0.0)), ((0.0, 1.0), (3.0, 0.0)), ((0.0, 1.0), (4.0, 0.5), (11.0, 0.0)))
    rough: tuple[Curve, ...] = (((80.0, 0.0), (95.0, 1.0)), ((-150.0, 0.0), (-20.0, 1.0), (110.0, 0.0)), ((0.0, 0.0), (5.0, 1.0), (30.0, 0.0)), ((0.0, 0.0), (10.0, 1.0), (11.0, 0.0)))
    smooth_weights: tuple[float, ...] = (2.0, 2.0, 1.0, 0.0)
    rough_weights: tuple[float, ...] = (1.0, 2.0, 1.0, 1.0)


def _placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that have the keys. Asked by plain conditions, which a join by the keys adds
    too: so frames made of the same gates keep the same plan, and Spark deals them once."""
    return rows.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def beside(gates: DataFrame, sweep: list[str], rays: int) -> DataFrame:
    """Adds ``baseline``: the mean of the two rays beside at the same gate, around the
    circle, or the one that has a value. Rows without a sweep key, ray or gate are left
    out; a gate has one row."""
    ray = F.col("ray")
    o = Window.partitionBy(*sweep, "gate").orderBy("ray")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda k: F.max(F.when(ray == k, F.col("dbzh"))).over(whole)
    low = F.when(ray == 0, at(rays - 1)).when(F.lag("ray").over(o) == ray - 1, F.lag("dbzh").over(o))
    high = F.when(ray == rays - 1, at(0)).when(F.lead("ray").over(o) == ray + 1, F.lead("dbzh").over(o))
    g = _placed(gates, *sweep, "ray", "gate").withColumns({"_l": low, "_h": high})
    return g.withColumn("baseline", F.coalesce((F.col("_l") + F.col("_h")) / 2, "_l", "_h")).drop("_l", "_h")


def runs(gates: DataFrame, ray: list[str], where: Column) -> DataFrame:
    """Of the gates where the condition holds: ``_run``, the same for gates of a
    ray that follow each other."""
    w = Window.partitionBy(*ray).orderBy("gate")
    return gates.filter(where).withColumn("_run", F.col("gate") - F.row_number().over(w))


def with_rays(rows: DataFrame, rays: DataFrame, sweep: list[str], *columns: str) -> DataFrame:
    """Adds columns of their ray to rows with sweep keys and ``ray``; null where the ray
    has no row. The rays of a sweep, one row each, come as one map, so rows that are
    dealt by sweep stay where they are."""
    known = _placed(rays, *sweep, "ray").groupBy(*sweep).agg(F.map_from_entries(F.collect_list(F.struct("ray", F.struct(*columns)))).alias("_rays"))
    return rows.join(known, sweep, "left").withColumn("_own", F.col("_rays")[F.col("ray")]).withColumns({c: F.col("_own")[c] for c in columns}).drop("_rays", "_own")


def by_ray(gates: DataFrame, sweep: list[str]) -> DataFrame:
    """A row for each ray: ``own``, its valid gates outwards. The instrument bounds a
    ray, and all that is asked of one is then asked of its array."""
    own = F.struct(F.col("gate").cast("long").alias("gate"), *[c for c in ("range_m", "dbzh", "baseline") if c in gates.columns])
    return _placed(gates, *sweep, "ray", "gate").groupBy(*sweep, "ray").agg(F.sort_array(F.collect_list(F.when(F.col("dbzh").isNotNull(), own))).alias("own"))


def _sorted(own: Column, value, where=None) -> Column:
    return F.sort_array(F.transform(own if where is None else F.filter(own, where), value))


def _quantile(values: str, q: float = 0.5) -> Column:
    """Of a sorted array, weighed between two values as ``percentile`` weighs them."""
    place = F.lit(q) * (F.size(values) - 1)
    a, b = F.floor(place), F.ceil(place)
    low, high = F.get(values, a.cast("int")), F.get(values, b.cast("int"))
    return F.when(F.size(values) > 0, F.when(low == high, low).otherwise((b - place) * low + (place - a) * high))


def _longest(own: Column) -> Column:
    """The most gates of an array that follow each other."""
    n = lambda s, x: F.when(x["gate"] == s["at"] + 1, s["n"] + 1).otherwise(1)
    step = lambda s, x: F.struct(x["gate"].alias("at"), n(s, x).alias("n"), F.greatest(s["most"], n(s, x)).alias("most"))
    long = lambda v, name: F.lit(v).cast("long").alias(name)
    return F.aggregate(own, F.struct(long(-2, "at"), long(0, "n"), long(0, "most")), step, lambda s: s["most"])


def _segments(own: Column, least: int) -> Column:
    """Of the runs of at least so many gates that follow each other: how many, the
    number of their gates and their farthest range."""

    def step(s: Column, x: Column) -> Column:
        on = x["gate"] == s["at"] + 1
        n = F.when(on, s["n"] + 1).otherwise(1)
        reach = F.when(on, F.greatest(s["reach"], x["range_m"])).otherwise(x["range_m"])
        more = F.when(n == least, least).when(n > least, 1).otherwise(0)
        far = F.when(n >= least, F.greatest(s["far_m"], reach)).otherwise(s["far_m"])
        return F.struct(x["gate"].alias("at"), n.alias("n"), reach.alias("reach"), (s["segments"] + F.when(n == least, 1).otherwise(0)).alias("segments"), (s["gates"] + more).alias("gates"), far.alias("far_m"))

    long, none = (lambda v, name: F.lit(v).cast("long").alias(name)), (lambda name: F.lit(None).cast("double").alias(name))
    return F.aggregate(own, F.struct(long(-2, "at"), long(0, "n"), none("reach"), long(0, "segments"), long(0, "gates"), none("far_m")), step)


def radial_evidence(gates: DataFrame, sweep: list[str], p: Radial = Radial(), context: DataFrame | None = None) -> DataFrame:
    """A row for each ray with valid gates: valid_gates, longest_run, difference
    (median distance from the rays beside), segments, evidence_gates, drop, type (broad,
    reverse, intermittent, short_range, narrow, none), probability, dense, promoted and
    vetoed.

    A ray that is nearly full of strong values, grows outwards and follows a source's
    power with the number of the gate is broad. A segment is a run of at least
    ``p.segment`` gates that stand over the rays beside by ``p.candidate_db``. A ray
    that also fills enough gates, in a long run, apart from its neighbours, is dense
    and flagged; else its type is a candidate of the diagnostic probability. With
    ``context`` (sweep, ray, persistence in time, consistency with other radars, median
    vertical support of its evidence; null: unknown) a candidate is promoted to a flag
    by enough independent evidence, and a consistent one is vetoed."""
    r = _evidence(by_ray(beside(gates, sweep, p.rays), sweep).filter(F.size("own") > 0), sweep, p, context)
    return r.select(*sweep, "ray", *EVIDENCE)


EVIDENCE = ("valid_gates", "longest_run", "difference", "segments", "evidence_gates", "drop", "type", "probability", "dense", "promoted", "vetoed")


def _evidence(rays: DataFrame, sweep: list[str], p: Radial, context: DataFrame | None) -> DataFrame:
    """Adds ``EVIDENCE`` to rays with ``own``."""
    quarter = max(p.gates // 4, 1)
    own, value = F.col("own"), (lambda x: x["dbzh"])
    power = lambda x: x["dbzh"] - F.lit(20.0) * F.log10((x["gate"] + 1) / 1000.0)  # noqa: E731  by the gate's number, as the signature has it
    r = rays.withColumns({
        "_d": _sorted(own, lambda x: F.abs(x["dbzh"] - x["baseline"]), lambda x: x["baseline"].isNotNull()),
        "_near": _sorted(own, value, lambda x: x["gate"] < quarter), "_far": _sorted(own, value, lambda x: x["gate"] >= p.gates - quarter), "_power": _sorted(own, power),
        "_high": F.filter(own, lambda x: x["dbzh"] >= p.broad_dbz), "_seg": _segments(F.filter(own, lambda x: x["dbzh"] - x["baseline"] >= p.candidate_db), p.segment), "longest_run": _longest(own),
    })
    r = r.withColumns({
        "valid_gates": F.size("own").cast("long"), "difference": _quantile("_d"), "drop": _quantile("_near") - _quantile("_far"), "_iqr": _quantile("_power", 0.75) - _quantile("_power", 0.25),
        "_high_run": _longest(F.col("_high")), "_high": F.size("_high"), "segments": F.col("_seg.segments"), "evidence_gates": F.col("_seg.gates"), "far_m": F.col("_seg.far_m"),
    }).drop("_d", "_near", "_far", "_power", "_seg")
    filled = F.col("valid_gates") / F.lit(p.gates)
    broad = (filled >= p.broad_valid) & (F.try_divide("_high", F.col("valid_gates")) >= p.broad_fraction) & (F.col("_high_run") >= p.broad_run) & F.coalesce(F.col("drop") <= -p.broad_growth_db, F.lit(False)) & (F.col("valid_gates") > 1) & (F.col("_iqr") <= p.broad_iqr_db)
    dense = (filled >= p.valid_fraction) & (F.col("longest_run") >= p.run) & F.coalesce(F.col("difference") >= p.difference_db, F.lit(False))
    kind = (
        F.when(broad, "broad").when((F.col("segments") == 1) & (F.col("evidence_gates") >= 0.5 * F.col("valid_gates")) & F.coalesce(F.col("drop") >= p.drop_db, F.lit(False)), "reverse")
        .when(F.col("segments") >= p.intermittent, "intermittent").when((F.col("segments") > 0) & (F.col("far_m") <= p.short_range_m), "short_range")
        .when((F.col("segments") > 0) | dense, "narrow").otherwise("none")
    )
    r = r.withColumns({"type": kind, "dense": dense | broad, "weak": ~dense & ~broad & (F.col("segments") > 0)})
    if context is None:
        r = r.withColumns({"promoted": F.lit(False), "vetoed": F.lit(False)})
    else:
        known = lambda c: F.coalesce(c, F.lit(False))
        r = with_rays(r, context, sweep, "persistence", "consistency", "vertical")
        veto = known(F.col("consistency") >= p.veto_consistency)
        votes = F.lit(1) + known(F.col("vertical") <= p.vertical_support).cast("int") + known(F.col("persistence") >= p.persistence).cast("int") + known(F.col("consistency") <= p.promotion_consistency).cast("int")
        r = r.withColumns({"vetoed": F.col("weak") & veto, "promoted": F.col("weak") & ~veto & (votes >= p.context_evidence)})
    level = F.when(F.col("dense") | F.col("promoted"), p.flagged).when(F.col("weak"), p.diagnostic).otherwise(0.0)
    return r.withColumns({"drop": F.coalesce("drop", F.lit(0.0)), "probability": level})


def marked(gates: DataFrame, rays: DataFrame, sweep: list[str], p: Radial = Radial(), *more: str) -> DataFrame:
    """Adds to valid gates type and probability of the rays' evidence that marks them,
    null where none does: it marks all valid gates of a dense ray, of others those of
    their segments only. ``more`` are columns of the rays that the gates get besides."""
    ray = [*sweep, "ray"]
    over = F.coalesce(F.col("dbzh") - F.col("baseline") >= p.candidate_db, F.lit(False))
    so_far = Window.partitionBy(*ray).orderBy("gate").rowsBetween(Window.unboundedPreceding, 0)
    b = beside(gates, sweep, p.rays).filter("dbzh IS NOT NULL").withColumn("_run", F.when(over, F.col("gate") - F.count_if(over).over(so_far)))
    b = b.withColumn("_in", F.col("_run").isNotNull() & (F.count("*").over(Window.partitionBy(*ray, "_run")) >= p.segment)).drop("_run", "baseline")
    marks = (F.col("probability") > 0) & (F.col("dense") | F.col("_in"))
    x = with_rays(b, rays, sweep, "type", "probability", "dense", *more)
    return x.withColumns({c: F.when(marks, F.col(c)) for c in ("type", "probability")}).drop("dense", "_in")


def evidence_gates(gates: DataFrame, rays: DataFrame, sweep: list[str], p: Radial = Radial()) -> DataFrame:
    """The gates that rays' evidence marks, with type and probability: all valid ones
    of a dense ray, of others those of their segments only."""
    return marked(gates, rays, sweep, p).filter("probability IS NOT NULL").select(*sweep, "ray", "gate", "type", "probability")


def boundary(gates: DataFrame, sweep: list[str], gates_in_ray: int, reach_m: float, p: Fans = Fans()) -> DataFrame:
    """A row for each ray with valid gates: extent (how far it reaches, as a share of
    ``reach_m``), like_fan (full, strong, in a long strong run, growing outwards),
    fills (measured enough, in a long run, and growing) and edge_like (that, strong and
    of a source's power with range, but for its extent)."""
    r = _bounds(by_ray(gates, sweep).filter(F.size("own") > 0), gates_in_ray, reach_m, p)
    return r.select(*sweep, "ray", "extent", "like_fan", "fills", "edge_like")


def _bounds(rays: DataFrame, gates_in_ray: int, reach_m: float, p: Fans) -> DataFrame:
    """Adds what ``boundary`` has to rays with ``own``."""
    quarter = max(gates_in_ray // 4, 1)
    own, value = F.col("own"), (lambda x: x["dbzh"])
    fourth = F.greatest(F.lit(1), F.floor(F.size("own") / 4).cast("int"))
    power = lambda x: x["dbzh"] - F.lit(20.0) * F.log10(F.greatest(x["range_m"], F.lit(1.0)) / 1000.0)
    r = rays.withColumns({
        "_b_high": F.filter(own, lambda x: x["dbzh"] >= p.high_dbz), "_b_run": _longest(own), "_b_far": F.array_max(F.transform(own, lambda x: x["range_m"])),
        "_b_near": _sorted(own, value, lambda x: x["gate"] < quarter), "_b_outer": _sorted(own, value, lambda x: x["gate"] >= gates_in_ray - quarter),
        "_b_first": _sorted(F.slice(own, F.lit(1), fourth), value), "_b_last": _sorted(F.slice(own, -fourth, fourth), value), "_b_power": _sorted(own, power, lambda x: x["range_m"] >= p.edge_range_m),
    })
    r = r.withColumns({
        "_b_n": F.size("own"), "_b_strong": F.size("_b_high"), "_b_high_run": _longest(F.col("_b_high")), "_b_growth": _quantile("_b_outer") - _quantile("_b_near"),
        "_b_own": _quantile("_b_last") - _quantile("_b_first"), "_b_iqr": F.when(F.size("_b_power") > 1, _quantile("_b_power", 0.75) - _quantile("_b_power", 0.25)),
    })
    n = F.col("_b_n")
    share, strong = n / F.lit(gates_in_ray), F.try_divide("_b_strong", n)
    looks = (share >= p.valid_fraction) & (strong >= p.high_fraction) & (F.col("_b_high_run") >= p.high_run) & (F.col("_b_growth") >= p.growth_db)
    grows = (n > 1) & (F.col("_b_own") >= p.growth_db)
    fills = (share >= p.extent_valid_fraction) & (F.col("_b_run") >= p.extent_run) & grows
    edge = (share >= p.edge_valid_fraction) & (F.col("_b_run") >= p.extent_run) & (strong >= p.edge_high_fraction) & (F.col("_b_high_run") >= p.high_run) & grows & (F.col("_b_iqr") <= p.edge_iqr_db)
    yes = lambda c: F.coalesce(c, F.lit(False))
    r = r.withColumns({"extent": F.col("_b_far") / reach_m, "like_fan": yes(looks), "fills": yes(fills), "edge_like": yes(edge)})
    return r.drop(*[c for c in r.columns if c.startswith("_b_")])


def described(gates: DataFrame, sweep: list[str], reach_m: float, p: Radial = Radial(), fans: Fans = Fans(), context: DataFrame | None = None) -> DataFrame:
    """A row for every ray (0 to ``p.rays`` - 1) of a sweep that has gates, valid or
    not: type, probability and dense of ``radial_evidence`` (null without valid gates),
    hard (it is flagged) and what ``boundary`` has, in one pass over the gates."""
    columns = ("type", "probability", "dense", "hard", "extent", "like_fan", "fills", "edge_like")
    own = by_ray(beside(gates, sweep, p.rays), sweep)
    r = _evidence(_bounds(own, p.gates, reach_m, fans), sweep, p, context).withColumn("hard", F.col("probability") >= p.flagged)
    some = F.col("valid_gates") > 0
    known = r.groupBy(*sweep).agg(F.map_from_entries(F.collect_list(F.struct("ray", F.struct(*[F.when(some, F.col(c)).alias(c) for c in columns])))).alias("_rays"))
    every = F.explode(F.sequence(F.lit(0), F.lit(p.rays - 1)).cast(f"array<{dict(gates.dtypes)['ray']}>"))
    r = known.select(*sweep, every.alias("ray"), "_rays").withColumn("_own", F.col("_rays")[F.col("ray")])
    return r.select(*sweep, "ray", *[F.col("_own")[c].alias(c) for c in columns]).na.fill(False, ["hard", "like_fan", "fills", "edge_like"])


def closed_fans(rays: DataFrame, sweep: list[str], n_rays: int, p: Fans = Fans()) -> DataFrame:
    """Adds ``closed`` to rays (``hard``, ``extent`` and what ``boundary`` has; a row for
    every ray of a sweep): rays in a short gap between two hard ones around the circle
    that look like their fan, or fill as much of the range as these do."""
    w = Window.partitionBy(*sweep)
    o = w.orderBy("ray")
    at = F.when(F.col("hard"), F.struct("ray", "extent"))
    before = F.last(at, ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(at, ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing))
    hard_low, hard_high = F.min(F.when(F.col("hard"), F.struct("ray", "extent"))).over(w), F.max(F.when(F.col("hard"), F.struct("ray", "extent"))).over(w)
    turned = lambda x, by: F.struct((x["ray"] + by).alias("ray"), x["extent"].alias("extent"))
    r = rays.withColumns({"_l": F.coalesce(before, turned(hard_high, -n_rays)), "_r": F.coalesce(after, turned(hard_low, n_rays)), "_k": F.count(at).over(w)})
    gap = F.col("_r.ray") - F.col("_l.ray") - 1
    bounded = ~F.col("hard") & (F.col("_k") >= 2) & (gap <= p.gap_rays) & (F.lit(2.0) / (gap + 2.0) >= p.seed_fraction)
    reaches = F.col("extent") >= F.least(F.lit(p.extent_fraction), F.least("_l.extent", "_r.extent") * p.extent_ratio)
    return r.withColumn("closed", F.coalesce(bounded & (F.col("like_fan") | (F.col("fills") & reaches)), F.lit(False))).drop("_l", "_r", "_k")


def extended_fans(rays: DataFrame, sweep: list[str], n_rays: int, p: Fans = Fans()) -> DataFrame:
    """Adds ``extended``: the rays that a fan (``hard`` ones side by side) takes in
    beyond its ends, one after another while they are like its edge and reach nearly as
    far as the ray at its end, ``p.edge_rays`` at most. The circle is laid out twice, so
    a fan goes over its seam; one pass of windows, without a step for each ray."""
    r = rays.withColumn("_at", F.explode(F.array(F.col("ray"), F.col("ray") + n_rays)))
    taken = F.lit(False)
    for name, order in (("_f", F.asc("_at")), ("_b", F.desc("_at"))):
        end = F.last(F.when(F.col("hard"), F.struct("_at", "extent")), ignorenulls=True).over(Window.partitionBy(*sweep).orderBy(order))
        r = r.withColumn(name, end)
        at, extent = F.col(name)["_at"], F.col(name)["extent"]
        reaches = F.col("extent") >= F.greatest(F.lit(p.edge_extent_fraction), extent * p.edge_extent_ratio)
        unlike = ~F.col("hard") & ~F.coalesce(F.col("edge_like") & reaches, F.lit(False))
        r = r.withColumns({f"{name}_at": at, f"{name}_no": unlike})
        broken = F.max(f"{name}_no").over(Window.partitionBy(*sweep, f"{name}_at").orderBy(order))
        r = r.withColumn(f"{name}_ok", at.isNotNull() & ~broken & (F.abs(F.col("_at") - at) <= p.edge_rays))
        taken = taken | F.col(f"{name}_ok")
    either = F.max(~F.col("hard") & F.coalesce(taken, F.lit(False))).over(Window.partitionBy(*sweep, "ray"))
    return r.withColumn("extended", either).filter(F.col("_at") == F.col("ray")).select(*rays.columns, "extended")


def range_signatures(gates: DataFrame, sweep: list[str], p: Signature = Signature()) -> DataFrame:
    """A row for each run of echo along a ray that is long enough, with how well
    it fits the growth of a source's power with range: intercept (the median of
    value less 20 log10 of kilometres), residual_p90, growth (median of the last
    fifth less that of the first) and ``matches``."""
    ray = [*sweep, "ray"]
    x = F.lit(20.0) * F.log10(F.col("range_m") / 1000.0)
    g = runs(gates, ray, F.col("dbzh") >= p.echo_dbz).withColumn("x", x)
    part = Window.partitionBy(*ray, "_run")
    g = g.withColumns({"n": F.count("*").over(part), "i": F.row_number().over(part.orderBy("gate"))}).filter(F.col("n") >= p.samples)
    fifth = F.greatest(F.lit(3), F.floor(F.col("n") / 5))
    half = lambda c: F.percentile(c, F.lit(0.5))
    fit = g.groupBy(*ray, "_run").agg(
        F.min("gate").alias("first_gate"), F.count("*").alias("n"), half(F.col("dbzh") - F.col("x")).alias("intercept"),
        (half(F.when(F.col("i") > F.col("n") - fifth, F.col("dbzh"))) - half(F.when(F.col("i") <= fifth, F.col("dbzh")))).alias("growth"),
        F.avg((F.col("dbzh") >= p.high_dbz).cast("double")).alias("high"), (F.max("range_m") - F.min("range_m")).alias("span_m"), (F.max("x") - F.min("x")).alias("log_span"),
        F.collect_list(F.struct("x", "dbzh")).alias("own"),
    )
    # A run is at most a ray long: its residuals are an array.
    residuals = F.array_sort(F.transform("own", lambda v: F.abs(v["dbzh"] - F.col("intercept") - v["x"])))
    place = F.lit(0.9) * (F.col("n") - 1)
    low = F.floor(place).cast("int")
    fit = fit.withColumn("_r", residuals).withColumn("residual_p90", F.get("_r", low) + (place - low) * (F.coalesce(F.get("_r", low + 1), F.get("_r", low)) - F.get("_r", low)))
    good = (F.col("span_m") >= p.span_m) & (F.col("log_span") >= p.log_span_db) & (F.col("residual_p90") <= p.residual_p90_db) & (F.col("growth") >= p.growth_db) & (F.col("high") >= p.high_fraction)
    return fit.select(*ray, "first_gate", "n", "intercept", "growth", "residual_p90", "span_m", good.alias("matches"))


def echo_formula(gates: DataFrame, sweep: list[str], gates_in_ray: int, p: Echo = Echo()) -> DataFrame:
    """Adds to valid gates: coverage (per cent of the ray), texture (mean squared
    step over 11 pairs), spin (of 11 gates, how many turn by over the jump), delta
    (range-corrected value less the mean of the ray's last tenth) and ``score``
    between 0 and 1, by the smooth or the rough curves. What a stencil or the tail
    has not enough gates for is null."""
    o = Window.partitionBy(*sweep, "ray").orderBy("gate")
    near = o.rangeBetween(-5, 5)
    g = gates.filter((F.col("range_m") > 0) & F.col("dbzh").isNotNull())
    nxt, prv = (F.when(F.abs(f("gate").over(o) - F.col("gate")) == 1, f("dbzh").over(o)) for f in (F.lead, F.lag))
    g = g.withColumns({"_n": nxt, "_p": prv, "corrected": F.col("dbzh") - F.lit(20.0) * F.log10(F.col("range_m") / 1000.0)})
    turn = (F.abs(F.col("dbzh") - F.col("_p")) + F.abs(F.col("_n") - F.col("dbzh"))) / 2 > p.spin_jump_db
    tail = max(1, -(-int(round(gates_in_ray * p.tail_fraction * 1e9)) // 10**9))
    whole = Window.partitionBy(*sweep, "ray")
    last = F.when(F.col("gate") >= gates_in_ray - tail, F.col("corrected"))
    g = g.withColumns({
        "texture": F.when(F.count("_n").over(near) == 11, F.sum((F.col("dbzh") - F.col("_n")) * (F.col("dbzh") - F.col("_n"))).over(near) / 11),
        "spin": F.when(F.count(turn).over(near) == 11, F.count_if(turn).over(near).cast("double")),
        "coverage": F.count("*").over(whole) / F.lit(gates_in_ray) * 100,
        "delta": F.when(F.count(last).over(whole) >= F.ceil(F.lit(tail * p.tail_support)), F.col("corrected") - F.avg(last).over(whole)),
    })
    parts = [F.col(c) for c in ("coverage", "delta", "texture", "spin")]

    def score(curves: tuple[Curve, ...], weights: tuple[float, ...]) -> Column:
        knots = [F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in c]) for c in curves]
        return sum((F.lit(w) * interpolate(c, k) for c, k, w in zip(parts, knots, weights, strict=True) if w), F.lit(0.0)) / F.lit(sum(weights))

    rough = F.col("texture") > p.rough_db2
    return g.withColumn("score", F.when(rough, score(p.rough, p.rough_weights)).otherwise(score(p.smooth, p.smooth_weights))).drop("_n", "_p")
