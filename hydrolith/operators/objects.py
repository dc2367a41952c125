"""Radial objects: intervals along rays, linked across rays and told by measurements.

Tables of gates have sweep keys, ``ray`` (0 to rays - 1, even around the circle),
``gate`` (0 outwards), ``range_m``, ``dbzh`` and columns of other moments; a gate
without a value, or without a row, is not observed. An interval is a row: ``first``,
``last`` and ``n``, the gates between them that count. Gates become intervals by
windows along a ray, intervals are bridged by a fold over the few of one ray, and
linked across rays by array steps over the intervals of one sweep, so no step goes
gate by gate. Links say what belongs together; they never make a measurement. Rows
without a sweep key, ray or gate are left out; a gate has one row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.operators.kernels import run_labels
from hydrolith.sources.shared import stored


# The detectors' default parameters.
@dataclass(frozen=True)
class Objects:
    rays: int = 360
    gates: int = 1000
    spacing_m: float = 250.0
    minimum_range_m: float = 15_000.0
    segment_m: float = 12_000.0
    gap_m: float = 1000.0
    gap_fraction: float = 0.15
    window_m: float = 8000.0
    support: float = 0.8
    echo_dbz: float = 5.0
    contrast_db: float = 10.0
    contrast_fraction: float = 0.5
    own_low_rho: float = 0.8
    offsets_deg: tuple[float, ...] = (2.0, 5.0, 12.0, 25.0, 45.0, 60.0)
    smooth_db: float = 4.0
    rough: bool = False
    rough_db: float = 10.0
    rough_fraction: float = 0.55
    high_rho: bool = False
    high_rho_span_m: float = 35_000.0
    high_rho_fraction: float = 0.25
    own_span_m: float = 25_000.0
    own_growth_db: float = 3.0
    own_std_db: float = 6.0
    width_deg: float = 65.0
    aspect: float = 2.0
    overlap_m: float = 1000.0
    suspect_rhohv: float = 0.9
    protected_rhohv: float = 0.95
    edge_m: float = 4000.0
    edge_db: float = 4.0
    review: bool = False
    review_m: float = 2500.0
    review_deg: float = 2.0


@dataclass(frozen=True)
class Graph:
    rays: int = 360
    gates: int = 1000
    spacing_m: float = 250.0
    minimum_range_m: float = 10_000.0
    echo_dbz: float = -5.0
    offsets_deg: tuple[float, ...] = (1.0, 2.0, 4.0, 8.0, 12.0, 18.0)
    contrast_db: float = 8.0
    atom_m: float = 2000.0
    gap_m: float = 1000.0
    gap_fraction: float = 0.15
    bundle_deg: float = 12.0
    narrow_deg: float = 5.0
    span_m: float = 12_000.0
    measured_m: float = 8000.0
    aspect: float = 4.0
    model_m: float = 60_000.0
    model_deg: float = 2.5
    model_p90_db: float = 5.0
    shoulder_fraction: float = 0.8
    far_m: float = 200_000.0


@dataclass(frozen=True)
class Fragments:
    spacing_m: float = 250.0
    minimum_range_m: float = 10_000.0
    echo_dbz: float = -5.0
    anchor_m: float = 2000.0
    distance_m: float = 5000.0
    difference_db: float = 8.0


#: Bits of a gate's reason in the graph of hypotheses.
REASONS = dict(
    protected=1, no_evidence=2, short_atom=4, wide=8, short_group=16, review=64, model=128, unavailable=256, confirmed=512, quarantined=1024, unresolved=2048, one_shoulder=4096
)

def placed(gates: DataFrame, sweep: list[str]) -> DataFrame:
    return gates.dropna(subset=[*sweep, "ray", "gate"])


half = lambda c: F.percentile(c, F.lit(0.5))


def corrected(p: Objects | Graph | Fragments) -> Column:
    """The value less the growth of a source's power with range."""
    return F.col("dbzh") - F.lit(20.0) * F.log10(F.greatest(F.col("range_m"), F.lit(p.spacing_m / 2)) / 1000.0)


def shoulders(gates: DataFrame, sweep: list[str], rays: int, offsets_deg: tuple[float, ...], donor: str | None = None) -> DataFrame:
    """Adds ``contrast``: the most, over the offsets, by which a gate exceeds both
    gates as many degrees beside it; null where no offset has both. ``one_sided``:
    some offset has one of them. With ``donor``, gates where it does not hold are no
    shoulders. Offsets that fall between rays are left out; those beyond half a
    circle, or 0, have none. Each gate goes to those it stands beside, in one
    aggregate."""
    steps = [(k, n) for k, d in enumerate(offsets_deg) if abs(d * rays / 360 - (n := round(d * rays / 360))) <= 0.55 and 0 < n < rays and 2 * n != rays]
    to = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in [(-1, 0), *[(k, s * n) for k, n in steps for s in (1, -1)]]])).alias("x")
    own = F.col("x.k") == -1
    g = placed(gates, sweep).filter("dbzh IS NOT NULL").withColumn("_row", F.struct(*[F.col(c) for c in gates.columns]))
    usable = F.col("dbzh") if donor is None else F.when(F.col(donor), F.col("dbzh"))
    sent = g.select(*sweep, "ray", "gate", usable.alias("_z"), "_row", to).filter(own | F.col("_z").isNotNull())
    sent = sent.withColumns({"ray": F.pmod(F.col("ray") + F.col("x.d"), F.lit(rays)), "_row": F.when(own, F.col("_row"))})
    side = lambda k, s: F.max(F.when((F.col("x.k") == k) & (F.signum(F.col("x.d")) == s), F.col("_z")))
    met = sent.groupBy(*sweep, "ray", "gate").agg(F.first("_row", ignorenulls=True).alias("_row"), *[side(k, s).alias(f"_{k}{'l' if s > 0 else 'r'}") for k, _ in steps for s in (1, -1)]).filter("_row IS NOT NULL")
    pairs = [(F.col(f"_{k}l"), F.col(f"_{k}r")) for k, _ in steps]
    both = [F.when(a.isNotNull() & b.isNotNull(), F.col("_row.dbzh") - F.greatest(a, b)) for a, b in pairs]
    contrast = F.greatest(*both) if len(both) > 1 else both[0] if both else F.lit(None).cast("double")
    one = reduce(lambda x, y: x | y, [a.isNull() != b.isNull() for a, b in pairs], F.lit(False))
    return met.select("_row.*", contrast.alias("contrast"), one.alias("one_sided"))


def axial(gates: DataFrame, sweep: list[str], p: Objects) -> DataFrame:
    """Adds to observed gates ``support`` (the share of a window along the ray, as far
    as the ray reaches, that is observed) and ``axial_std`` of corrected values there.

    The deviation is the root of a covariance with itself, whose running sum takes the
    distances to the means before and after a value, as the SQL's does: values on a
    limit fall on the same side."""
    h = max(3, round(p.window_m / p.spacing_m) | 1) // 2
    near = Window.partitionBy(*sweep, "ray").orderBy("gate").rangeBetween(-h, h)
    domain = F.least(F.col("gate") + h, F.lit(p.gates - 1)) - F.greatest(F.col("gate") - h, F.lit(0)) + 1
    g = gates.filter("dbzh IS NOT NULL").withColumn("corrected", corrected(p))
    return g.withColumns({"support": F.count("*").over(near) / domain, "axial_std": F.sqrt(F.covar_pop("corrected", "corrected").over(near))})


def intervals(gates: DataFrame, ray: list[str], seed: Column, blocked: Column, gap: int, fraction: float, least_run: int = 1) -> DataFrame:
    """Intervals (first, last, n) of the gates where ``seed`` holds, each with ``part``,
    its number along the ray. Neighbouring runs of at least ``least_run`` gates are
    bridged, from the first on, if at most ``gap`` gates lie between them, none of
    these is ``blocked``, and the share of gates of the whole that do not count stays
    within ``fraction``. Nulls of either condition are false."""
    o = Window.partitionBy(*ray).orderBy("gate")
    s, b = F.coalesce(seed, F.lit(False)), F.coalesce(blocked, F.lit(False))
    g = placed(gates, ray).withColumns({"_s": s, "_blocks": F.sum((b & ~s).cast("int")).over(o)}).filter("_s")
    runs = g.withColumn("_run", F.col("gate") - F.row_number().over(o)).groupBy(*ray, "_run").agg(F.min("gate").alias("first"), F.max("gate").alias("last"), F.count("*").alias("n"), F.max("_blocks").alias("b")).filter(F.col("n") >= least_run)
    rows = runs.groupBy(*ray).agg(F.array_sort(F.collect_list(F.struct("first", "last", "n", "b"))).alias("r"))

    def step(acc: Column, x: Column) -> Column:
        end = F.element_at(acc, -1)
        n = end["n"] + x["n"]
        joins = (F.size(acc) > 0) & (x["first"] - end["last"] - 1 <= gap) & (x["b"] == end["b"]) & (F.lit(1.0) - n / (x["last"] - end["first"] + 1) <= fraction + 1e-12)
        whole = F.struct(end["first"].alias("first"), x["last"].alias("last"), n.alias("n"), x["b"].alias("b"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(whole))).otherwise(F.concat(acc, F.array(x)))

    kind = dict(runs.dtypes)
    none = F.array().cast(f"array<struct<first:{kind['first']},last:{kind['last']},n:bigint,b:bigint>>")
    joined = F.aggregate(F.slice("r", 2, F.size("r")), F.concat(none, F.slice("r", 1, 1)), step)
    return rows.select(*ray, F.posexplode(joined).alias("part", "x")).select(*ray, "part", "x.first", "x.last", "x.n")


def members(gates: DataFrame, parts: DataFrame, ray: list[str]) -> DataFrame:
    """The observed gates of intervals (with first and last), with the interval's
    columns: one row for each gate and interval that holds it."""
    inside = parts.withColumn("gate", F.explode(F.sequence("first", "last")))
    return gates.join(inside, [*ray, "gate"])


def linked(parts: DataFrame, sweep: list[str], rays: int, overlap: int) -> DataFrame:
    """Adds ``object`` to intervals (ray, first, last): the same, from 1 on by the
    least (ray, first), for those that are linked over neighbouring rays by ``overlap``
    common gates or more, ray 0 beside the last."""
    kinds = dict(parts.dtypes)
    of_keys = "".join(f"`{k}` {kinds[k]}, " for k in sweep)

    def label(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["ray", "first"])
        root = run_labels(d["ray"].to_numpy(), d["first"].to_numpy(), d["last"].to_numpy(), rays, overlap)
        return d.assign(object=pd.factorize(root)[0] + 1)

    own = parts.select(*sweep, "ray", "first", "last")
    found = own.groupBy(*sweep).applyInPandas(label, f"{of_keys}ray {kinds['ray']}, first {kinds['first']}, last {kinds['last']}, object long")
    return parts.join(found, [*sweep, "ray", "first", "last"])


def angular_width(rays: Column, n: int) -> Column:
    """Degrees that the rays of a sorted array cover, by the widest gap between them."""
    after = F.transform(rays, lambda r, i: F.coalesce(F.get(rays, i + 1), F.get(rays, 0) + n) - r)
    return (F.lit(n) - F.array_max(after) + 1) * F.lit(360.0 / n)


def object_seeds(gates: DataFrame, sweep: list[str], p: Objects = Objects()) -> DataFrame:
    """Gates with what makes a seed of an object: ``echo``, ``low`` and ``protected``
    by ``rhohv``, ``stands`` (out of its shoulders), ``smooth`` and ``rough`` along the
    ray, and ``seed``. A gate without rhohv is neither low nor protected."""
    g = axial(shoulders(gates, sweep, p.rays, p.offsets_deg), sweep, p)
    yes = lambda c: F.coalesce(c, F.lit(False))
    there = F.col("support") >= p.support
    g = g.withColumns({
        "echo": (F.col("dbzh") >= p.echo_dbz) & (F.col("range_m") >= p.minimum_range_m), "low": yes(F.col("rhohv") < p.suspect_rhohv), "protected": yes(F.col("rhohv") >= p.protected_rhohv),
        "stands": yes(F.col("contrast") >= p.contrast_db), "smooth": there & (F.col("axial_std") <= p.smooth_db), "rough": there & (F.col("axial_std") <= p.rough_db) & F.lit(p.rough),
    })
    own = F.col("echo") & there & (F.col("axial_std") <= p.own_std_db) & F.lit(p.high_rho)
    evidence = F.col("stands") | F.col("low")
    return g.withColumn("seed", F.col("echo") & ~F.col("protected") & ((F.col("smooth") & (evidence | own)) | (F.col("rough") & evidence)))


def radial_objects(seeds: DataFrame, sweep: list[str], p: Objects = Objects()) -> tuple[DataFrame, DataFrame]:
    """Objects and their gates, from ``object_seeds``.

    Objects: object, rays, width_deg, first and last gate, span_m (of the longest
    interval), aspect, seeds, linked (observed members that are no seeds),
    longest_hole_m, and whether an interval has its own signature, contrast, rough
    structure, or a signature with high correlation. Gates: ray, gate, object, linked,
    own (a seed of an interval with its own signature), rough and high_rho (of an
    interval with these); ``with_edges`` adds what lies beyond their ends.

    An interval counts if it is long enough and stands out of its shoulders, or grows
    with range as a source does, with low correlation, or is rough with low
    correlation. An object is narrow, and longer than wide. A missing or protected gate
    is no member. Equal objects are told apart by their least ray and gate; a sweep
    without intervals gives none."""
    ray = [*sweep, "ray"]
    dr = p.spacing_m
    parts = intervals(seeds, ray, F.col("seed"), F.col("protected"), int(p.gap_m // dr), p.gap_fraction).filter(F.col("n") * dr >= p.segment_m)
    m = members(seeds, parts, ray)
    own = m.filter("seed").withColumn("i", F.row_number().over(Window.partitionBy(*ray, "part").orderBy("gate")))
    fifth = F.greatest(F.lit(1), F.floor(F.col("n") / 5))
    share = lambda c: F.avg(F.col(c).cast("double"))
    s = own.groupBy(*ray, "part", "first", "last", "n").agg(
        share("stands").alias("c"), share("low").alias("low"), share("rough").alias("r"), F.min("range_m").alias("near_m"), F.max("range_m").alias("far_m"), F.stddev_pop("corrected").alias("std"),
        (half(F.when(F.col("i") > F.col("n") - fifth, F.col("dbzh"))) - half(F.when(F.col("i") <= fifth, F.col("dbzh")))).alias("growth"),
    )
    length = (F.col("last") - F.col("first") + 1) * dr
    base = (length >= p.own_span_m) & (F.col("std") <= p.own_std_db) & (F.col("growth") >= p.own_growth_db)
    s = s.withColumn("has_contrast", F.col("c") >= p.contrast_fraction)
    s = s.withColumns({
        "has_high_rho": F.lit(p.high_rho) & base & (length >= p.high_rho_span_m) & (F.col("has_contrast") | (F.lit(p.rough) & (F.col("r") >= p.high_rho_fraction))),
        "has_rough": F.lit(p.rough) & (F.col("r") >= p.rough_fraction) & (F.col("low") >= p.rough_fraction),
    })
    s = s.withColumn("has_own", (base & (F.col("low") >= p.own_low_rho)) | F.col("has_high_rho")).filter("has_contrast OR has_own OR has_rough")
    s = linked(s.select(*ray, "part", "first", "last", "n", "near_m", "far_m", "has_contrast", "has_own", "has_rough", "has_high_rho"), sweep, p.rays, max(1, -int(-p.overlap_m // dr)))

    of = [*sweep, "object"]
    o = s.groupBy(*of).agg(
        F.array_sort(F.collect_set("ray")).alias("_rays"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("near_m").alias("near_m"), F.max("far_m").alias("far_m"), (F.max(F.col("last") - F.col("first") + 1) * dr).alias("span_m"), F.sum("n").alias("seeds"),
        F.bool_or("has_own").alias("has_own"), F.bool_or("has_contrast").alias("has_contrast"), F.bool_or("has_rough").alias("has_rough"), F.bool_or("has_high_rho").alias("has_high_rho"),
    ).withColumn("width_deg", angular_width(F.col("_rays"), p.rays))
    across = F.greatest(F.lit(dr), (F.col("near_m") + F.col("far_m")) / 2 * F.radians("width_deg"))
    o = o.withColumn("aspect", F.col("span_m") / across).filter((F.col("width_deg") <= p.width_deg) & (F.col("aspect") >= p.aspect))

    kept = s.join(o.select(*of), of)
    m = members(seeds, kept.select(*ray, "object", "first", "last", "has_own", "has_rough", "has_high_rho"), ray).filter("seed OR (echo AND NOT protected)")
    inner = m.select(*ray, "gate", "object", "corrected", (~F.col("seed")).alias("linked"), (F.col("has_own") & F.col("seed")).alias("own"), F.col("has_rough").alias("rough"), F.col("has_high_rho").alias("high_rho"))
    gap = F.col("gate") - F.lag("gate").over(Window.partitionBy(*ray, "first").orderBy("gate")) - 1
    holes = members(seeds, kept.select(*ray, "object", "first", "last"), ray).filter("seed").withColumn("_h", gap).groupBy(*of).agg((F.max("_h") * dr).alias("longest_hole_m"))
    counts = inner.groupBy(*of).agg(F.count_if("linked").alias("linked"))
    objects = o.join(holes, of, "left").join(counts, of).select(*of, F.size("_rays").alias("rays"), "width_deg", "first", "last", "span_m", "aspect", "seeds", "linked", F.coalesce("longest_hole_m", F.lit(0.0)).alias("longest_hole_m"), "has_own", "has_contrast", "has_rough", "has_high_rho")
    return objects, inner


def with_edges(seeds: DataFrame, inner: DataFrame, sweep: list[str], p: Objects = Objects()) -> DataFrame:
    """The members of objects and, with ``edge``, the observed gates beyond their ends
    on a ray that go on as they do: echo of low correlation whose corrected value is
    near the median of the window at that end. It stops at the first other observed
    gate or member, after ``p.edge_m``, and where more gates are missing than a bridge
    may miss; of two objects that reach for one gate the lower one has it, and the
    other stops there."""
    ray = [*sweep, "ray"]
    dr, window = p.spacing_m, max(3, round(p.window_m / p.spacing_m) | 1)
    limit, gap = min(int(p.edge_m // dr), window // 2), int(p.gap_m // dr)
    o = Window.partitionBy(*ray, "object")
    ranked = inner.withColumns({"_i": F.row_number().over(o.orderBy("gate")), "_n": F.count("*").over(o)})
    ends = None
    for side in (-1, 1):
        near = F.col("_i") <= window if side < 0 else F.col("_i") > F.col("_n") - window
        e = ranked.groupBy(*ray, "object").agg((F.min("gate") if side < 0 else F.max("gate")).alias("_o"), half(F.when(near, F.col("corrected"))).alias("_m")).withColumn("_side", F.lit(side))
        ends = e if ends is None else ends.union(e)
    steps = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(limit)))).withColumn("gate", F.col("_o") + F.col("_side") * F.col("_k")) if limit else ends.withColumns({"_k": F.lit(1), "gate": F.lit(-1).cast("long")}).limit(0)
    seen = steps.filter((F.col("gate") >= 0) & (F.col("gate") < p.gates)).join(seeds.select(*ray, "gate", "dbzh", "echo", "low", F.col("corrected").alias("_c")), [*ray, "gate"], "left").join(inner.select(*ray, "gate", F.lit(True).alias("_taken")), [*ray, "gate"], "left")
    along = Window.partitionBy(*ray, "object", "_side").orderBy("_k")
    lost = F.col("dbzh").isNull()
    seen = seen.withColumns({"_total": F.sum(lost.cast("int")).over(along), "_last": F.coalesce(F.max(F.when(~lost, F.col("_k"))).over(along), F.lit(0))})
    wrong = F.coalesce(F.col("_taken"), F.lit(False)) | F.when(lost, (F.col("_k") - F.col("_last") > gap) | (F.col("_total") > limit * p.gap_fraction)).otherwise(~F.col("echo") | ~F.col("low") | (F.abs(F.col("_c") - F.col("_m")) > p.edge_db))
    reach = seen.withColumn("_stop", F.max(wrong.cast("int")).over(along)).filter((F.col("_stop") == 0) & ~lost)
    first = F.min("object").over(Window.partitionBy(*ray, "gate"))
    won = reach.withColumn("_lost", (F.col("object") != first).cast("int")).withColumn("_lost", F.max("_lost").over(along)).filter("_lost = 0")
    added = won.select(*ray, "gate", "object", F.col("_c").alias("corrected"), F.lit(True).alias("linked"), *[F.lit(False).alias(c) for c in ("own", "rough", "high_rho")], F.lit(True).alias("edge"))
    return inner.withColumn("edge", F.lit(False)).unionByName(added)


def peripheral(seeds: DataFrame, inner: DataFrame, sweep: list[str], p: Objects = Objects()) -> DataFrame:
    """The gates (ray, gate) around objects that are to be checked: supported echo that
    is not protected and has contrast, low correlation, rough structure or, with
    ``p.high_rho``, a smooth signature, within ``p.review_m`` along the ray (one gate at
    least) and ``p.review_deg`` to either side of a member (of ``with_edges``). They are
    no members. The range does not go on from the last ray to ray 0."""
    ray = [*sweep, "ray"]
    along, across = max(1, int(p.review_m // p.spacing_m)), max(0, math.ceil(p.review_deg * p.rays / 360))
    smooth = F.lit(p.high_rho) & (F.col("axial_std") <= p.own_std_db)
    seen = seeds.filter(F.col("echo") & (F.col("support") >= p.support) & ~F.col("protected") & (F.col("rough") | F.col("stands") | F.col("low") | smooth))
    beside = inner.select(*sweep, "ray", "gate", F.explode(F.array(*[F.lit(d) for d in range(-across, across + 1)])).alias("_d")).select(*sweep, (F.col("ray") + F.col("_d")).alias("ray"), "gate", F.lit(False).alias("_seen"), F.lit(True).alias("_near"), (F.col("_d") == 0).alias("_taken"))
    rows = seen.select(*ray, "gate", F.lit(True).alias("_seen"), F.lit(False).alias("_near"), F.lit(False).alias("_taken")).union(beside)
    at = rows.groupBy(*ray, "gate").agg(*[F.bool_or(c).alias(c) for c in ("_seen", "_near", "_taken")])
    near = F.bool_or("_near").over(Window.partitionBy(*ray).orderBy("gate").rangeBetween(-along, along))
    return at.withColumn("_near", near).filter("_seen AND _near AND NOT _taken").select(*ray, "gate")


def object_gates(seeds: DataFrame, inner: DataFrame, sweep: list[str], p: Objects = Objects()) -> DataFrame:
    """All gates that objects claim, from ``object_seeds`` and the gates of
    ``radial_objects``: members, edges and, with ``p.review``, the gates around them
    that are to be checked (object 0, review). Both frames are read several times."""
    g = with_edges(seeds, inner, sweep, p).drop("corrected").withColumn("review", F.lit(False))
    if not p.review:
        return g
    g = stored(g)
    no = [F.lit(False).alias(c) for c in ("linked", "own", "rough", "high_rho", "edge")]
    around = peripheral(seeds, g, sweep, p).select(*sweep, "ray", "gate", F.lit(0).cast("long").alias("object"), *no, F.lit(True).alias("review"))
    return g.unionByName(around)


def grown(gates: DataFrame, sweep: list[str], rays: int, range_gates: int) -> DataFrame:
    """The gates that seeds reach within their object: along the ray through
    neighbouring allowed gates, ``range_gates`` at most to either side of a seed, then
    one ray to either side. ``gates`` have object (0: none), seed and allowed, and each
    gate once; seeds are not among what is given."""
    ray = [*sweep, "ray"]
    o = Window.partitionBy(*ray).orderBy("gate")
    ok = F.col("allowed") & (F.col("object") > 0)
    g = placed(gates, sweep).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    reached = []
    for side in (-1, 1):
        w = o if side < 0 else Window.partitionBy(*ray).orderBy(F.col("gate").desc())
        goes = F.col("_ok") & (F.lag("object").over(w) == F.col("object")) & (F.abs(F.lag("gate").over(w) - F.col("gate")) == 1)
        name = f"_goes{side + 1}"
        g = g.withColumn(name, F.coalesce(goes, F.lit(False)))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        seed_at, stop_at = F.last(F.when(F.col("seed"), F.col("gate")), ignorenulls=True).over(before), F.last(F.when(~F.col(name), F.col("gate")), ignorenulls=True).over(w)
        near = (F.abs(F.col("gate") - seed_at) <= range_gates) & ((stop_at <= seed_at) if side < 0 else (stop_at >= seed_at) | stop_at.isNull())
        reached.append(F.coalesce(F.col(name) & near, F.lit(False)))
    g = g.withColumn("_r", F.col("seed") | reached[0] | reached[1])
    beside = g.filter("_r AND object > 0").select(*sweep, F.explode(F.array(*[F.pmod(F.col("ray") + d, F.lit(rays)) for d in (-1, 1)])).alias("ray"), "gate", F.col("object").alias("_from")).distinct()
    met = g.filter("_ok AND NOT _r").join(beside, [*ray, "gate"]).filter("object = _from")
    return g.filter("_r AND NOT seed").select(*ray, "gate", "object").union(met.select(*ray, "gate", "object")).distinct()


def local_widths(gates: DataFrame, sweep: list[str], rays: int, where: Column, name: str) -> DataFrame:
    """Adds ``name``: degrees of the run around the circle, at its range, that a gate
    where the condition holds is in; null elsewhere."""
    at = [*sweep, "gate"]
    w = Window.partitionBy(*at, "_on").orderBy("ray")
    g = placed(gates, sweep).withColumn("_on", F.coalesce(where, F.lit(False)))
    g = g.withColumn("_run", F.col("ray") - F.row_number().over(w))
    run = Window.partitionBy(*at, "_on", "_run")
    g = g.withColumns({"_n": F.count("*").over(run), "_lo": F.min("ray").over(run), "_hi": F.max("ray").over(run)})
    ring = Window.partitionBy(*at, "_on")
    head, tail = F.max(F.when(F.col("_lo") == 0, F.col("_n"))).over(ring), F.max(F.when(F.col("_hi") == rays - 1, F.col("_n"))).over(ring)
    touches = (F.col("_lo") == 0) | (F.col("_hi") == rays - 1)
    n = F.when(touches & head.isNotNull() & tail.isNotNull() & (F.col("_n") < rays), head + tail).otherwise(F.col("_n"))
    return g.withColumn(name, F.when(F.col("_on"), n * F.lit(360.0 / rays))).drop("_on", "_run", "_n", "_lo", "_hi")


def hypotheses(gates: DataFrame, sweep: list[str], p: Graph = Graph()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gates with their hypothesis, the hypotheses, and the links between atoms.

    ``gates`` have pol_bad (measured), weather (supported), parent (member of an
    object or range signature), donor (kept, so a shoulder) and reliable, all boolean.
    Evidence is contrast with both shoulders, a parent, or bad polarimetry; where
    weather is supported without bad polarimetry a gate is protected. Evidence that is
    narrow around the circle makes atoms, runs of ``p.atom_m`` at least; atoms of one
    ray are linked over short gaps without protected gates and measured clear air. A
    group that is long, measured enough and longer than wide is a hypothesis. kind:
    1 narrow, 2 a bundle, 3 of several atoms, 4 far. model: its shape alone sets it
    apart. Gates get hypothesis (0: none), kind, proposal, review, model and
    reason, the bits of ``REASONS``; links are (ray, from, to: first gates, gap_m).
    Nulls of the boolean columns are false."""
    ray = [*sweep, "ray"]
    dr = p.spacing_m
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("pol_bad", "weather", "parent", "donor", "reliable")}
    g = shoulders(gates.withColumns(flags), sweep, p.rays, p.offsets_deg, "donor")
    g = g.withColumns({"echo": (F.col("dbzh") >= p.echo_dbz) & (F.col("range_m") >= p.minimum_range_m), "protected": F.col("weather") & ~F.col("pol_bad"), "stands": F.coalesce(F.col("contrast") >= p.contrast_db, F.lit(False)), "corrected": corrected(p)})
    g = g.withColumn("raw", F.col("echo") & ~F.col("protected") & (F.col("stands") | F.col("parent") | F.col("pol_bad")))
    g = local_widths(g, sweep, p.rays, F.col("raw"), "_wide")
    g = local_widths(g, sweep, p.rays, F.col("raw") & F.col("stands"), "_inner")
    corridor = F.col("stands") & F.coalesce(F.col("_inner") <= p.narrow_deg, F.lit(False))
    g = g.withColumns({"allowed": F.col("raw") & ((F.col("_wide") <= p.bundle_deg) | corridor), "width": F.when(corridor, F.least("_wide", "_inner")).otherwise(F.col("_wide")), "barrier": F.col("protected") | ~F.col("echo")})
    least = max(1, -int(-p.atom_m // dr))
    run = F.col("gate") - F.row_number().over(Window.partitionBy(*ray, "allowed").orderBy("gate"))
    g = g.withColumn("_run", run)
    g = g.withColumn("proposal", F.col("allowed") & (F.count("*").over(Window.partitionBy(*ray, "allowed", "_run")) >= least)).drop("_run")
    parts = intervals(g, ray, F.col("proposal"), F.col("barrier"), int(p.gap_m // dr), p.gap_fraction)

    m = members(g, parts, ray).filter("proposal").withColumn("_c", half(F.col("corrected")).over(Window.partitionBy(*ray, "part")))
    m = m.withColumn("_first", F.coalesce(F.col("gate") - F.lag("gate").over(Window.partitionBy(*ray, "part").orderBy("gate")) > 1, F.lit(True)))
    s = m.groupBy(*ray, "part", "first", "last", "n").agg(F.max("width").alias("width_deg"), F.percentile(F.abs(F.col("corrected") - F.col("_c")), F.lit(0.9)).alias("p90_db"), F.avg(F.col("stands").cast("double")).alias("shoulder_fraction"), F.count_if("_first").alias("atoms"), F.min("range_m").alias("near_m"), F.max("range_m").alias("far_m"))
    s = s.withColumns({"span_m": (F.col("last") - F.col("first") + 1) * dr, "measured_m": F.col("n") * dr})
    across = F.greatest(F.lit(dr), (F.col("near_m") + F.col("far_m")) / 2 * F.radians("width_deg"))
    s = s.withColumns({
        "short": (F.col("span_m") < p.span_m) | (F.col("measured_m") < p.measured_m), "aspect": F.col("span_m") / across,
        "model": (F.col("measured_m") >= p.model_m) & (F.col("width_deg") <= p.model_deg) & (F.col("p90_db") <= p.model_p90_db) & (F.col("shoulder_fraction") >= p.shoulder_fraction),
        "kind": F.when(F.col("near_m") >= p.far_m, 4).when(F.col("atoms") > 1, 3).when(F.col("width_deg") > p.model_deg, 2).otherwise(1),
    }).withColumn("stays", ~F.col("short") & (F.col("aspect") >= p.aspect))
    number = F.row_number().over(Window.partitionBy(*sweep).orderBy("ray", "first"))
    found = s.filter("stays").withColumn("hypothesis", number.cast("long"))
    s = s.join(found.select(*ray, "part", "hypothesis"), [*ray, "part"], "left")

    of_gate = m.select(*ray, "gate", "part").join(s.select(*ray, "part", "short", "stays", "model", "kind", "hypothesis"), [*ray, "part"]).drop("part")
    g = g.join(of_gate, [*ray, "gate"], "left")
    on = lambda name, c: F.when(F.coalesce(c, F.lit(False)), REASONS[name]).otherwise(0)
    review = F.coalesce(F.col("stays"), F.lit(False))
    bits = [
        on("protected", F.col("echo") & F.col("protected")), on("no_evidence", F.col("echo") & ~F.col("raw") & ~F.col("protected")), on("wide", (F.col("raw") & ~F.col("allowed")) | (~F.col("short") & ~F.col("stays"))),
        on("one_shoulder", F.col("echo") & F.col("one_sided") & F.col("contrast").isNull()), on("short_atom", F.col("allowed") & ~F.col("proposal")), on("short_group", F.col("short")),
        on("review", review), on("model", review & F.col("model")), on("unavailable", review & ~F.col("reliable")),
    ]
    out = g.select(*gates.columns, F.coalesce("hypothesis", F.lit(0)).alias("hypothesis"), F.when(review, F.col("kind")).otherwise(0).alias("kind"), "proposal", review.alias("review"), (review & F.col("model")).alias("model"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("reason"))
    records = found.select(*sweep, "hypothesis", "ray", "first", "last", "atoms", "kind", "measured_m", "span_m", "width_deg", "p90_db", "shoulder_fraction", "aspect", "model")
    before = F.lag("gate").over(Window.partitionBy(*ray, "part").orderBy("gate"))
    begins = m.withColumn("_gap", (F.col("gate") - before - 1) * dr).filter("_first")
    links = begins.withColumn("from", F.lag("gate").over(Window.partitionBy(*ray, "part").orderBy("gate"))).filter("from IS NOT NULL").select(*ray, "from", F.col("gate").alias("to"), F.col("_gap").alias("gap_m"))
    return out, records, links


def arbitrated(gates: DataFrame, quarantine_models: bool = True) -> DataFrame:
    """Adds ``action`` (KEEP, DOWNWEIGHT or REJECT), confirmed, isolated and the last
    bits of ``reason`` to gates of ``hypotheses``; ``gates`` keep old_action and
    plateau (a range model of an unverified plateau), which is never confirmed.

    A hypothesis is rejected where a gate's own polarimetry is bad, and held back
    where its shape alone sets it apart, unless weather is supported. Old
    rejections and old quarantines stay."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    confirmed = F.col("review") & yes("pol_bad") & ~yes("plateau")
    g = gates.withColumn("confirmed", confirmed)
    g = g.withColumn("isolated", F.col("model") & F.lit(quarantine_models) & ~yes("weather") & ~F.col("confirmed"))
    old = F.coalesce(F.col("old_action"), F.lit("KEEP"))
    action = F.when((old == "REJECT") | F.col("confirmed"), "REJECT").when((old == "DOWNWEIGHT") | F.col("isolated"), "DOWNWEIGHT").otherwise("KEEP")
    late = [F.when(c, REASONS[n]).otherwise(0) for n, c in (("confirmed", F.col("confirmed")), ("quarantined", F.col("isolated")), ("unresolved", F.col("review") & ~F.col("confirmed") & ~F.col("isolated")))]
    return g.withColumns({"action": action, "reason": reduce(lambda a, b: a.bitwiseOR(b), late, F.col("reason"))})


def associated(gates: DataFrame, sweep: list[str], p: Fragments = Fragments()) -> DataFrame:
    """The gates that belong to an anchor of their ray: fragment (its number in the
    sweep, by ray and gate), linked, parent (the anchor's gate), distance_m and
    residual_db (null for the anchor's own gates).

    ``gates`` have anchor and grows (the anchor follows a source's growth with range,
    so values are compared after it). An anchor is a run of ``p.anchor_m`` of anchor
    gates with echo. Another gate with echo, which is no anchor gate, is linked to the
    nearest anchor gate, the inner one of equals, if it is near enough and like it.
    What lies between is no part of either."""
    ray = [*sweep, "ray"]
    dr = p.spacing_m
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    g = placed(gates, sweep).filter((F.col("dbzh") >= p.echo_dbz) & (F.col("range_m") >= p.minimum_range_m)).withColumns({"_a": yes("anchor"), "_grows": yes("grows")})
    o = Window.partitionBy(*ray).orderBy("gate")
    g = g.withColumn("_run", F.col("gate") - F.row_number().over(Window.partitionBy(*ray, "_a").orderBy("gate")))
    g = g.withColumn("_seed", F.col("_a") & (F.count("*").over(Window.partitionBy(*ray, "_a", "_run")) * dr >= p.anchor_m))
    starts = F.col("_seed") & F.coalesce((F.lag("gate").over(o) != F.col("gate") - 1) | ~F.lag("_seed").over(o), F.lit(True))
    heads = g.withColumn("_starts", starts).filter("_starts").select(*ray, "gate").withColumn("fragment", F.row_number().over(Window.partitionBy(*sweep).orderBy("ray", "gate")).cast("long"))
    g = g.join(heads, [*ray, "gate"], "left")
    g = g.withColumn("fragment", F.when(F.col("_seed"), F.last("fragment", ignorenulls=True).over(o)))
    at = F.when(F.col("_seed"), F.struct("gate", "range_m", "dbzh", "_grows", "fragment"))
    left = F.last(at, ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(at, ignorenulls=True).over(o.rowsBetween(1, Window.unboundedFollowing))
    g = g.withColumns({"_l": left, "_r": right})
    near = F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull() | (F.col("gate") - F.col("_l.gate") <= F.col("_r.gate") - F.col("gate")), F.col("_l")).otherwise(F.col("_r"))
    g = g.withColumn("_p", F.when(~F.col("_a"), near))
    floor = lambda c: F.greatest(c, F.lit(dr / 2))
    growth = F.when(F.col("_p._grows"), F.lit(20.0) * F.log10(floor(F.col("range_m")) / floor(F.col("_p.range_m")))).otherwise(0.0)
    g = g.withColumns({"distance_m": F.abs(F.col("range_m") - F.col("_p.range_m")), "residual_db": F.abs(F.col("dbzh") - F.col("_p.dbzh") - growth)})
    linked_ = F.coalesce((F.col("distance_m") <= p.distance_m) & (F.col("residual_db") <= p.difference_db), F.lit(False)) & F.lit(p.distance_m > 0)
    g = g.withColumn("linked", linked_).filter("_seed OR linked")
    mine = lambda c: F.when(F.col("linked"), c)
    return g.select(*ray, "gate", F.when(F.col("linked"), F.col("_p.fragment")).otherwise(F.col("fragment")).alias("fragment"), "linked", mine(F.col("_p.gate")).alias("parent"), mine(F.col("distance_m")).alias("distance_m"), mine(F.col("residual_db")).alias("residual_db"))
