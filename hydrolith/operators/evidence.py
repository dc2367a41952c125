"""Evidence-based decisions on gates, and matching of observations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions.basic import apart, ratio

# Reasons by bit.
REASONS = {
    "INVALID_OBSERVATION": 1, "INDEPENDENT_NONMET_EVIDENCE": 2, "RADIAL_AND_POLARIMETRIC": 4, "STATIC_CLUTTER_AND_POLARIMETRIC": 8, "WEAK_OBJECT_AND_NOISE": 16,
    "WEATHER_SUPPORT_CONFLICT": 32, "WEATHER_PROTECTED_WEAK_CANDIDATE": 64, "SINGLE_FAMILY_CANDIDATE": 128, "INCOMPLETE_CAPABILITY": 256, "LOW_SNR": 512,
}
ACTIONS = ("KEEP", "DOWNWEIGHT", "REJECT", "MISSING")


@dataclass(frozen=True)
class Limits:
    dry_dbz: float = -10.0
    strong_dbz: float = 35.0
    low_meteo: float = 0.35
    severe_rhohv: float = 0.70
    low_snr_db: float = 3.0
    strong_support: float = 0.7
    prior: float = 0.7
    least_quality: float = 0.45


def decide(gates: DataFrame, p: Limits = Limits()) -> DataFrame:
    """Adds action, reasons, quality, trusted and eligible to gates with dbzh,
    rhohv, snr, meteo_score, weather_support, clutter_prior, radial, structure,
    small_object, pol_moments and quality_cap.

    Evidence that is null is unknown and never counts against weather.
    """
    no = F.lit(False)
    known = lambda c: F.coalesce(c, no)
    d = F.col("dbzh")
    observed = d.isNotNull()
    rain = known(d >= p.dry_dbz)
    weather = known(F.col("weather_support") >= p.strong_support)
    low_meteo, severe = known(F.col("meteo_score") <= p.low_meteo), known(F.col("rhohv") < p.severe_rhohv)
    low_snr = rain & known(F.col("snr") < p.low_snr_db)
    prior, radial, structure, small = known(F.col("clutter_prior") >= p.prior), known(F.col("radial")), known(F.col("structure")), known(F.col("small_object"))
    why = {
        "INVALID_OBSERVATION": ~observed,
        "INDEPENDENT_NONMET_EVIDENCE": rain & structure & low_meteo & ~weather,
        "RADIAL_AND_POLARIMETRIC": rain & radial & severe & (F.col("pol_moments") >= 2),
        "STATIC_CLUTTER_AND_POLARIMETRIC": rain & prior & low_meteo & ~weather,
        "WEAK_OBJECT_AND_NOISE": rain & small & low_snr & severe & known(d < p.strong_dbz) & ~weather,
        "WEATHER_SUPPORT_CONFLICT": rain & weather & low_meteo & (structure | prior),
        "WEATHER_PROTECTED_WEAK_CANDIDATE": rain & weather & small & low_snr,
        "SINGLE_FAMILY_CANDIDATE": rain & structure & ~low_meteo,
        "INCOMPLETE_CAPABILITY": observed & (F.col("meteo_score").isNull() | F.col("rhohv").isNull()),
        "LOW_SNR": low_snr,
    }
    rejects = ("INDEPENDENT_NONMET_EVIDENCE", "RADIAL_AND_POLARIMETRIC", "STATIC_CLUTTER_AND_POLARIMETRIC", "WEAK_OBJECT_AND_NOISE")
    reject = why[rejects[0]] | why[rejects[1]] | why[rejects[2]] | why[rejects[3]]
    unsure = why["WEATHER_SUPPORT_CONFLICT"] | why["SINGLE_FAMILY_CANDIDATE"] | why["INCOMPLETE_CAPABILITY"] | low_snr
    bits = F.lit(0)
    for name, where in why.items():
        bits = bits + F.when(where, F.lit(REASONS[name])).otherwise(F.lit(0))
    quality = F.when(~observed, None).when(reject, F.lit(0.0)).otherwise(F.least(F.coalesce("quality_cap", F.lit(1.0)), F.when(unsure, F.lit(0.6)).otherwise(F.lit(1.0))))
    action = F.when(~observed, "MISSING").when(reject, "REJECT").when(unsure, "DOWNWEIGHT").otherwise("KEEP")
    return gates.withColumns({"action": action, "reasons": bits.cast("int"), "quality": quality}).withColumns({"trusted": observed & (F.col("action") != "REJECT"), "eligible": F.coalesce(observed & (F.col("action") != "REJECT") & (F.col("quality") >= p.least_quality), no)})


def votes(volumes: DataFrame, gate: list[str], order: str, hit: str, past: int) -> DataFrame:
    """Adds ``available`` and ``persistence``: the share of at most ``past``
    earlier volumes in which a gate was hit."""
    from pyspark.sql import Window

    w = Window.partitionBy(*gate).orderBy(order).rowsBetween(-past, -1)
    n = F.count(hit).over(w)
    return volumes.withColumns({"available": n, "persistence": ratio(F.sum(F.col(hit).cast("int")).over(w), n)})


def support(vertical: Column, cross: Column, radial: Column) -> Column:
    """Weather support of a gate: the largest that is known; radial candidates
    use other radars only."""
    return F.when(radial, cross).otherwise(F.greatest(vertical, cross))


def action_counts(gates: DataFrame, label: str, strong_dbz: float = 35.0) -> DataFrame:
    """Rejected and withheld gates for each label, strong echoes apart."""
    strong = F.col("dbzh") >= strong_dbz
    bad = F.col("action") == "REJECT"
    return gates.groupBy(label).agg(F.count("*").alias("gates"), F.count_if(bad).alias("rejected"), F.count_if(bad & strong).alias("strong_rejected"), F.count_if(F.col("action") == "DOWNWEIGHT").alias("withheld"), F.count_if(strong).alias("strong"))


def nearest_azimuth(rays: DataFrame, targets: DataFrame, keys: list[str], step_deg: float, most_deg: float) -> DataFrame:
    """For each target azimuth the nearest ray, ties to the lower ray.

    Rays are bucketed by ``step_deg``, which is at least the largest distance
    wanted, and a target meets three buckets around the circle."""
    if step_deg < most_deg:
        raise ValueError("step_deg is at least most_deg")
    n = int(360 // step_deg)
    b = lambda c: F.pmod(F.floor(F.col(c) / F.lit(360.0 / n)), F.lit(n)).cast("int")
    t = targets.withColumn("_b", F.explode(F.array_distinct(F.array(*[F.pmod(b("azimuth") + d, F.lit(n)) for d in (-1, 0, 1)]))))
    r = rays.select(*keys, F.col("ray"), F.col("azimuth").alias("_a"), b("azimuth").alias("_b"))
    d = F.round(apart(F.col("_a"), F.col("azimuth")), 9)
    pairs = t.join(r, [*keys, "_b"]).withColumn("_d", d).filter(F.col("_d") <= most_deg)
    return pairs.groupBy(*keys, "azimuth").agg(F.min_by(F.struct("ray", F.col("_d").alias("offset_deg")), F.struct("_d", "ray")).alias("_r")).select(*keys, "azimuth", "_r.*")


def beams_overlap(a: DataFrame, b: DataFrame, cell: list[str], most_m: float) -> DataFrame:
    """Pairs of beams over one cell whose heights, each with its radius, come
    within ``most_m``: an equality join on the cell, then the heights."""
    right = b.select(*cell, F.col("radar").alias("other"), F.col("height_m").alias("_h"), F.col("radius_m").alias("_r"))
    gap = F.abs(F.col("height_m") - F.col("_h")) - F.col("radius_m") - F.col("_r")
    return a.join(right, cell).filter((F.col("radar") != F.col("other")) & (gap <= most_m)).select(*cell, "radar", "other", F.greatest(gap, F.lit(0.0)).alias("gap_m"))


#: Distances between places that a task holds at once.
PLACE_PAIRS = 4_000_000


def nearest_fields(p: dict[str, np.ndarray], f: dict[str, np.ndarray], most_s: float, most_m: float) -> tuple[np.ndarray, ...]:
    """For points (x, y, t) the nearest of fields (x, y, t and the id's rank): row of
    the point and of the field, distance and offset, for points that have one.

    The places around a place are taken by distance, so a point looks at few of them;
    within a place the fields next to its time are found by bisection."""
    order = np.lexsort((f["id"], f["t"], f["y"], f["x"]))
    x, y, t = (f[c][order] for c in "xyt")
    other = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    first = other | np.r_[True, t[1:] != t[:-1]]  # of one place and time the least id
    order, x, y, t, other = order[first], x[first], y[first], t[first], other[first]
    place, begin = np.cumsum(other) - 1, np.flatnonzero(other)
    end, fx, fy, ids = np.r_[begin[1:], len(x)], x[begin], y[begin], f["id"][order]
    times = np.unique(t)
    code = place * (len(times) + 1) + np.searchsorted(times, t)
    spots, of = np.unique(np.stack([p["x"], p["y"]], axis=1), axis=0, return_inverse=True)
    of = of.ravel()
    after = np.searchsorted(times, p["t"], side="right")
    d, s, row = np.full(len(of), np.inf), np.zeros(len(of), p["t"].dtype), np.full(len(of), -1)
    by_spot = np.argsort(of, kind="stable")
    step = max(1, PLACE_PAIRS // len(fx))
    for a in range(0, len(spots), step):
        far = np.sqrt((spots[a : a + step, :1] - fx) ** 2 + (spots[a : a + step, 1:] - fy) ** 2)
        near = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, near, axis=1)
        held = (far <= most_m).sum(axis=1)
        open_ = by_spot[np.searchsorted(of[by_spot], a) : np.searchsorted(of[by_spot], a + step)]
        for k in range(int(held.max(initial=0))):
            spot = of[open_] - a
            going = (k < held[spot]) & (far[spot, k] <= d[open_])  # a place as near as the best one still counts
            open_, spot = open_[going], spot[going]
            if not len(open_):
                break
            j, dk = near[spot, k], far[spot, k]
            at = np.searchsorted(code, j * (len(times) + 1) + after[open_])
            for c, there in ((at - 1, at > begin[j]), (at, at < end[j])):
                c = np.where(there, c, 0)
                sk = np.abs(p["t"][open_] - t[c])
                best = row[open_]
                nearer = (dk < d[open_]) | (sk < s[open_]) | ((sk == s[open_]) & (ids[c] < ids[best]))
                take = there & (sk <= most_s) & (nearer | (best < 0))
                o = open_[take]
                d[o], s[o], row[o] = dk[take], sk[take], c[take]
    found = np.flatnonzero(row >= 0)
    return found, order[row[found]], d[found], s[found]


def matched_observations(points: DataFrame, fields: DataFrame, key: str, most_s: int, most_m: float) -> DataFrame:
    """For each point observation the nearest field value in space and time,
    never interpolated: least distance, then least time, then id.

    Blocks of time and of a square grid are twice the largest distance wide. A point
    goes to its block and a field to those within reach, at most eight; a group is a
    block's points with the fields around it, and no pairs of rows are made."""
    names = {"t": ("t", most_s), "x": ("x_m", most_m), "y": ("y_m", most_m)}
    blocks = [f"_{c}" for c in names]
    at = lambda c, most: F.floor(c / F.lit(2.0 * most))
    p = points.dropna(subset=["t", "x_m", "y_m"]).select(key, "t", "x_m", "y_m", *[at(F.col(c), m).alias(f"_{n}") for n, (c, m) in names.items()])
    f = fields.dropna(subset=["t", "x_m", "y_m"]).select("id", "value", F.col("t").alias("ft"), F.col("x_m").alias("fx"), F.col("y_m").alias("fy"))
    for n, (_, m) in names.items():
        c = F.col(f"f{n}")
        f = f.withColumn(f"_{n}", F.explode(F.sequence(at(c - 1.001 * m, m), at(c + 1.001 * m, m))))

    def nearest(p: pa.Table, f: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        rows = (none, none, none, none)
        if p.num_rows and f.num_rows:
            ids = pc.rank(f["id"].combine_chunks(), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
            own, other = ({n: g[c].to_numpy() for n, c in at} for g, at in ((p, zip("xyt", ("x_m", "y_m", "t"))), (f, zip("xyt", ("fx", "fy", "ft")))))
            rows = nearest_fields(own, other | {"id": ids}, most_s, most_m)
        i, j, d, s = rows
        return pa.table({key: p[key].take(pa.array(i)), "field_id": f["id"].take(pa.array(j)), "value": f["value"].take(pa.array(j)), "distance_m": pa.array(d, pa.float64()), "offset_s": pa.array(s).cast(p.schema.field("t").type)})

    kinds, of = dict(points.dtypes), dict(fields.dtypes)
    schema = f"`{key}` {kinds[key]}, field_id {of['id']}, value {of['value']}, distance_m double, offset_s {kinds['t']}"
    best = p.groupBy(*blocks).cogroup(f.groupBy(*blocks)).applyInArrow(nearest, schema)
    return best.groupBy(key).agg(F.min_by(F.struct("field_id", "value", "distance_m", "offset_s"), F.struct("distance_m", "offset_s", "field_id")).alias("_r")).select(key, "_r.*")
