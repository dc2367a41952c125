"""Cells: quality control, first usable sweep, composites, rain, accumulation,
ensembles. One row is one value of one cell of one source.

Everything that needs a whole cell is an aggregation by cell with partial sums.
Blending needs the cell's best quality first; the aggregate keeps one row for
each cell and joins it back on the cell, which has as many rows as sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions import physics as ph
from hydrolith.functions.basic import has_any, has_none, ratio, set_flags
from hydrolith.operators import ranks
from hydrolith.profiles import REJECT, Health, Hybrid, Mosaic, NowcastInput, Qc, Qpe, flag


def basic_qc(gates: DataFrame, p: Qc = Qc()) -> DataFrame:
    """Adds valid, no_rain, dbzh_qc, p_meteo, qi_interference, qi_range,
    quality and qc_flags to gates with dbzh, snr, rhohv, p_radial, p_clutter,
    gate, last_gate and health.

    Values are flagged, not changed; null stands for missing and never for dry.
    """
    d = F.col("dbzh")
    valid = d.isNotNull() & d.between(*p.range_dbz)
    no_rain = valid & (d < p.dry_dbz)
    g = gates.withColumns({"valid": F.coalesce(valid, F.lit(False)), "no_rain": F.coalesce(no_rain, F.lit(False))})
    low_snr = F.col("valid") & ~F.col("no_rain") & F.coalesce(F.col("snr") < p.low_snr_db, F.lit(False))
    radial = F.coalesce(F.col("p_radial"), F.lit(0.0))
    clutter = F.coalesce(F.col("p_clutter"), F.lit(0.0))
    g = g.withColumns({
        "dbzh_qc": F.when(F.col("valid"), d),
        "p_meteo": ph.weather_probability(F.col("snr"), F.col("rhohv"), F.col("valid"), F.col("no_rain")),
        "qi_interference": F.when(F.col("p_radial").isNotNull(), F.lit(1.0) - F.col("p_radial")),
        "qi_range": ph.range_quality(F.col("gate"), F.col("last_gate")),
    })
    meteo = F.col("p_meteo") * (F.lit(1.0) - clutter)
    whole = ph.product_of_available([meteo, F.col("qi_interference"), F.col("qi_range")])
    quality = F.when(F.col("valid"), whole * F.when(F.col("health") == "DEGRADED", F.lit(p.degraded_factor)).otherwise(F.lit(1.0)))
    g = g.withColumn("quality", quality)
    flags = F.lit(0).cast("long")
    for name, where in (
        ("HARDWARE_ANOMALY", d.isNotNull() & ~F.col("valid")),
        ("MISSING", ~F.col("valid")),
        ("LOW_SNR", low_snr),
        ("RADIAL_INTERFERENCE", F.col("valid") & (radial >= p.interference)),
        ("GROUND_CLUTTER", F.col("valid") & (clutter >= p.clutter)),
        ("LOW_QUALITY", F.col("valid") & ((F.col("quality") < p.low_quality) | low_snr | (radial >= p.interference_low_quality))),
    ):
        flags = set_flags(flags, flag(name), F.coalesce(where, F.lit(False)))
    return g.filter((F.col("health").isin("HEALTHY", "DEGRADED"))).withColumn("qc_flags", flags)


def health_state(n: dict[str, Column], p: Health = Health()) -> Column:
    """struct(state, reasons) of a scan from its figures: completeness, gap_deg,
    step_deg, has_dbzh, fields_missing, outlier_ratio, odd_layers, noise_low,
    noise_high, config_ready, time_warning. Reasons are sorted."""
    gap = n["gap_deg"] > F.greatest(F.lit(p.azimuth_gap_deg), n["step_deg"] * F.lit(p.azimuth_gap_steps))
    noise = F.when(n["noise_low"].isNull(), "NOISE_TELEMETRY_MISSING").when((n["noise_low"] < p.noise_dbm[0]) | (n["noise_high"] > p.noise_dbm[1]), "NOISE_OUT_OF_RANGE")
    reasons = F.array_sort(F.array_compact(F.array(
        F.when(~n["has_dbzh"], "DBZH_UNAVAILABLE"), F.when(n["completeness"] < p.degraded_under, "SCAN_INCOMPLETE"), F.when(gap, "AZIMUTH_GAP"), F.when(n["fields_missing"] > 0, "FIELD_UNAVAILABLE"),
        F.when((n["outlier_ratio"] > p.outlier_ratio) | (n["odd_layers"] > 0), "ANOMALOUS_VALUES"), noise, F.when(~n["config_ready"], "CONFIG_NOT_READY"), F.when(n["time_warning"], "SOURCE_TIME_MISMATCH"),
    )))
    state = F.when(~n["has_dbzh"] | (n["completeness"] < p.unavailable_under), "UNAVAILABLE").when(F.size(reasons) > 0, "DEGRADED").otherwise("HEALTHY")
    return F.struct(state.alias("state"), reasons.alias("reasons"))


def hybrid_usable(p: Hybrid = Hybrid(), reject: tuple[str, ...] = REJECT) -> Column:
    """Usable cells of a sweep: a value, quality, blockage, height, no bad flag
    and a gate near enough."""
    test = (
        F.col("dbzh").isNotNull() & F.col("valid") & has_none(F.col("qc_flags"), flag(*reject)) & (F.col("quality") >= p.source_quality) & (F.col("blockage") <= p.blockage)
        & F.col("agl_m").between(0.0, p.most_agl_m) & (F.col("azimuth_offset_deg") <= p.azimuth_offset_deg) & (F.col("range_offset_gates") <= p.range_offset_gates)
    )
    return F.coalesce(test, F.lit(False))


def hybrid_scan(cells: DataFrame, cell: list[str], p: Hybrid = Hybrid()) -> DataFrame:
    """For each cell its lowest usable sweep (by elevation, then name, and of rows
    of one sweep the least flags, quality and value): value, quality lowered by
    blockage and height, and flags. A cell without one is missing, and flagged as
    blocked where a sweep was blocked badly."""
    usable = hybrid_usable(p)
    quality = F.col("quality") * (F.lit(1.0) - F.col("blockage")) * ph.decay(F.col("agl_m"), p.height_scale_m)
    r = cells.withColumns({"_u": usable, "_q": quality})
    pick = F.min_by(F.when(F.col("_u"), F.struct("sweep", "dbzh", F.col("_q").alias("quality"), "blockage", "qc_flags")), F.when(F.col("_u"), F.struct("elevation_deg", "sweep", "qc_flags", "_q", "dbzh", "blockage")))
    severe = F.max(F.coalesce(F.col("blockage") > p.blockage, F.lit(False)))
    out = r.groupBy(*cell).agg(pick.alias("_p"), severe.alias("_s"))
    blocked = flag("BEAM_BLOCKED")
    flags = F.when(F.col("_p").isNull(), F.lit(flag("MISSING")).cast("long").bitwiseOR(F.when(F.col("_s"), F.lit(blocked)).otherwise(F.lit(0)).cast("long"))).otherwise(
        set_flags(F.col("_p.qc_flags"), blocked, F.col("_p.blockage") >= p.flag_blockage)
    )
    return out.select(*cell, F.col("_p.sweep").alias("sweep"), F.col("_p.dbzh").alias("dbzh"), F.col("_p.quality").alias("quality"), flags.alias("qc_flags"), F.col("_p").isNotNull().alias("valid"))


def mosaic(cells: DataFrame, cell: list[str], p: Mosaic = Mosaic(), sources: DataFrame | None = None) -> DataFrame:
    """Blends the sources of each cell in linear reflectivity: value, quality,
    age, flags, how many contribute and the code of the source.

    ``cells`` has source, code, dbzh, valid, quality, qc_flags, offset_s,
    data_age_min and, for the method "distance", distance_m. By "quality" the
    sources within a gap of the cell's best contribute, by the power of their
    quality; by "distance" all usable ones do, by quality and a Gaussian of the
    distance, normalised in logarithms. Other values are averaged over the
    contributors that have them. A cell without contributors is missing.
    """
    adjusted = F.col("quality") * ph.time_quality(F.col("offset_s"), p.most_offset_s, p.least_time_quality)
    c = cells.withColumn("_q", adjusted)
    usable = F.coalesce(F.col("valid") & F.col("dbzh").isNotNull() & (F.col("_q") >= p.least_quality) & has_none(F.col("qc_flags"), flag(*REJECT)), F.lit(False))
    if p.method == "distance":
        usable = usable & (F.col("_q") > 0)
        weight = F.lit(p.power) * F.log("_q") - F.pow(F.col("distance_m") / F.lit(p.distance_scale_m), F.lit(2.0))
    else:
        weight = F.col("_q")
    c = c.withColumn("_w", F.when(usable, weight))
    best = c.groupBy(*cell).agg(F.max("_w").alias("_best"))
    c = c.join(best, cell)
    if p.method == "distance":
        w = F.exp(F.col("_w") - F.col("_best"))
    else:
        w = F.when(F.col("_w") >= F.col("_best") - F.lit(p.quality_gap), F.pow(F.col("_q"), F.lit(p.power)))
    c = c.withColumn("_c", w)
    mean = lambda x: ratio(F.sum(F.when(x.isNotNull(), x * F.col("_c"))), F.sum(F.when(x.isNotNull(), F.col("_c"))))
    n = F.count("_c")
    out = c.groupBy(*cell).agg(
        n.alias("contributors"),
        ph.to_db(mean(ph.to_linear(F.col("dbzh")))).alias("dbzh"),
        mean(F.col("_q")).alias("quality"),
        mean(F.col("data_age_min") + F.abs("offset_s") / F.lit(60.0)).alias("data_age_min"),
        F.bit_or(F.when(F.col("_c").isNotNull(), F.col("qc_flags"))).alias("_f"),
        F.max(F.when(F.col("_c").isNotNull(), F.col("code"))).alias("_code"),
    )
    valid = F.col("contributors") > 0
    low = valid & (F.col("quality") < p.low_quality)
    return out.select(
        *cell, "contributors", "dbzh", "quality", "data_age_min",
        set_flags(F.when(valid, F.col("_f")).otherwise(F.lit(flag("MISSING")).cast("long")), flag("LOW_QUALITY"), low).alias("qc_flags"),
        F.when(~valid, 0).when(F.col("contributors") == 1, F.col("_code")).otherwise(65535).cast("int").alias("source_code"), valid.alias("valid"),
    )


def source_codes(cells: DataFrame, source: str) -> DataFrame:
    """source and code: its 1-based rank by name. Sources are few: a dimension."""
    from pyspark.sql import Window

    names = cells.select(source).filter(F.col(source).isNotNull()).distinct()
    return names.withColumn("code", F.row_number().over(Window.orderBy(source)).cast("int"))


def column_max(cells: DataFrame, cell: list[str], value: str, source: str) -> DataFrame:
    """The largest value of a cell and its source; of ties the first source."""
    top = F.max_by(F.struct(source, value), F.struct(value, (-F.col(source)).alias("_s")))
    return cells.filter(F.col(value).isNotNull()).groupBy(*cell).agg(top.alias("_t"), F.count("*").alias("layers")).select(*cell, F.col(f"_t.{value}").alias(value), F.col(f"_t.{source}").alias(source), "layers")


def level_winners(cells: DataFrame, cell: list[str], level: str, most_age_min: float, half_height_m: float) -> DataFrame:
    """The best candidate of each height level, then the largest echo of the
    cell: score = quality exp(-age / limit) min(1, grid / resolution) /
    (1 + |height off| / half); of equal scores the first source, then the largest
    echo."""
    score = F.col("quality") * F.exp(-F.col("age_min") / F.lit(most_age_min)) * F.least(F.lit(1.0), F.col("grid_m") / F.col("resolution_m")) / (F.lit(1.0) + F.abs("height_off_m") / F.lit(half_height_m))
    s = cells.withColumn("score", score)
    won = s.groupBy(*cell, level).agg(F.max_by(F.struct("dbzh", "source", "score"), F.struct("score", (-F.col("source")).alias("_s"), "dbzh")).alias("_w"))
    top = F.max_by(F.struct(F.col(level), "_w"), F.struct(F.col("_w.dbzh"), (-F.col(level)).alias("_l")))
    return won.filter("_w.dbzh IS NOT NULL").groupBy(*cell).agg(top.alias("_t"), F.count("*").alias("levels")).select(*cell, F.col("_t._w.dbzh").alias("dbzh"), F.col("_t._w.source").alias("source"), F.col(f"_t.{level}").alias(level), "levels")


def qpe(cells: DataFrame, p: Qpe = Qpe()) -> DataFrame:
    """Adds rate, capped and no_rain to cells with dbzh and valid."""
    ok = F.coalesce(F.col("valid") & F.col("dbzh").isNotNull(), F.lit(False))
    return cells.withColumns({"rate": ph.zr_rate(F.col("dbzh"), F.col("valid"), p), "capped": ok & (F.col("dbzh") >= p.no_rain_dbz) & (ph.zr_raw(F.col("dbzh"), p) > p.cap_mm_h), "no_rain": ok & (F.col("dbzh") < p.no_rain_dbz)})


def field_summary(cells: DataFrame, keys: list[str], value: str = "rate") -> DataFrame:
    """Counts, mean, maximum and interpolated 95th percentile of a field, exact
    for keys of any size."""
    v = F.col(value)
    figures = cells.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count(v).alias("valid_cells"), F.count_if(v.isNull()).alias("missing_cells"), F.count_if(v == 0).alias("dry_cells"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.max(v), F.lit(0.0)).alias("maximum"),
    )
    return ranks.met(figures, ranks.interpolated(cells, keys, value, {"p95": 0.95}).drop("n"), keys).withColumn("p95", F.coalesce("p95", F.lit(0.0)))


def area_statistics(cells: DataFrame, window: tuple[int, int, int, int], value: str = "rate") -> DataFrame:
    """Figures of the cells in a window of rows and columns, both ends in; the
    filter reaches the scan."""
    y0, x0, y1, x1 = window
    c = cells.filter(F.col("y").between(y0, y1) & F.col("x").between(x0, x1))
    return c.agg(F.count(value).alias("valid_cells"), (F.count("*") - F.count(value)).alias("missing_cells"), F.avg(value).alias("mean"), F.max(value).alias("maximum"))


def accumulated(rates: DataFrame, keys: list[str], start: int, end: int, step: int = 6) -> DataFrame:
    """Millimetres over (start, end] minutes from rates at the steps' ends;
    null where a step is missing, so support is complete or none."""
    if start % step or end % step or not start < end:
        raise ValueError("an interval is a positive number of whole steps")
    n = (end - start) // step
    inside = rates.filter((F.col("lead_min") > start) & (F.col("lead_min") <= end))
    good = F.when(F.col("rate") >= 0, F.col("rate"))
    return inside.groupBy(*keys).agg(F.when((F.count(good) == n) & (F.count("*") == n), F.sum(good) * F.lit(step / 60.0)).alias("amount"))


def member_first(rates: DataFrame, cell: list[str], member: str, start: int, end: int, quantile: float | None, members: int) -> DataFrame:
    """A statistic over members of their own amounts (never an amount of the
    statistic); null unless every member has complete support."""
    own = accumulated(rates, [*cell, member], start, end)
    value = F.avg("amount") if quantile is None else F.percentile("amount", F.lit(quantile))
    return own.groupBy(*cell).agg(F.when(F.count("amount") == members, value).alias("amount"))


def ensemble(cells: DataFrame, cell: list[str], thresholds: list[float], least_members: int) -> DataFrame:
    """Mean, quantiles and exceedance shares over the valid members of a cell;
    null where fewer than ``least_members`` are valid."""
    v = F.when(F.col("valid"), F.col("rate"))
    enough = F.count(v) >= least_members
    out = [F.count(v).alias("members"), F.when(enough, F.avg(v)).alias("mean")]
    quantiles = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out.append(F.when(enough, F.percentile(v, F.array(*map(F.lit, quantiles.values())))).alias("_q"))  # one list of values for all
    shares = {f"over_{t:g}".replace(".", "_"): F.when(enough, F.count_if(v > t) / F.count(v)) for t in thresholds}
    out += [c.alias(name) for name, c in shares.items()]
    return cells.groupBy(*cell).agg(*out).select(*cell, "members", "mean", *[F.get("_q", k).alias(name) for k, name in enumerate(quantiles)], *shares)


def input_gates(frames: DataFrame, keys: list[str], p: NowcastInput = NowcastInput()) -> DataFrame:
    """Codes of the gates that a set of frames fails: coverage, mean_quality,
    age_min and operational of each frame."""
    g = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.min("coverage").alias("coverage"), F.min("mean_quality").alias("quality"), F.max("age_min").alias("age"), F.min(F.col("operational").cast("int")).alias("operational"))
    failed = F.array_compact(F.array(
        F.when(F.col("frames") < p.least_frames, "TOO_FEW_FRAMES"), F.when(F.col("coverage") < p.coverage, "COVERAGE"), F.when(F.col("quality") < p.mean_quality, "QUALITY"), F.when(F.col("age") > p.age_min, "AGE"), F.when(F.col("operational") == 0, "NOT_OPERATIONAL"),
    ))
    return g.select(*keys, "frames", failed.alias("failed"), (F.size(failed) == 0).alias("eligible"))


def blended_tiles(tiles: DataFrame, cell: list[str], value: str, weight: str) -> DataFrame:
    """Convex combination of overlapping tiles."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return tiles.groupBy(*cell).agg(ratio(F.sum(F.col(value) * w), F.sum(w)).alias(value), F.count(w).alias("tiles"))


def clutter_probability(samples: DataFrame, gate: list[str], hit: str, day: str, least_days: int, least_samples: int) -> DataFrame:
    """(hits + 1) / (samples + 2) of gates seen on enough days, else null."""
    n, k = F.count(hit), F.count_if(F.col(hit))
    return samples.groupBy(*gate).agg(n.alias("samples"), F.countDistinct(day).alias("days"), k.alias("hits")).withColumn("probability", F.when((F.col("days") >= least_days) & (F.col("samples") >= least_samples), (F.col("hits") + 1) / (F.col("samples") + 2)))


def recurrence(volumes: DataFrame, cell: list[str], volume: str, hit: str) -> DataFrame:
    """In how many volumes a cell was hit at least once."""
    each = volumes.groupBy(*cell, volume).agg(F.max(hit).alias("_h"))
    return each.groupBy(*cell).agg(F.count("*").alias("volumes"), F.count_if("_h").alias("hits"))


def displayed(df: DataFrame, flags: str, hidden: tuple[str, ...]) -> DataFrame:
    """Adds ``shown``: eligible values without a flag that hides them."""
    return df.withColumn("shown", F.col("eligible") & F.col("dbzh").isNotNull() & ~has_any(F.col(flags), flag(*hidden)))
