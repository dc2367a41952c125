"""Joins to the nearest or the last row before a time, and sequences of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.profiles import Waterline


def closest(scans: DataFrame, key: str, time_s: str, tie: str, step_s: int, most_s: int) -> DataFrame:
    """For each key and multiple of ``step_s`` the scan closest to it, at most
    ``most_s`` away; of equally close ones the earlier, then the lower ``tie``.

    A scan can only be closest to its own rounded time, so this is one
    aggregation, no range join."""
    slot = (F.floor((F.col(time_s) + F.lit(step_s // 2)) / F.lit(step_s)) * F.lit(step_s)).cast("long")
    s = scans.withColumn("slot_s", slot).withColumn("_d", F.abs(F.col(time_s) - F.col("slot_s"))).filter(F.col("_d") <= most_s)
    best = s.groupBy(key, "slot_s").agg(F.min_by(F.struct(tie, time_s), F.struct("_d", time_s, tie)).alias("_r"), F.count("*").alias("candidates"))
    return best.select(key, "slot_s", "_r.*", "candidates")


def last_before(instants: DataFrame, scans: DataFrame, keys: list[str], at_s: str, end_s: str, tie: str, most_age_s: int, arrived_s: str | None = None, cutoff_s: int | None = None) -> DataFrame:
    """For each instant and key the scan that ended last at or before it, not
    older than ``most_age_s``; of equal ends the lower ``tie``. With a cutoff
    only scans that had arrived by then count.

    Both sides are bucketed by the age limit, so a scan meets the instants of
    two buckets only and the join is an equality."""
    if arrived_s and cutoff_s is not None:
        scans = scans.filter(F.col(arrived_s) <= cutoff_s)
    bucket = lambda c: F.floor(F.col(c) / F.lit(most_age_s)).cast("long")
    left = instants.withColumn("_b", bucket(at_s))
    right = scans.select(*keys, F.col(end_s).alias("_e"), F.col(tie).alias("_t"), F.explode(F.array(bucket(end_s), bucket(end_s) + 1)).alias("_b"))
    pairs = left.join(right, [*keys, "_b"]).filter((F.col("_e") <= F.col(at_s)) & (F.col(at_s) - F.col("_e") <= most_age_s))
    best = pairs.groupBy(*keys, at_s).agg(F.min_by(F.struct(F.col("_t").alias(tie), F.col("_e").alias(end_s)), F.struct(-F.col("_e"), "_t")).alias("_r"))
    return best.select(*keys, at_s, "_r.*")


def nearest_others(t: np.ndarray, name: np.ndarray, site: np.ndarray, own: np.ndarray, window_s: int, most: int, same_site: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other) of rows sorted by time and name: for each of the rows
    ``own`` the first ``most`` of its site, or of others, from its own time on, and
    as many of those before it, the latest first; of one time the lower names first.
    All rows step outward together, and a row stops where it has enough or leaves the
    window."""
    first, after = np.searchsorted(t, t, "left"), np.searchsorted(t, t, "right")
    turned = first + after - 1 - np.arange(len(t))  # each time's rows the other way round
    pairs = []
    for side in (1, -1):
        at = np.flatnonzero(own)
        place = first[at] if side > 0 else first[at] - 1
        found = np.zeros(len(at), np.int64)
        while len(at):
            inside = (place >= 0) & (place < len(t)) & (found < most)
            at, place, found = at[inside], place[inside], found[inside]
            other = place if side > 0 else turned[place]
            near = np.abs(t[other] - t[at]) <= window_s
            at, place, found, other = at[near], place[near], found[near], other[near]
            hit = ((site[other] == site[at]) == same_site) & (name[other] != name[at])
            pairs.append((at[hit], other[hit]))
            place, found = place + side, found + hit
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2


#: Rows that a group of ``context`` has, about.
SPAN_ROWS = 50_000


def context(scans: DataFrame, site: str, time_s: str, tie: str, window_s: int, most: int, same_site: bool, span_rows: int = SPAN_ROWS) -> DataFrame:
    """Other scans within a window of each scan, of the same site or of others,
    ranked by distance in time, then earlier time, then id; ``most`` of each.

    Scans are dealt by spans of time of about ``span_rows`` rows (a job counts them),
    those near a border to the span beyond it, too, and each walks to its nearest: a
    scan gives 2 * ``most`` rows at most before the cut. A group holds the scans of
    one window at least. Scans without a time or an id have no context and are none;
    one without a site is of another site than all others."""
    s = scans.select(F.col(tie).alias("id"), F.col(site).alias("site"), F.col(time_s).cast("long").alias("at")).filter("id IS NOT NULL AND at IS NOT NULL")
    if same_site:
        s = s.filter("site IS NOT NULL")
    n, low, high = s.agg(F.count("*"), F.min("at"), F.max("at")).first()
    span = max(1, window_s, -(-((high or 0) - (low or 0) + 1) * span_rows // max(1, n)))
    number = lambda c: F.floor(c / F.lit(span)).cast("long")
    at = F.col("at")
    dealt = s.withColumn("_own", number(at)).withColumn("_b", F.explode(F.array_distinct(F.array(number(at - window_s), number(at), number(at + window_s)))))
    types = dict(s.dtypes)

    def near(d: pd.DataFrame) -> pd.DataFrame:
        code = np.where(d["site"].isna(), -1 - np.arange(len(d)), pd.factorize(d["site"])[0])
        apart = 2 * (int(d["at"].max()) - int(d["at"].min()) + window_s + 1)
        d = d.assign(_code=code, _t=d["at"] - d["at"].min() + (code * apart if same_site else 0)).sort_values(["_t", "id"])
        i, j = nearest_others(d["_t"].to_numpy(), pd.factorize(d["id"])[0], d["_code"].to_numpy(), (d["_own"] == d["_b"]).to_numpy(), window_s, most, same_site)
        other = d.iloc[j].reset_index(drop=True)
        return d.iloc[i][["id", "site", "at"]].reset_index(drop=True).assign(other_id=other["id"], other_site=other["site"], other_at=other["at"])

    pairs = dealt.groupBy("_b").applyInPandas(near, f"id {types['id']}, site {types['site']}, at long, other_id {types['id']}, other_site {types['site']}, other_at long")
    w = Window.partitionBy("id", "at", "site").orderBy(F.abs(F.col("at") - F.col("other_at")), "other_at", "other_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def ready_sequences(frames: DataFrame, key: str, time_s: str, step_s: int, least: int, most: int) -> DataFrame:
    """For each frame: how many frames exactly one step apart end at it (at
    most ``most``), where there are ``least``."""
    w = Window.partitionBy(key).orderBy(time_s)
    broken = F.when(F.col(time_s) - F.lag(time_s).over(w) == step_s, 0).otherwise(1)
    run = frames.select(key, time_s).distinct().withColumn("_n", broken).withColumn("_i", F.sum("_n").over(w))
    length = F.row_number().over(Window.partitionBy(key, "_i").orderBy(time_s))
    return run.withColumn("frames", F.least(length, F.lit(most))).filter(F.col("frames") >= least).select(key, time_s, "frames")


def waterline(contributors: Column, age_s: Column, p: Waterline = Waterline()) -> Column:
    """struct(ready, complete, reason): whether a cycle may be composed from
    what has arrived. A complete one waits for the earliest delay only."""
    none = (contributors < 1) | F.lit(p.expected < 1)
    complete = ~none & (contributors >= p.expected)
    waiting = F.lit("waiting_all_radars") if p.require_all else F.when(age_s < p.most_s, "waiting_maximum_watermark").otherwise("maximum_wait_elapsed")
    reason = F.when(none, "no_contributors").when(complete & (age_s < p.earliest_s), "waiting_earliest_delay").when(complete, "all_radars_arrived").otherwise(waiting)
    return F.struct(reason.isin("all_radars_arrived", "maximum_wait_elapsed").alias("ready"), complete.alias("complete"), reason.alias("reason"))
