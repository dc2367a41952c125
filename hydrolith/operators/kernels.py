"""Kernels on one small grid or ray each: labels, motion, forecasts, sampling.

A group is one sweep, one ray or one grid, whose size the radar or the grid
sets, never the archive; the archive is dealt over groups. Each takes pandas
frames of a group and returns long rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.sources.shared import stored


def _schema(df: DataFrame, keys: list[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"`{k}` {types[k]}" for k in keys], rest])


def _keyed(d: pd.DataFrame, keys: list[str], out: pd.DataFrame) -> pd.DataFrame:
    for i, k in enumerate(keys):
        out.insert(i, k, d[k].iloc[0])
    return out


def run_labels(ray: np.ndarray, first: np.ndarray, last: np.ndarray, rays: int, overlap: int = 1) -> np.ndarray:
    """Component of each run (sorted by ray, first): the least run that it is
    linked with. Runs are linked if they share ``overlap`` gates on neighbouring
    rays."""
    span = int(last.max()) + 2
    starts, ends = ray * span + first, ray * span + last
    # The runs of the next ray that end at my first gate or later and begin at my last or before.
    base = (ray + 1) % rays * span
    lo, hi = np.searchsorted(ends, base + first), np.searchsorted(starts, base + last, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(ray)), n)
    b = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if overlap > 1:
        enough = np.minimum(last[a], last[b]) - np.maximum(first[a], first[b]) + 1 >= overlap
        a, b = a[enough], b[enough]
    label = np.arange(len(ray))
    while True:
        # Roots take the least root that they touch, then every run jumps to its root.
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def polar_labels(gates: DataFrame, keys: list[str], rays: int) -> DataFrame:
    """Adds ``label`` and ``size`` to the gates (ray, gate) of each sweep:
    4-connected objects, ray 0 beside the last. Labels are by first member.

    Windows along rays turn gates into runs; a sweep's runs, some hundredths of
    its gates, are linked by array steps."""
    w = Window.partitionBy(*keys, "ray").orderBy("gate")
    own = gates.select(*keys, F.col("ray").cast("long").alias("ray"), F.col("gate").cast("long").alias("gate")).distinct()
    run = own.withColumn("_r", F.col("gate") - F.row_number().over(w)).groupBy(*keys, "ray", "_r").agg(F.min("gate").alias("first"), F.max("gate").alias("last"))

    def label(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["ray", "first"])
        root = run_labels(d["ray"].to_numpy(), d["first"].to_numpy(), d["last"].to_numpy(), rays)
        _, at = np.unique(root, return_inverse=True)
        size = np.bincount(at, d["last"] - d["first"] + 1).astype(np.int64)
        return _keyed(d, keys, pd.DataFrame({"ray": d["ray"].to_numpy(), "first": d["first"].to_numpy(), "last": d["last"].to_numpy(), "label": at + 1, "size": size[at]}))

    labelled = run.drop("_r").groupBy(*keys).applyInPandas(label, _schema(gates, keys, "ray long, first long, last long, label long, size long"))
    return labelled.select(*keys, "ray", F.explode(F.sequence("first", "last")).alias("gate"), "label", "size")


def _grids(d: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    h, w = int(d["y"].max()) + 1, int(d["x"].max()) + 1
    a, b = np.full((h, w), np.nan), np.full((h, w), np.nan)
    a[d["y"], d["x"]], b[d["y"], d["x"]] = d["previous"], d["current"]
    return a, b


def shift_of(previous: np.ndarray, current: np.ndarray, least_signal: float = 1e-9) -> tuple[int, int, float]:
    """Whole-cell translation from one grid to the next by the peak of the
    normalised cross-power spectrum; (0, 0, 0) where there is no signal."""
    both = np.isfinite(previous) & np.isfinite(current)
    if both.sum() < 16:
        return 0, 0, 0.0
    a, b = np.where(both, previous, 0.0), np.where(both, current, 0.0)
    a, b = a - a.mean(), b - b.mean()
    if a.std() < least_signal or b.std() < least_signal:
        return 0, 0, 0.0
    cross = np.fft.rfft2(b) * np.conj(np.fft.rfft2(a))
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=a.shape)
    y, x = np.unravel_index(int(peak.argmax()), peak.shape)
    h, w = a.shape
    return int(y - h if y > h // 2 else y), int(x - w if x > w // 2 else x), float(peak.max())


def translation(grids: DataFrame, keys: list[str]) -> DataFrame:
    """dy, dx and peak of each pair of grids (y, x, previous, current)."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        return _keyed(d, keys, pd.DataFrame([shift_of(*_grids(d))], columns=["dy", "dx", "peak"]))

    return grids.groupBy(*keys).applyInPandas(run, _schema(grids, keys, "dy int, dx int, peak double"))


def motion(previous: np.ndarray, current: np.ndarray, window: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Dense motion (dy, dx) by least squares of gradients in a window, on top
    of the grids' common translation, at most 2 cells a step from it; that alone
    where gradients are flat. A simplified Lucas-Kanade: no pyramid."""
    dy, dx, _ = shift_of(previous, current)
    a = np.roll(np.nan_to_num(previous), (dy, dx), (0, 1))
    b = np.nan_to_num(current)
    gy, gx = np.gradient((a + b) / 2)
    gt = b - a

    def box(v: np.ndarray) -> np.ndarray:
        half = window // 2
        c = np.pad(np.cumsum(np.cumsum(np.pad(v, half), 0), 1), ((1, 0), (1, 0)))
        return c[window:, window:] - c[:-window, window:] - c[window:, :-window] + c[:-window, :-window]

    yy, xx, xy, yt, xt = (box(v) for v in (gy * gy, gx * gx, gy * gx, gy * gt, gx * gt))
    det = yy * xx - xy * xy
    good = det > 1e-3 * np.maximum((yy + xx) ** 2, 1e-12)
    safe = np.where(good, det, 1.0)
    v = np.where(good, -(xx * yt - xy * xt) / safe, 0.0)
    u = np.where(good, -(yy * xt - xy * yt) / safe, 0.0)
    return dy + np.clip(v, -2, 2), dx + np.clip(u, -2, 2)


def carried(field: np.ndarray, v: np.ndarray, u: np.ndarray, steps: int) -> np.ndarray:
    """Backward semi-Lagrangian advection, bilinear; missing wherever a corner
    of the stencil is missing or off the grid."""
    h, w = field.shape
    y, x = np.mgrid[:h, :w].astype(float)
    for _ in range(steps):
        iy, ix = np.clip(np.rint(y), 0, h - 1).astype(int), np.clip(np.rint(x), 0, w - 1).astype(int)
        y, x = y - v[iy, ix], x - u[iy, ix]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    inside = (y0 >= 0) & (x0 >= 0) & (y <= h - 1) & (x <= w - 1)
    y0, x0 = np.clip(y0, 0, h - 1), np.clip(x0, 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
    out = np.zeros_like(field)
    for yy, xx, weight in ((y0, x0, (1 - fy) * (1 - fx)), (y1, x0, fy * (1 - fx)), (y0, x1, (1 - fy) * fx), (y1, x1, fy * fx)):
        out += np.where(weight > 0, field[yy, xx] * weight, 0.0)
    return np.where(inside, out, np.nan)


def _long(fields: list[tuple[dict, np.ndarray]]) -> pd.DataFrame:
    parts = []
    for names, a in fields:
        y, x = np.mgrid[: a.shape[0], : a.shape[1]]
        parts.append(pd.DataFrame({**{k: np.full(a.size, v) for k, v in names.items()}, "y": y.ravel(), "x": x.ravel(), "rate": a.ravel()}))
    out = pd.concat(parts, ignore_index=True)
    return out.assign(rate=out["rate"].astype("Float64"))


def advected(grids: DataFrame, keys: list[str], leads_min: list[int], step_min: int = 6) -> DataFrame:
    """Forecast of each grid by its motion: lead_min, y, x, rate."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        a, b = _grids(d)
        v, u = motion(a, b)
        return _keyed(d, keys, _long([({"lead_min": m}, carried(b, v, u, m // step_min)) for m in leads_min]))

    return grids.groupBy(*keys).applyInPandas(run, _schema(grids, keys, "lead_min int, y long, x long, rate double"))


def perturbed(grids: DataFrame, keys: list[str], leads_min: list[int], members: int, step_min: int = 6, seed: int = 11) -> DataFrame:
    """Ensemble forecast: each member carries the grid by perturbed motion and
    adds noise with the grid's own spectrum, which grows with the lead. It is not
    STEPS: no cascade, no autoregressive steps, no matching."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        a, b = _grids(d)
        v, u = motion(a, b)
        level = np.nan_to_num(b)
        amplitude = np.abs(np.fft.rfft2(level - level.mean()))
        out = []
        for m in range(members):
            r = np.random.default_rng([seed, m])
            dv, du = r.normal(0.0, 0.3, 2)
            noise = np.fft.irfft2(amplitude * np.exp(2j * np.pi * r.random(amplitude.shape)), s=b.shape)
            for lead in leads_min:
                field = carried(b, v + dv, u + du, lead // step_min)
                out.append(({"member": m, "lead_min": lead}, np.maximum(field + noise * np.sqrt(lead / 120.0), 0.0)))
        return _keyed(d, keys, _long(out))

    return grids.groupBy(*keys).applyInPandas(run, _schema(grids, keys, "member int, lead_min int, y long, x long, rate double"))


#: Rays that are decided at once.
RAYS = 512


def likeliest(hit: np.ndarray, miss: np.ndarray, size: np.ndarray, stay: float) -> np.ndarray:
    """Likeliest two-state sequences of many rays at once: ``hit`` and ``miss``
    (rays, gates) are log probabilities of the evidence in state 1 and 0, with
    ``size`` gates of each ray. A step over gates, all rays together."""
    rays, gates = hit.shape
    same, change = np.log(stay), np.log(1 - stay)
    kept = np.zeros((2, rays, gates), bool)
    off, on = np.zeros(rays), np.zeros(rays)
    for i in range(gates):
        live = i < size
        kept[0, :, i], kept[1, :, i] = off + same >= on + change, on + same >= off + change
        next_off = np.maximum(off + same, on + change) + miss[:, i]
        next_on = np.maximum(on + same, off + change) + hit[:, i]
        off, on = np.where(live, next_off, off), np.where(live, next_on, on)
    out = np.zeros((rays, gates), np.int32)
    state = (on > off).astype(np.int32)
    for i in range(gates - 1, -1, -1):
        live = i < size
        out[:, i] = state
        state = np.where(live & ~kept[state, np.arange(rays), i], 1 - state, state)
    return out


def ray_states(gates: DataFrame, keys: list[str], order: str, evidence: str, stay: float = 0.9) -> DataFrame:
    """Likeliest sequence of two states along each ray, from the probability of
    state 1 at each gate (null: no evidence). A ray is one row of arrays in order;
    a batch of rays is decided at once, in time linear in its gates."""
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.coalesce(evidence, F.lit(0.5))))
    row = F.struct(F.col(order).alias("o"), F.log(p).alias("hit"), F.log(F.lit(1.0) - p).alias("miss"))
    a = gates.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("g"))

    @F.pandas_udf("array<int>")
    def decided(hit: pd.Series, miss: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(hit), RAYS):
            some, other = hit.iloc[at : at + RAYS].to_list(), miss.iloc[at : at + RAYS].to_list()
            size = np.array([len(x) for x in some])
            both = np.zeros((2, len(size), size.max()))
            inside = np.arange(size.max()) < size[:, None]
            both[0][inside], both[1][inside] = np.concatenate(some), np.concatenate(other)
            states = likeliest(both[0], both[1], size, stay)
            out += [states[i, :n] for i, n in enumerate(size)]
        return pd.Series(out, dtype=object)

    zipped = F.arrays_zip(F.col("g.o").alias("o"), decided("g.hit", "g.miss").alias("s"))
    return a.select(*keys, F.explode(zipped).alias("z")).select(*keys, F.col("z.o").alias(order), F.col("z.s").alias("state"))


#: Rounds from one stored state to the next.
STORE_EVERY = 4


def separated(rows: DataFrame, keys: list[str], time_s: str, score: str, region: str, tie: str, gap_s: int, most: int) -> DataFrame:
    """For each key at most ``most`` rows, best score first, no two of one
    region or within ``gap_s`` of each other.

    A round takes the best row of each key that none of the key's picks forbids,
    by an aggregate over all rows; a key's picks are one row of ``most`` at most,
    stored after every few rounds, so that no plan holds them all.
    Rows without a time are left out, rows without a score come last."""
    cols = [region, time_s, score, tie]
    own = rows.filter(F.col(time_s).isNotNull()).select(*keys, F.struct(*cols).alias("_r"))
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    order = F.struct(F.nanvl(F.col(f"_r.{score}").cast("double"), F.lit(None).cast("double")), -F.col(f"_r.{tie}"))
    near = lambda x: x[region].eqNullSafe(F.col(f"_r.{region}")) | (F.abs(x[time_s] - F.col(f"_r.{time_s}")) < F.lit(gap_s))
    taken = own.groupBy(*keys).agg(F.max_by("_r", order).alias("_n")).select(*keys, F.array("_n").alias("_p"))
    for turn in range(1, most):
        if turn % STORE_EVERY == 0:
            taken = stored(taken)
        joined = own.join(taken.select(*named, "_p"), same)
        best = joined.groupBy(*keys).agg(F.first("_p").alias("_p"), F.max_by("_r", F.when(~F.exists("_p", near), order)).alias("_n"))
        taken = best.select(*keys, F.when(F.col("_n").isNull(), F.col("_p")).otherwise(F.concat("_p", F.array("_n"))).alias("_p"))
    ranked = taken.select(*keys, F.posexplode("_p").alias("_i", "_r"))
    return ranked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols], (F.col("_i") + 1).alias("rank"))


def crops(grids: DataFrame, keys: list[str], size: int, count: int, seed: int = 5) -> DataFrame:
    """Corners of ``count`` crops of each grid, drawn by score without putting
    back, no two within half a crop of each other. A draw is the order of
    log(u) / score with u from a hash, so it is the same wherever it runs."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys, "y", "x"), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    drawn = grids.withColumn("_o", F.log(u) / F.greatest(F.col("score"), F.lit(1e-6)))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        for y, x in d.sort_values(["_o", "y", "x"], ascending=[False, True, True])[["y", "x"]].itertuples(index=False):
            if all(abs(y - a) >= size // 2 or abs(x - b) >= size // 2 for a, b in taken):
                taken.append((y, x))
                if len(taken) == count:
                    break
        return _keyed(d, keys, pd.DataFrame({"crop": np.arange(len(taken)), "y": [t[0] for t in taken], "x": [t[1] for t in taken]}))

    return drawn.groupBy(*keys).applyInPandas(run, _schema(grids, keys, "crop int, y long, x long"))
