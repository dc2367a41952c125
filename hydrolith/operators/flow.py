"""Motion of rain by features followed through a pyramid, and frames between frames.

A group is one pair of grids, whose size the radar sets; the archive is dealt over
groups. Grids are arrays with NaN where nothing is known.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.operators.kernels import _keyed, _long, _schema


@dataclass(frozen=True)
class Flow:
    """Sizes are cells of the grid; ``quality`` is a share of the best corner."""

    levels: int = 4
    least_size: int = 12
    window: int = 9
    rounds: int = 12
    corners: int = 400
    spacing: int = 4
    quality: float = 0.02
    agree: float = 1.0
    outlier: float = 4.0
    near: int = 16
    reach: float = 24.0


def box(v: np.ndarray, size: int) -> np.ndarray:
    """Sums over size by size cells around each, cells beyond the border being 0."""
    half = size // 2
    c = np.pad(np.cumsum(np.cumsum(np.pad(v, half), 0), 1), ((1, 0), (1, 0)))
    return c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]


def sampled(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places, those beyond the border at the border."""
    h, w = a.shape
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), h - 2), np.minimum(x.astype(int), w - 2)
    fy, fx = y - y0, x - x0
    return (a[y0, x0] * (1 - fx) + a[y0, x0 + 1] * fx) * (1 - fy) + (a[y0 + 1, x0] * (1 - fx) + a[y0 + 1, x0 + 1] * fx) * fy


def halved(a: np.ndarray) -> np.ndarray:
    """The grid at half its resolution, smoothed before."""
    k = np.array([1, 4, 6, 4, 1]) / 16
    for axis in (0, 1):
        p = np.pad(a, [(2, 2) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = sum(w * np.take(p, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a[::2, ::2]


def corners(a: np.ndarray, known: np.ndarray, p: Flow) -> tuple[np.ndarray, np.ndarray]:
    """Places whose window changes in both directions (the smaller eigenvalue of its
    gradients' products), the best of each square of ``p.spacing``, best first; only
    where the whole window is known."""
    gy, gx = np.gradient(a)
    yy, xx, xy = box(gy * gy, p.window), box(gx * gx, p.window), box(gy * gx, p.window)
    score = (yy + xx) / 2 - np.sqrt(((yy - xx) / 2) ** 2 + xy**2)
    score[box(known.astype(float), p.window) < p.window**2 - 0.5] = 0
    if score.max(initial=0) <= 0:
        return np.zeros(0), np.zeros(0)
    h, w = (-(-n // p.spacing) for n in a.shape)
    tiles = np.pad(score, ((0, h * p.spacing - a.shape[0]), (0, w * p.spacing - a.shape[1]))).reshape(h, p.spacing, w, p.spacing).transpose(0, 2, 1, 3).reshape(h, w, -1)
    k, best = tiles.argmax(2), tiles.max(2)
    y = np.arange(h)[:, None] * p.spacing + k // p.spacing
    x = np.arange(w)[None, :] * p.spacing + k % p.spacing
    good = np.flatnonzero(best.ravel() >= p.quality * score.max())
    good = good[np.argsort(-best.ravel()[good], kind="stable")][: p.corners]
    return y.ravel()[good].astype(float), x.ravel()[good].astype(float)


def followed(a: np.ndarray, b: np.ndarray, y: np.ndarray, x: np.ndarray, p: Flow) -> np.ndarray:
    """How far (dy, dx) the windows of ``a`` at places have moved in ``b``: Lucas and
    Kanade's steps, from the coarsest level of a pyramid to the finest, all places
    together. NaN where a window's gradients do not tell."""
    levels = [(a, b)]
    while len(levels) < p.levels and min(levels[-1][0].shape) >= 2 * p.least_size:
        levels.append((halved(levels[-1][0]), halved(levels[-1][1])))
    half = p.window // 2
    oy, ox = (o.ravel() for o in np.mgrid[-half : half + 1, -half : half + 1])
    moved, sure = np.zeros((len(y), 2)), np.ones(len(y), bool)
    for n in range(len(levels) - 1, -1, -1):
        first, second = levels[n]
        gy, gx = np.gradient(first)
        py, px = (y / 2**n)[:, None] + oy, (x / 2**n)[:, None] + ox
        own, wy, wx = sampled(first, py, px), sampled(gy, py, px), sampled(gx, py, px)
        yy, xx, xy = (wy * wy).sum(1), (wx * wx).sum(1), (wy * wx).sum(1)
        det = yy * xx - xy * xy
        good = det > 1e-6 * np.maximum((yy + xx) ** 2, 1e-12)
        det = np.where(good, det, 1.0)
        moved = moved * 2 if n < len(levels) - 1 else moved
        for _ in range(p.rounds):
            off = own - sampled(second, py + moved[:, :1], px + moved[:, 1:])
            ty, tx = (off * wy).sum(1), (off * wx).sum(1)
            step = np.stack([(xx * ty - xy * tx) / det, (yy * tx - xy * ty) / det], axis=1)
            step = np.where(good[:, None], np.clip(step, -2, 2), 0)
            moved = moved + step
            if np.abs(step).max(initial=0) < 0.01:
                break
        if n == 0:
            sure &= good
    return np.where(sure[:, None], moved, np.nan)


def plane_fit(y: np.ndarray, x: np.ndarray, v: np.ndarray, ty: np.ndarray, tx: np.ndarray, near: int) -> np.ndarray:
    """Values at targets by planes through the ``near`` closest places, the closer the
    heavier: a field that is linear comes out as it is."""
    d = (ty[:, None] - y) ** 2 + (tx[:, None] - x) ** 2
    k = min(near, len(y))
    idx = np.argpartition(d, k - 1, axis=1)[:, :k]
    dk = np.take_along_axis(d, idx, 1)
    w = 1.0 / (dk + 1.0 + 0.05 * dk.max(1, keepdims=True))
    a = np.stack([np.ones_like(dk), y[idx] - ty[:, None], x[idx] - tx[:, None]], axis=2)
    m = np.einsum("nki,nk,nkj->nij", a, w, a) + np.diag([0.0, 1e-3, 1e-3]) * w.sum(1)[:, None, None]
    return np.linalg.solve(m, np.einsum("nki,nk,nkc->nic", a, w, v[idx]))[:, 0]


def kept(y: np.ndarray, x: np.ndarray, moved: np.ndarray, p: Flow) -> np.ndarray:
    """Which places move as those around them do: not further from their neighbours'
    median than ``p.outlier`` times its own spread (half a cell at least)."""
    if len(y) < 4:
        return np.ones(len(y), bool)
    d = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    idx = np.argsort(d, axis=1, kind="stable")[:, 1 : min(9, len(y))]
    mid = np.median(moved[idx], axis=1)
    spread = np.median(np.abs(moved[idx] - mid[:, None]), axis=1)
    return (np.abs(moved - mid) <= p.outlier * np.maximum(spread, 0.5)).all(1)


def dense_motion(previous: np.ndarray, current: np.ndarray, p: Flow = Flow()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Motion (dy, dx) of every cell from one grid to the next, and where it is
    supported: within ``p.reach`` of a feature. Features are followed there and back and
    have to return, and to move as their neighbours do. Without any: no motion, no
    support. Grids smaller than 3 by 3 have none."""
    h, w = previous.shape
    none = np.zeros((h, w)), np.zeros((h, w)), np.zeros((h, w), bool)
    if min(h, w) < 3:
        return none
    known = np.isfinite(previous) & np.isfinite(current)
    a, b = np.where(known, previous, 0.0), np.where(known, current, 0.0)
    y, x = corners(a, known, p)
    if not len(y):
        return none
    moved = followed(a, b, y, x, p)
    back = followed(b, a, y + moved[:, 0], x + moved[:, 1], p) if np.isfinite(moved).all() else followed(b, a, np.nan_to_num(y + moved[:, 0]), np.nan_to_num(x + moved[:, 1]), p)
    ey, ex = y + moved[:, 0], x + moved[:, 1]
    good = np.isfinite(moved).all(1) & (np.hypot(*(moved + back).T) <= p.agree) & (ey >= 0) & (ey <= h - 1) & (ex >= 0) & (ex <= w - 1)
    y, x, moved = y[good], x[good], moved[good]
    good = kept(y, x, moved, p)
    y, x, moved = y[good], x[good], moved[good]
    if not len(y):
        return none
    ty, tx = (g.ravel().astype(float) for g in np.mgrid[:h, :w])
    field = plane_fit(y, x, moved, ty, tx, p.near)
    low, high = moved.min(0) - 1, moved.max(0) + 1  # planes do not run away from what was seen
    field = np.clip(field, low, high)
    near = ((ty[:, None] - y) ** 2 + (tx[:, None] - x) ** 2).min(1) <= p.reach**2
    return field[:, 0].reshape(h, w), field[:, 1].reshape(h, w), near.reshape(h, w)


def warped(field: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The field's values at each cell less its motion; NaN where a corner of the
    bilinear stencil with a weight is missing or off the grid."""
    h, w = field.shape
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - dy, x - dx
    inside = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
    y0, x0 = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = np.clip(y - y0, 0, 1), np.clip(x - x0, 0, 1)
    out = np.zeros((h, w))
    for yy, xx, k in ((y0, x0, (1 - fy) * (1 - fx)), (y1, x0, fy * (1 - fx)), (y0, x1, (1 - fy) * fx), (y1, x1, fy * fx)):
        out += np.where(k > 0, field[yy, xx] * k, 0.0)
    return np.where(inside, out, np.nan)


def between(left: np.ndarray, right: np.ndarray, forward: tuple[np.ndarray, np.ndarray], backward: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """The field at a share of the way from left to right: each carried to there by its
    own motion and blended by nearness in log(1 + rate); known where both are."""
    a = warped(left, forward[0] * share, forward[1] * share)
    b = warped(right, backward[0] * (1 - share), backward[1] * (1 - share))
    return np.expm1(np.log1p(a) * (1 - share) + np.log1p(b) * share)


def _grid(d: pd.DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.full(shape, np.nan)
    out[d["y"], d["x"]] = d["rate"].astype(float)
    return out


def motion_fields(grids: DataFrame, keys: list[str], p: Flow = Flow()) -> DataFrame:
    """y, x, dy, dx and supported of each pair of grids (y, x, previous, current). Cells
    without a row, and nulls, are unknown; a key's grid reaches to its largest y and x."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        shape = int(d["y"].max()) + 1, int(d["x"].max()) + 1
        a, b = (_grid(d.assign(rate=d[c]), shape) for c in ("previous", "current"))
        v, u, s = dense_motion(a, b, p)
        y, x = np.mgrid[: shape[0], : shape[1]]
        return _keyed(d, keys, pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "dy": v.ravel(), "dx": u.ravel(), "supported": s.ravel()}))

    own = grids.dropna(subset=["y", "x"])
    return own.groupBy(*keys).applyInPandas(run, _schema(grids, keys, "y long, x long, dy double, dx double, supported boolean"))


def resampled(frames: DataFrame, keys: list[str], step_min: int = 10, out_min: int = 6, p: Flow = Flow()) -> DataFrame:
    """Frames (member, lead_min, y, x, rate) at multiples of ``step_min`` as frames at
    multiples of ``out_min`` up to the last: member, lead_min, y, x, rate.

    A lead that is there is taken as it is. Any other lies between two frames: motion is
    estimated both ways on the mean of the members, and each member's two frames are
    carried to the lead and blended. A cell is known where both are; where an interval
    lacks a frame its leads are left out. An interval of one key is one group; each
    frame goes to the two intervals beside it. Rates that are null or negative are
    unknown."""
    lead = F.col("lead_min").cast("int")
    sent = frames.dropna(subset=["member", "lead_min", "y", "x"]).filter(lead % step_min == 0).withColumn("_i", F.explode(F.array((lead / step_min).cast("int"), (lead / step_min + 1).cast("int"))))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        i = int(d["_i"].iloc[0])
        left, right = (i - 1) * step_min, i * step_min
        shape = int(d["y"].max()) + 1, int(d["x"].max()) + 1
        at = {(m, t): _grid(g.assign(rate=g["rate"].where(g["rate"] >= 0)), shape) for (m, t), g in d.groupby(["member", "lead_min"])}
        members = sorted({m for m, _ in at})
        leads = [t for t in range(out_min, right + 1, out_min) if left < t <= right]
        out, motion = [], None
        for t in leads:
            if t == right:
                out += [({"member": m, "lead_min": t}, at[m, t]) for m in members if (m, t) in at]
                continue
            both = [m for m in members if (m, left) in at and (m, right) in at]
            if not both:
                continue
            if motion is None:
                with np.errstate(invalid="ignore"):
                    a, b = (np.log1p(np.mean([at[m, s] for m in both], axis=0)) for s in (left, right))
                motion = dense_motion(a, b, p)[:2], dense_motion(b, a, p)[:2]
            out += [({"member": m, "lead_min": t}, between(at[m, left], at[m, right], *motion, (t - left) / step_min)) for m in both]
        if not out:
            return d[[*keys, "member", "lead_min", "y", "x", "rate"]].iloc[:0]
        return _keyed(d, keys, _long(out).astype({"member": "int64", "lead_min": "int32"}))

    return sent.groupBy(*keys, "_i").applyInPandas(run, _schema(frames, keys, "member long, lead_min int, y long, x long, rate double"))
