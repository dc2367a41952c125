"""Scores by band, by scale and of accumulations; geometry of grids; tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.functions import geodesy
from hydrolith.functions.basic import ratio
from hydrolith.operators.grids import accumulated
from hydrolith.operators.verification import contingency, window_sums


def retention(rows: DataFrame, keys: list[str], weather: Column, kept: Column, valid: Column) -> DataFrame:
    """Share of weather among valid rows that is kept; null where there is none."""
    eligible = F.coalesce(weather & valid, F.lit(False)) & kept.isNotNull()
    return rows.groupBy(*keys).agg(F.count_if(eligible).alias("eligible"), F.count_if(eligible & kept).alias("kept")).withColumn("retention", ratio(F.col("kept"), F.col("eligible")))


def spatial_scores(pairs: DataFrame, keys: list[str], thresholds: list[float], windows: list[int]) -> DataFrame:
    """For each threshold (strictly above) and square window: hits, misses, false
    alarms and CSI of cells; over windows that are valid throughout, FSS clipped to
    0 and 1, and CSI of any event in the window. Cells without both values, or with
    a negative one, are not valid."""
    ok = pairs.filter((F.col("observed") >= 0) & (F.col("forecast") >= 0))
    each = ok.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    event = lambda c: (F.col(c) > F.col("threshold")).cast("double")
    cells = each.select(*keys, "threshold", "y", "x", F.lit(1.0).alias("n"), event("observed").alias("o"), event("forecast").alias("f"))
    both = [*keys, "threshold"]
    points = cells.groupBy(*both).agg(F.sum(F.col("o") * F.col("f")).cast("long").alias("hits"), F.sum(F.col("o") * (1 - F.col("f"))).cast("long").alias("misses"), F.sum((1 - F.col("o")) * F.col("f")).cast("long").alias("false_alarms"))
    out = None
    for size in windows:
        w = window_sums(cells, both, ["n", "o", "f"], size // 2, size // 2).filter(F.col("n") == size * size)
        po, pf = F.col("o") / F.col("n"), F.col("f") / F.col("n")
        s = w.groupBy(*both).agg(
            F.count("*").alias("cells"), F.sum((pf - po) * (pf - po)).alias("_d"), F.sum(pf * pf + po * po).alias("_s"),
            F.count_if((F.col("o") > 0.5) & (F.col("f") > 0.5)).alias("_both"), F.count_if((F.col("o") > 0.5) | (F.col("f") > 0.5)).alias("_any"),
        ).withColumn("window", F.lit(size))
        out = s if out is None else out.union(s)
    fss = F.when(F.col("_s") > 1e-20, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_d") / F.col("_s"))))
    joined = out.join(points, both)
    return joined.select(*both, "window", "cells", "hits", "misses", "false_alarms", ratio(F.col("hits"), F.col("hits") + F.col("misses") + F.col("false_alarms")).alias("csi"), fss.alias("fss"), ratio(F.col("_both"), F.col("_any")).alias("neighbourhood_csi"))


def accumulation_scores(rates: DataFrame, keys: list[str], leads: list[int], thresholds: list[float], step: int = 6) -> DataFrame:
    """Contingency scores of amounts over 0 to each of ``leads`` minutes, of rows
    with lead_min, observed and forecast rates. An amount needs every step."""
    out = None
    for lead in leads:
        of = lambda c, lead=lead: accumulated(rates.select(*keys, "y", "x", "lead_min", F.col(c).alias("rate")), [*keys, "y", "x"], 0, lead, step).withColumnRenamed("amount", c)
        both = of("observed").join(of("forecast"), [*keys, "y", "x"]).withColumn("until_min", F.lit(lead))
        out = both if out is None else out.unionByName(both)
    return contingency(out, [*keys, "until_min"], thresholds)


def band_means(rows: DataFrame, keys: list[str], values: list[str], split_min: int = 60) -> DataFrame:
    """Means for the near band (leads up to the split) and the far one, weighted
    by ``cells``; values that are null or NaN, and rows without cells, are left out."""
    band = F.when(F.col("lead_min") <= split_min, "near").otherwise("far")
    w = F.col("cells").cast("double")
    use = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col("cells") > 0), w)
    return rows.groupBy(*keys, band.alias("band")).agg(*[ratio(F.sum(F.col(c) * use(c)), F.sum(use(c))).alias(c) for c in values], F.sum("cells").alias("cells"))


def skill(candidate: Column, baseline: Column) -> Column:
    """1 less the ratio of two errors; null without a positive baseline."""
    return F.when(baseline > 0, F.lit(1.0) - candidate / baseline)


def grid_metric(latitudes: DataFrame, step_lon_deg: float, step_lat_deg: float, reference_lat_deg: float) -> DataFrame:
    """Adds x_spacing_m at each ``latitude`` and y_spacing_m at the reference
    latitude: lengths of geodesics over one step of the grid."""
    x = geodesy.inverse(F.col("latitude"), F.lit(0.0), F.col("latitude"), F.lit(step_lon_deg))
    half = step_lat_deg / 2
    y = geodesy.inverse(F.lit(reference_lat_deg - half), F.lit(0.0), F.lit(reference_lat_deg + half), F.lit(0.0))
    return latitudes.withColumns({"x_spacing_m": x["distance"], "y_spacing_m": y["distance"]})


#: The ellipsoid WGS84, and the scale and false origin of UTM.
MAJOR, FLATTENING, SCALE, EAST, NORTH = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of web Mercator metres (EPSG:3857)."""
    return F.degrees(x / MAJOR), F.degrees(F.lit(2.0) * F.atan(F.exp(y / MAJOR)) - F.pi() / 2)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MAJOR, F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2)) * MAJOR


def _krueger() -> tuple[float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Radius of the rectifying sphere and the series of the third flattening:
    forward, backward, and from conformal to geodetic latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    backward = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    return radius, forward, backward, latitude


def from_utm(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of UTM metres, to a millimetre."""
    radius, _, backward, latitude = _krueger()
    xi = (northing - (NORTH if south else 0.0)) / (SCALE * radius)
    eta = (easting - EAST) / (SCALE * radius)
    xi1 = xi - sum((F.lit(b) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, b in enumerate(backward, 1)), F.lit(0.0))
    eta1 = eta - sum((F.lit(b) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, b in enumerate(backward, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((F.lit(d) * F.sin(chi * (2 * j)) for j, d in enumerate(latitude, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + (zone * 6 - 183), F.degrees(lat)


def to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    radius, forward, _, _ = _krueger()
    e = (FLATTENING * (2 - FLATTENING)) ** 0.5
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    d = F.radians(lon - (zone * 6 - 183))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) for j, a in enumerate(forward, 1)), F.lit(0.0))
    north = xi + sum((F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) for j, a in enumerate(forward, 1)), F.lit(0.0))
    return east * (SCALE * radius) + EAST, north * (SCALE * radius) + (NORTH if south else 0.0)


def reprojected(current: DataFrame, site: tuple[float, float], neighbour: DataFrame, other: tuple[float, float], rays: int, first_m: float, spacing_m: float, gates: int) -> DataFrame:
    """Adds ``neighbour_dbzh`` to gates (azimuth_deg, range_m): the value of the
    nearest gate of another radar (ray, gate, dbzh) by geodesics, null beyond its
    reach. Sites are (lat, lon). The other's rays are even around the circle, so a
    gate's place is arithmetic and the join is one of equal keys."""
    spot = geodesy.direct(F.lit(site[0]), F.lit(site[1]), F.col("azimuth_deg"), F.col("range_m"))
    c = current.withColumn("_s", spot)
    c = c.withColumn("_i", geodesy.inverse(F.lit(other[0]), F.lit(other[1]), F.col("_s.latitude"), F.col("_s.longitude")))
    gate = F.round((F.col("_i.distance") - first_m) / spacing_m)
    reach = (F.col("_i.distance") >= first_m) & (F.col("_i.distance") <= first_m + spacing_m * (gates - 1))
    c = c.withColumns({"_ray": F.pmod(F.round(F.col("_i.azimuth") * rays / 360.0), F.lit(rays)).cast("int"), "_gate": F.when(reach, gate.cast("int"))})
    n = neighbour.select(F.col("ray").cast("int").alias("_ray"), F.col("gate").cast("int").alias("_gate"), F.col("dbzh").alias("neighbour_dbzh"))
    return c.join(n, ["_ray", "_gate"], "left").drop("_s", "_i", "_ray", "_gate")


def _summed(a: np.ndarray) -> np.ndarray:
    return np.pad(a.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)


def _in_windows(table: np.ndarray, top: np.ndarray, left: np.ndarray, height: int, width: int) -> np.ndarray:
    return table[top + height, left + width] - table[top, left + width] - table[top + height, left] + table[top, left]


def largest_rectangle(on: np.ndarray, size: int, multiple: int) -> tuple[int, int, int, int] | None:
    """top, left, height and width of the largest rectangle of full support whose
    sides are multiples of ``multiple`` and ``size`` or more; of equal areas the one
    with the longer short side, then the wider, then the first by row; None if there
    is none. For each height, the columns that are full over it and how far each
    reaches to the right."""
    best = None
    first = -(-size // multiple) * multiple
    down = np.pad(on.astype(np.int64), ((1, 0), (0, 0))).cumsum(0)
    for height in range(first, on.shape[0] + 1, multiple):
        full = down[height:] - down[:-height] == height
        reach = np.zeros(full.shape, np.int64)
        run = np.zeros(full.shape[0], np.int64)
        for x in range(full.shape[1] - 1, -1, -1):
            run = np.where(full[:, x], run + 1, 0)
            reach[:, x] = run
        width = int(reach.max(initial=0)) // multiple * multiple
        rank = (height * width, min(height, width), width)
        if width >= first and (best is None or rank > best[0]):
            best = rank, tuple(map(int, np.argwhere(reach >= width)[0])), height, width
    return None if best is None else (*best[1], best[2], best[3])


def chosen_tiles(on: np.ndarray, size: int, stride: int, most: int, multiple: int | None) -> list[tuple[int, int, int, int, int]]:
    """Tiles (top, left, height, width, adds) of a grid of support, one by one."""
    h, w = on.shape
    starts = lambda n: np.unique(np.r_[np.arange(0, n - size + 1, stride), max(n - size, 0)]) if n >= size else np.zeros(0, np.int64)
    top, left = (a.ravel() for a in np.meshgrid(starts(h), starts(w), indexing="ij"))
    full = _in_windows(_summed(on), top, left, size, size) == size * size
    top, left = top[full], left[full]
    wanted = np.zeros_like(on)
    for y, x in zip(top, left, strict=True):
        wanted[y : y + size, x : x + size] = True
    out = []
    if multiple and (large := largest_rectangle(on, size, multiple)):
        y, x, height, width = large
        wanted[y : y + height, x : x + width] = False
        out.append((*large, height * width))
    while len(out) < most and len(top):
        gains = _in_windows(_summed(wanted), top, left, size, size)
        k = int(gains.argmax())
        if not gains[k]:
            break
        y, x = int(top[k]), int(left[k])
        wanted[y : y + size, x : x + size] = False
        out.append((y, x, size, size, int(gains[k])))
    return out


def covering_tiles(cells: DataFrame, keys: list[str], size: int, stride: int, most: int, multiple: int | None = None) -> DataFrame:
    """Tiles (top, left, height, width) of full support, chosen one by one for the
    most cells that no tile chosen before covers (of equal ones the first by row),
    until none adds a cell or there are ``most``; with what each adds.

    Square tiles of ``size`` begin at multiples of the stride, or end with the grid,
    which reaches from 0 to the largest y and x of a key. With ``multiple``, the
    largest rectangle of such sides comes first. A key's cells are one grid, whose
    extent the instrument bounds, and one group; repeated cells count once, cells
    without y or x not at all. A key without a full tile gives no rows."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros((int(d["y"].max()) + 1, int(d["x"].max()) + 1), bool)
        on[d["y"], d["x"]] = True
        tiles = chosen_tiles(on, size, stride, most, multiple)
        out = pd.DataFrame([(n, *t) for n, t in enumerate(tiles, 1)], columns=["tile", "top", "left", "height", "width", "adds"])
        for k, name in enumerate(keys):
            out.insert(k, name, d[name].iloc[0])
        return out

    types = dict(cells.dtypes)
    own = cells.filter(F.col("y").isNotNull() & F.col("x").isNotNull()).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    return own.groupBy(*keys).applyInPandas(run, "".join(f"`{k}` {types[k]}, " for k in keys) + "tile int, top long, left long, height long, width long, adds long")
