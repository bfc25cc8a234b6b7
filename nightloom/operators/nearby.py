"""Points within a distance of other points or inside regions, by ranges on a space-filling curve.

Every disc or polygon is covered by ranges of Z-order codes; a position joins the
ranges that hold its code (an equi-join on the code's leading bits, of a length
that suits the range, then the range test), and the great-circle distance or the
polygon itself decides. Nothing is compared outside its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions.geo import EARTH_KM, LEVEL, haversine_km, morton, wrap_lon
from nightloom.session import cut, small

#: Bits per axis that a join key may have; a range takes the most with which it spans at most KEYS of them.
GRIDS, KEYS = (2, 5, 8, 11, 14), 4
#: Cells a disc's box may span per axis.
SPAN = 4


def _spread(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def disc_ranges(lat: float, lon: float, km: float, radius: float = EARTH_KM) -> list[tuple[int, int]]:
    """Merged code ranges (both ends included) of cells that cover the disc; lon in [-180, 180)."""
    reach = km / radius * (1 + 1e-9) + 1e-12
    d_lat = float(np.degrees(reach))
    south, north = lat - d_lat, lat + d_lat
    if south <= -90 or north >= 90 or reach >= np.pi / 2:
        d_lon = 180.0
    else:
        d_lon = float(np.degrees(np.arcsin(min(1.0, np.sin(reach) / np.cos(np.radians(lat)))))) + 1e-9
    south, north = max(south, -90.0), min(north, 90.0)
    level = LEVEL
    while level and (2 * d_lon > SPAN * 360 / (1 << level) or north - south > SPAN * 180 / (1 << level)):
        level -= 1
    n = 1 << level
    ys = np.arange(int((south + 90) / 180 * n), min(int((north + 90) / 180 * n), n - 1) + 1)
    if d_lon >= 180:
        xs = np.arange(n)
    else:
        xs = np.unique(np.arange(int(np.floor((lon - d_lon + 180) / 360 * n)), int(np.floor((lon + d_lon + 180) / 360 * n)) + 1) % n)
    codes = np.sort(((_spread(ys) << 1)[:, None] | _spread(xs)[None, :]).ravel())
    shift = 2 * (LEVEL - level)
    starts = np.r_[True, np.diff(codes) > 1]
    ends = np.r_[starts[1:], True]
    return [(int(a) << shift, ((int(b) + 1) << shift) - 1) for a, b in zip(codes[starts], codes[ends], strict=True)]


def _merged(codes: np.ndarray, levels: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of cells of mixed levels, adjacent ones joined."""
    shift = 2 * (LEVEL - levels)
    order = np.argsort(codes << shift)
    lo, hi = (codes << shift)[order], (((codes + 1) << shift) - 1)[order]
    starts = np.r_[True, lo[1:] != hi[:-1] + 1]
    return [(int(a), int(b)) for a, b in zip(lo[starts], hi[np.r_[starts[1:], True]], strict=True)]


def inside(lat: np.ndarray, lon: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Whether positions lie in a ring (n, 2) of latitude and longitude, by crossings of its edges; longitudes as the ring has them."""
    hit = np.zeros(np.broadcast_shapes(lat.shape, lon.shape), bool)
    for (y1, x1), (y2, x2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
        if y1 != y2:
            hit ^= ((y1 > lat) != (y2 > lat)) & (lon < x1 + (lat - y1) * ((x2 - x1) / (y2 - y1)))
    return hit


def region_ranges(ring: np.ndarray, most: int = 64) -> list[tuple[int, int, bool]]:
    """(low, high, whole) code ranges that cover a ring; of a whole one every position is inside.

    The ring may run past 180. Cells that its edges cross are quartered while there
    are fewer than ``most`` of them.
    """
    x, y = ring[:, 1], ring[:, 0]
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    level, cells = 2, [(i, j) for i in range(4) for j in range(-4, 8)]
    out: list[tuple[int, int, int, bool]] = []
    while cells:
        h, w = 180 / (1 << level), 360 / (1 << level)
        crossed = []
        for i, j in cells:
            south, west = -90 + i * h, -180 + j * w
            # an edge meets the cell if what the cell's four sides leave of it is not empty
            t0, t1 = np.zeros(len(x)), np.ones(len(x))
            for p, d in ((west - x, x2 - x), (x - west - w, x - x2), (south - y, y2 - y), (y - south - h, y - y2)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = p / d
                t0 = np.where(d > 0, np.maximum(t0, t), np.where((d == 0) & (p > 0), 2, t0))
                t1 = np.where(d < 0, np.minimum(t1, t), t1)
            if (t0 <= t1).any():
                crossed.append((i, j))
            elif inside(np.array([south + h / 2]), np.array([west + w / 2]), ring)[0]:
                out.append((i, j, level, True))
        if level == LEVEL or len(crossed) * 2 > most:
            out += [(i, j, level, False) for i, j in crossed]
            break
        cells = [(2 * i + a, 2 * j + b) for i, j in crossed for a in (0, 1) for b in (0, 1)]
        level += 1
    found: dict[bool, list[tuple[int, int]]] = {True: [], False: []}
    for i, j, at, whole in out:
        n = 1 << at
        found[whole].append(((int(_spread(np.array([i]))[0]) << 1) | int(_spread(np.array([j % n]))[0]), at))
    return [(lo, hi, whole) for whole, got in found.items() if got for lo, hi in _merged(np.array([c for c, _ in got], np.int64), np.array([k for _, k in got], np.int64))]


def _placed(df: DataFrame, name: str) -> DataFrame:
    """Rows with an id and a possible position, longitudes in [-180, 180)."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    fine = F.col(name).isNotNull() & lat.isNotNull() & ~F.isnan(lat) & (F.abs(lat) <= 90) & lon.isNotNull() & ~F.isnan(lon) & (F.abs(lon) < 1e6)
    return df.where(fine).select(F.col(name), lat.alias("lat"), wrap_lon(lon).alias("lon"))


def _range_join(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points (id, lat, lon) with every range (lo, hi and more) that holds their code.

    Each range goes to the keys of the grid that suits its length, so neither a
    polar disc of long ranges nor a small one meets more than its surroundings;
    points get a key for every grid in use, at most as many as there are GRIDS.
    """
    spans = lambda g: F.shiftright("hi", 2 * (LEVEL - g)) - F.shiftright("lo", 2 * (LEVEL - g))
    grid = F.lit(GRIDS[0])
    for g in GRIDS[1:]:
        grid = F.when(spans(g) < KEYS, g).otherwise(grid)
    held = cut(ranges.withColumn("grid", grid))
    used = sorted(r[0] for r in held.select("grid").distinct().collect())
    key = lambda c: F.coalesce(*[F.when(F.col("grid") == g, F.shiftright(c, 2 * (LEVEL - g))) for g in used]) if used else F.shiftright(c, 0)
    keyed = held.withColumn("cell", F.explode(F.sequence(key("lo"), key("hi"))))
    at = points.withColumn("code", morton(F.col("lat"), F.col("lon"))).withColumn("grid", F.explode(F.array(*[F.lit(g) for g in used or GRIDS[:1]]))).withColumn("cell", key("code"))
    return at.join(small(keyed), ["grid", "cell"]).where(F.col("code").between(F.col("lo"), F.col("hi"))).drop("grid", "cell", "code", "lo", "hi")


def within_distance(points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Distinct pairs of a point and a site that has a position at most ``km`` away.

    ``points``: id string, lat, lon; ``sites``: site string, lat, lon (a site may
    have several rows). Returns id, site. Rows with a missing id or site, a
    missing, NaN or infinite position, or a latitude beyond 90 give no pairs;
    longitudes are counted on around the globe; repeated rows change nothing and
    empty tables give an empty result. Only the named columns are used.

    Ranges are broadcast when they are counted to be few; else both sides
    shuffle on the keys, where adaptive execution splits a hot cell.
    """

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for site, lat, lon in zip(b["site"], b["lat"], b["lon"], strict=True):
                out += [(site, lat, lon, lo, hi) for lo, hi in disc_ranges(lat, lon, km)]
            yield pd.DataFrame(out, columns=["site", "s_lat", "s_lon", "lo", "hi"])

    ranges = _placed(sites, "site").distinct().mapInPandas(cover, "site string, s_lat double, s_lon double, lo long, hi long")
    near = _range_join(_placed(points, "id"), ranges)
    return near.where(haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= km).select("id", "site").distinct()


def within_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """id, region: distinct pairs of a point and a region that contains it.

    ``points`` as for ``within_distance``; ``regions``: region string, ring
    array<struct<lat,lon>>, a simple ring that may run past 180 but not around a
    pole, edges straight in latitude and longitude. A region of several rings has
    several rows; rings of fewer than three ends and null regions hold nothing.
    Positions of cells wholly inside need no test of the ring itself.
    """

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for region, ring in zip(b["region"], b["ring"], strict=True):
                ends = np.array([(p["lat"], p["lon"]) for p in ring], float)
                out += [(region, None if whole else ring, lo, hi) for lo, hi, whole in region_ranges(ends)]
            yield pd.DataFrame(out, columns=["region", "ring", "lo", "hi"])

    @F.pandas_udf("boolean")
    def holds(lat: pd.Series, lon: pd.Series, ring: pd.Series) -> pd.Series:
        out = np.zeros(len(lat), bool)
        for k, (a, b, r) in enumerate(zip(lat, lon, ring, strict=True)):
            ends = np.array([(p["lat"], p["lon"]) for p in r], float)
            out[k] = inside(np.full(3, a), b + np.array([-360.0, 0.0, 360.0]), ends).any()
        return pd.Series(out)

    kind = "array<struct<lat:double,lon:double>>"
    fine = regions.where("region is not null and size(ring) >= 3").select(F.col("region"), F.col("ring").cast(kind).alias("ring")).where(~F.exists("ring", lambda p: p["lat"].isNull() | p["lon"].isNull() | F.isnan(p["lat"]) | F.isnan(p["lon"])))
    near = _range_join(_placed(points, "id"), fine.distinct().mapInPandas(cover, f"region string, ring {kind}, lo long, hi long"))
    sure = near.where("ring is null").select("id", "region")
    return sure.union(near.where("ring is not null").where(holds("lat", "lon", "ring")).select("id", "region")).distinct()
