"""Joins by day window and distance, on exploded days and grid cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.geo import EARTH_KM, haversine_km
from nightloom.session import small


def grid_cells(lat: Column, lon: Column, km: float, size: float) -> Column:
    """Keys of all grid cells that a disc may reach, across the date line and at the poles."""
    d_lat = km / 111.0
    south, north = F.greatest(lat - d_lat, F.lit(-90.0)), F.least(lat + d_lat, F.lit(90.0))
    widest = F.greatest(F.abs(south), F.abs(north))
    polar = widest > 89.0
    d_lon = F.least(F.lit(180.0), d_lat / F.greatest(F.cos(F.radians(F.least(widest, F.lit(89.0)))), F.lit(1e-6)))
    columns = int(360 / size)
    ys = F.sequence(F.floor((south + 90) / size), F.floor((north + 90) / size))
    xs = F.when(polar, F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).otherwise(F.sequence(F.floor((lon - d_lon + 180) / size), F.floor((lon + d_lon + 180) / size)))
    xs = F.array_distinct(F.transform(xs, lambda x: F.pmod(x, F.lit(columns))))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: y * columns + x)))


def grid_cell(lat: Column, lon: Column, size: float) -> Column:
    """Key of the cell that holds a position."""
    columns = int(360 / size)
    return F.floor((lat + 90) / size) * columns + F.pmod(F.floor((lon + 180) / size), F.lit(columns))


def near_pairs(left: DataFrame, right: DataFrame, km: float, size: float) -> DataFrame:
    """left_id, right_id, km: pairs within a distance. Both frames: id, lat, lon; the right side is spread over its cells."""
    a = left.select(F.col("id").alias("left_id"), F.col("lat").alias("_a"), F.col("lon").alias("_b"), grid_cell(F.col("lat"), F.col("lon"), size).alias("_cell"))
    b = right.select(F.col("id").alias("right_id"), F.col("lat").alias("_c"), F.col("lon").alias("_d"), F.explode(grid_cells(F.col("lat"), F.col("lon"), km, size)).alias("_cell"))
    far = haversine_km(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"))
    return a.join(small(b), "_cell").select("left_id", "right_id", far.alias("km")).where(F.col("km") <= km)


def day_window_pairs(left: DataFrame, right: DataFrame, days: int, km: float, size: float) -> DataFrame:
    """left_id, right_id, lag, km, phase: pairs at most ``days`` apart and ``km`` away.

    Frames: id, day, lat, lon. The right side is spread over (window block, cell)
    keys, where a block is ``days`` + 1 days, so each row goes to three blocks at
    most however wide the window is.
    """
    width = days + 1
    block = lambda c: F.floor(F.unix_date(c) / width)
    a = left.select(F.col("id").alias("left_id"), F.col("day").alias("_x"), F.col("lat").alias("_a"), F.col("lon").alias("_b"), block(F.col("day")).alias("_block"), grid_cell(F.col("lat"), F.col("lon"), size).alias("_cell"))
    b = right.select(F.col("id").alias("right_id"), F.col("day").alias("_y"), F.col("lat").alias("_c"), F.col("lon").alias("_d"), F.explode(F.sequence(block(F.date_add("day", -days)), block(F.date_add("day", days)))).alias("_block"), grid_cells(F.col("lat"), F.col("lon"), km, size).alias("_cells"))
    b = b.withColumn("_cell", F.explode("_cells")).drop("_cells")
    lag = F.date_diff("_x", "_y")
    far = haversine_km(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"))
    pairs = a.join(small(b), ["_block", "_cell"]).where(F.abs(lag) <= days).select("left_id", "right_id", lag.alias("lag"), far.alias("km")).where(F.col("km") <= km)
    return pairs.withColumn("phase", F.when(F.col("lag") < 0, "before").when(F.col("lag") > 0, "after").otherwise("same"))


def distance_band(km: Column, bands: list[float]) -> Column:
    """The first band, in ascending order, whose bound is not exceeded."""
    out = F.lit(None).cast("double")
    for b in sorted(bands, reverse=True):
        out = F.when(km <= b, F.lit(float(b))).otherwise(out)
    return out


def nearest(pairs: DataFrame, left: str, right: str, distance: str) -> DataFrame:
    """The nearest right side of every left one; ties by the lesser id."""
    return pairs.groupBy(left).agg(F.min(F.struct(distance, right)).alias("_m")).select(left, F.col("_m")[right].alias(right), F.col("_m")[distance].alias(distance))


def first_later_nearest(points: DataFrame, days: int, km: float, size: float) -> DataFrame:
    """from_id, to_id, gap, km: the nearest point on the first later day (within ``days``) that has one within ``km``."""
    pairs = day_window_pairs(points, points, days, km, size).where("lag > 0")
    best = pairs.groupBy("right_id").agg(F.min(F.struct("lag", "km", "left_id")).alias("_m"))
    return best.select(F.col("right_id").alias("from_id"), F.col("_m.left_id").alias("to_id"), F.col("_m.lag").alias("gap"), F.col("_m.km").alias("km"))


def interval_state(at: Column, intervals: Column, boundary: int) -> Column:
    """active, unknown or inactive of a day against an array of (start, end) days with uncertain ends; no interval: unknown."""
    inside = F.exists(intervals, lambda i: (at >= i["start"] + boundary) & (at <= i["end"] - boundary))
    close = F.exists(intervals, lambda i: (at >= i["start"] - boundary) & (at <= i["end"] + boundary))
    return F.when(intervals.isNull() | (F.size(intervals) <= 0), "unknown").when(inside, "active").when(close, "unknown").otherwise("inactive")


def point_segment_km(plat: Column, plon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of a point from a segment on the plane around the point."""
    k = F.cos(F.radians(plat)) * 111.195
    wrap = lambda d: F.pmod(d + 180.0, F.lit(360.0)) - 180.0
    ax, ay = wrap(lon1 - plon) * k, (lat1 - plat) * 111.195
    bx, by = ax + (lon2 - lon1) * k, (lat2 - plat) * 111.195
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def pieces(segments: DataFrame, degrees: float) -> DataFrame:
    """trace_id, from_lat, from_lon, to_lat, to_lon: every segment cut into equal pieces of at most ``degrees`` both ways."""
    d_lat, d_lon = F.col("to_lat") - F.col("from_lat"), F.col("to_lon") - F.col("from_lon")
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(d_lat), F.abs(d_lon)) / degrees))
    each = segments.select("trace_id", "from_lat", "from_lon", d_lat.alias("_y"), d_lon.alias("_x"), n.alias("_n")).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = lambda c, d, p: F.col(c) + F.col(d) * p / F.col("_n")
    return each.select("trace_id", at("from_lat", "_y", F.col("_p")).alias("from_lat"), at("from_lon", "_x", F.col("_p")).alias("from_lon"), at("from_lat", "_y", F.col("_p") + 1).alias("to_lat"), at("from_lon", "_x", F.col("_p") + 1).alias("to_lon"))


def points_along(segments: DataFrame, points: DataFrame, km: float, size: float) -> DataFrame:
    """trace_id, id, km: points within a distance of a segment.

    Segments are cut into pieces of four cells, which are laid over the grid cells
    of their bounding boxes, so no segment is too long; the least distance counts.
    """
    pad = km / 111.0
    s = pieces(segments, 4 * size)
    south, north = F.least("from_lat", "to_lat") - pad, F.greatest("from_lat", "to_lat") + pad
    widest = F.greatest(F.abs(south), F.abs(north))
    lon_pad = pad / F.cos(F.radians(F.least(widest, F.lit(89.0))))
    west, east = F.least("from_lon", "to_lon") - lon_pad, F.greatest("from_lon", "to_lon") + lon_pad
    columns = int(360 / size)
    ys = F.sequence(F.floor((south + 90) / size), F.floor((north + 90) / size))
    xs = F.when(widest > 89.0, F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))).otherwise(F.sequence(F.floor((west + 180) / size), F.floor((east + 180) / size)))
    s = s.select("*", ys.alias("_ys"), xs.alias("_xs")).withColumn("_y", F.explode("_ys")).withColumn("_x", F.explode("_xs"))
    laid = s.select("trace_id", "from_lat", "from_lon", "to_lat", "to_lon", (F.col("_y") * columns + F.pmod("_x", F.lit(columns))).alias("_cell"))
    at = points.select("id", "lat", "lon", grid_cell(F.col("lat"), F.col("lon"), size).alias("_cell"))
    far = point_segment_km(F.col("lat"), F.col("lon"), F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    near = laid.join(small(at), "_cell").select("trace_id", "id", "lat", "lon", far.alias("km")).where(F.col("km") <= km)
    return near.groupBy("trace_id", "id", "lat", "lon").agg(F.min("km").alias("km")).select("trace_id", "id", "km").distinct()


def line_cells(x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> Column:
    """Keys of the grid cells that a segment runs through, row by row; longitudes run on past the date line."""
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    at = lambda y, end: F.when(y1 == y2, end).otherwise(x1 + F.try_divide(y - y1, y2 - y1) * (x2 - x1))
    # a little wider, since the ends of a row are rounded
    column = lambda x, more: F.floor((x + more + 180) / size)

    def row(i: Column) -> Column:
        a, b = at(F.greatest(i * size - 90, low), x1), at(F.least((i + 1) * size - 90, high), x2)
        return F.transform(F.sequence(column(F.least(a, b), -1e-3), column(F.greatest(a, b), 1e-3)), lambda j: i * 10_000 + j)

    return F.flatten(F.transform(F.sequence(F.floor((low + 90) / size), F.floor((high + 90) / size)), row))


def crossings(segments: DataFrame, size: float = 10.0, buffer_km: float = 0.0, least_angle: float = 0.0) -> DataFrame:
    """a, b, lat, lon, angle: where two segments, lesser id first, cross inside both; they share no end.

    A crossing nearer than ``buffer_km`` to an end of either segment, along it, or
    at less than ``least_angle`` degrees is left out. Segments meet in common grid
    cells only: one side is also laid a turn to the west and to the east, since
    segments over the date line run past 180, and a pair is told in the least of
    its common cells.
    """
    s = segments.select("trace_id", "from_id", "to_id", F.col("from_lat").alias("y1"), F.col("from_lon").alias("x1"), F.col("to_lat").alias("y2"), F.col("to_lon").alias("x2"))
    s = s.withColumn("km", haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")))
    turned = s.withColumn("_turn", F.explode(F.array(*map(F.lit, (-360.0, 0.0, 360.0))))).withColumns({c: F.col(c) + F.col("_turn") for c in ("x1", "x2")}).drop("_turn").where("least(x1, x2) <= 360 and greatest(x1, x2) >= -360")

    def laid(side: DataFrame, name: str) -> DataFrame:
        out = side.withColumn("cells", line_cells(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), size)).withColumn("_cell", F.explode("cells"))
        return out.select([F.col(c).alias(f"{name}_{c}") for c in out.columns])

    pairs = laid(s, "a").join(laid(turned, "b"), F.col("a__cell") == F.col("b__cell")).where("a_trace_id < b_trace_id and a_from_id <> b_from_id and a_from_id <> b_to_id and a_to_id <> b_from_id and a_to_id <> b_to_id")
    rx, ry, sx, sy = F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1"), F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    px, py, flat = F.col("b_x1") - F.col("a_x1"), F.col("b_y1") - F.col("a_y1"), rx * sy - ry * sx
    # fractions of the lengths at which they meet, times flat: inside both if between 0 and flat
    t, u = px * sy - py * sx, px * ry - py * rx
    inside = pairs.where((F.abs(flat) > 1e-10) & (t * (flat - t) > 0) & (u * (flat - u) > 0)).where(F.col("a__cell") == F.array_min(F.array_intersect("a_cells", "b_cells")))

    def step(df: DataFrame, **columns: Column) -> DataFrame:
        """Columns computed once: written into each other, they would be repeated beyond what compiles."""
        return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

    met = step(inside, t=F.try_divide(t, flat), u=F.try_divide(u, flat)).where("t > 1e-10 and t < 1 - 1e-10 and u > 1e-10 and u < 1 - 1e-10")
    if buffer_km > 0:
        met = met.where(f"least(t, 1 - t) * a_km >= {buffer_km} and least(u, 1 - u) * b_km >= {buffer_km}")
    met = step(met, lat=F.col("a_y1") + F.col("t") * ry, lon=F.pmod(F.col("a_x1") + F.col("t") * rx + 180.0, F.lit(360.0)) - 180.0)
    # a degree of longitude shrinks towards the poles, to a twentieth at most
    met = step(met, k=F.pow(F.greatest(F.lit(0.05), F.abs(F.cos(F.radians("lat")))), 2))
    cosine = F.try_divide(rx * sx * F.col("k") + ry * sy, F.sqrt(rx * rx * F.col("k") + ry * ry) * F.sqrt(sx * sx * F.col("k") + sy * sy))
    met = step(met, angle=F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cosine)))))
    return met.where(F.col("angle") + 1e-10 >= least_angle).select(F.col("a_trace_id").alias("a"), F.col("b_trace_id").alias("b"), "lat", "lon", "angle")


def forest_edges(lat: np.ndarray, lon: np.ndarray, km: float) -> list[tuple[int, int]]:
    """Edges (i, j), i < j, of the minimum spanning forest over all pairs apart and within ``km``, by Prim's steps; equal distances go by (i, j)."""
    phi = np.radians(lat)
    cos = np.cos(phi)
    at, n, out = 0, len(lat) - 1, []
    # points outside the tree with their nearest edge into it; the last fills the gap of one taken out
    rest, best, low, high = np.arange(1, n + 1), np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    while n:
        r = rest[:n]
        h = np.sin((phi[r] - phi[at]) / 2) ** 2 + cos[at] * cos[r] * np.sin(np.radians(lon[r] - lon[at]) / 2) ** 2
        d = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        d[~((d > 0) & (d <= km))] = np.inf
        a, b = np.minimum(r, at), np.maximum(r, at)
        closer = (d < best[:n]) | ((d == best[:n]) & (d < np.inf) & ((a < low[:n]) | ((a == low[:n]) & (b < high[:n]))))
        for old, new in ((best, d), (low, a), (high, b)):
            old[:n][closer] = new[closer]
        k = int(best[:n].argmin())
        if best[k] < np.inf:
            ties = np.flatnonzero(best[:n] == best[k])
            k = int(ties[np.lexsort((high[ties], low[ties]))[0]])
            out.append((int(low[k]), int(high[k])))
        at, n = int(rest[k]), n - 1
        for x in (rest, best, low, high):
            x[k] = x[n]
    return out


def _least_edges(edges: DataFrame) -> DataFrame:
    """day, a, b, km: the minimum spanning forest of such edges by Borůvka's rounds: every tree's nearest edge to another tree, then components."""
    from nightloom.operators.graph import components
    from nightloom.session import written

    edges = written(edges.distinct())
    kept = None
    label = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("tree"))
    nodes = label.select("id")
    for _ in range(40):
        a, b = label.select(F.col("id").alias("a"), F.col("tree").alias("ta")), label.select(F.col("id").alias("b"), F.col("tree").alias("tb"))
        between = edges.join(a, "a").join(b, "b").where("ta <> tb")
        both = between.select(F.col("ta").alias("t"), "day", "a", "b", "km").union(between.select(F.col("tb").alias("t"), "day", "a", "b", "km"))
        chosen = written(both.groupBy("t").agg(F.min(F.struct("km", "a", "b", "day")).alias("m")).select("m.day", "m.a", "m.b", "m.km").distinct())
        if chosen.isEmpty():
            break
        kept = chosen if kept is None else written(kept.union(chosen).distinct())
        found = components(kept.select("a", "b"), keep=written)
        label = written(nodes.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("tree")))
    return edges.limit(0) if kept is None else kept


def day_forest(points: DataFrame, km: float, block: int = 8192) -> DataFrame:
    """day, a, b, km: a minimum spanning forest of each day's points, edges apart and within ``km``; equal distances go by (a, b).

    Pairs are never written out: a day of at most ``block`` points is solved from
    its positions in one task. The points of a larger day are dealt to blocks, every
    two blocks are solved together, in tasks of their own, and only the edges left
    by them, among which is the day's whole forest, go into rounds of joins.
    """
    from nightloom.session import cut

    spark = points.sparkSession
    p = cut(points.where("id is not null and day is not null and lat is not null and lon is not null").select("id", F.unix_date("day").alias("day"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")))
    days = p.groupBy("day").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = p.join(days, "day").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 or own <> other")
    dealt = dealt.select("day", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "lat", "lon")
    # as many tasks as the session shuffles to: by bytes, the points would end in too few
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "day", "i", "j").sortWithinPartitions("day", "i", "j", "id")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def edges(rows: pd.DataFrame, bounds: list[int]) -> pd.DataFrame:
            lat, lon = rows["lat"].to_numpy(), rows["lon"].to_numpy()
            ends = [(s + i, s + j) for s, e in zip(bounds, bounds[1:]) for i, j in forest_edges(lat[s:e], lon[s:e], km)]
            left, right = (rows.iloc[[x[k] for x in ends]].reset_index(drop=True) for k in (0, 1))
            return pd.DataFrame({"day": left["day"], "j": left["j"], "a": left["id"], "a_lat": left["lat"], "a_lon": left["lon"], "b": right["id"], "b_lat": right["lat"], "b_lon": right["lon"]})

        open_rows: list[pd.DataFrame] = []  # of the group that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*open_rows, batch], ignore_index=True) if open_rows else batch
            keys = rows[["day", "i", "j"]].to_numpy()
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
            if len(bounds) > 1:
                yield edges(rows, bounds)
            open_rows = [rows.iloc[bounds[-1] :]]
        if open_rows:
            yield edges(open_rows[0], [0, len(open_rows[0])])

    kind = points.schema["id"].dataType.simpleString()
    solved = ordered.mapInPandas(solve, f"day int, j long, a {kind}, a_lat double, a_lon double, b {kind}, b_lat double, b_lon double")
    # distances again by the expression that other queries use
    solved = solved.select(F.date_from_unix_date("day").alias("day"), "j", "a", "b", haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("km"))
    if days.where("blocks > 1").isEmpty():
        return solved.drop("j")
    solved = cut(solved)
    return solved.where("j = 0").drop("j").union(_least_edges(solved.where("j > 0").drop("j")))


def near_or_comparison(km: Column, near: float = 25.0, low: float = 100.0, high: float = 250.0) -> Column:
    """near, comparison or null by distance."""
    return F.when(km <= near, "near").when(km.between(low, high), "comparison")


def nearest_by_state(pairs: DataFrame, left: str, state: str) -> DataFrame:
    """left, state and the nearest right_id of each state."""
    w = Window.partitionBy(left, state).orderBy("km", "right_id")
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(left, state, "right_id", "km")
