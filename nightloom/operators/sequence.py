"""Consecutive events as segments, roll-ups of origins and destinations, and samples in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.geo import bearing, haversine_km, lon_delta, sector
from nightloom.session import cut

#: Cell sizes of the roll-up in degrees.
LEVELS = (10.0, 5.0, 2.5)


def gap_bucket(days: Column) -> Column:
    """Bucket of a day gap."""
    return F.when(days <= 1, "gap_le_1").when(days <= 2, "gap_le_2").when(days <= 7, "gap_le_7").when(days <= 30, "gap_le_30").otherwise("gap_gt_30")


def _segment(df: DataFrame, nxt: Column) -> DataFrame:
    gap = F.abs(F.date_diff(nxt["day"], F.col("day")))
    return df.where(nxt.isNotNull()).select(
        F.concat(F.col("event_id").cast("string"), F.lit("->"), nxt["event_id"].cast("string")).alias("trace_id"), F.col("event_id").alias("from_id"), nxt["event_id"].alias("to_id"),
        F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), nxt["lat"].alias("to_lat"), (F.col("lon") + lon_delta(F.col("lon"), nxt["lon"])).alias("to_lon"),
        F.col("day").alias("from_day"), nxt["day"].alias("to_day"), gap.alias("gap_days"), gap_bucket(gap).alias("bucket"),
        F.concat(F.coalesce("source", F.lit("unknown")), F.lit("->"), F.coalesce(nxt["source"], F.lit("unknown"))).alias("pair"),
    )


def segments(events: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Segments between consecutive events of each partition, in a total order that ends with the id as text.

    ``events``: event_id, day, lat, lon, source and the order columns; rows
    without a day or position are no part of any chain (filter first, then link).
    """
    w = Window.partitionBy(*partition).orderBy(*order, F.col("event_id").cast("string"))
    placed = events.where("day is not null and lat is not null and lon is not null")
    return _segment(placed.withColumn("_next", F.lead(F.struct("event_id", "day", "lat", "lon", "source")).over(w)), F.col("_next"))


def global_segments(events: DataFrame, order: str) -> DataFrame:
    """Segments along one order over everything, without a window of one partition.

    Rows are range-partitioned by day; inside a day a window links them, and the
    last of each day is stitched to the first of the next from a table of one row a
    day, which is as long as the calendar and not as the data.
    """
    placed = events.where("day is not null and lat is not null and lon is not null").withColumn("_id", F.col("event_id").cast("string"))
    item = F.struct("event_id", "day", "lat", "lon", "source")
    inside = placed.withColumn("_next", F.lead(item).over(Window.partitionBy("day").orderBy(order, "_id")))
    ends = placed.groupBy("day").agg(F.min_by(item, F.struct(order, "_id")).alias("first"))
    stitch = ends.withColumn("_first_next", F.lead("first").over(Window.orderBy("day"))).select("day", "_first_next")
    return _segment(inside.join(F.broadcast(stitch), "day").withColumn("_next", F.coalesce("_next", "_first_next")), F.col("_next"))


def day_chains(events: DataFrame, category: str, key: str) -> DataFrame:
    """Links between consecutive events of one day and category; ids told in conflict are left out, links without length too."""
    fine = events.groupBy("event_id").agg(F.countDistinct("day", category).alias("_versions")).where("_versions <= 1").select("event_id")
    one = events.join(fine, "event_id", "left_semi").dropDuplicates(["event_id"])
    w = Window.partitionBy("day", category).orderBy(key, F.col("event_id").cast("string"))
    links = one.where(F.col(category).isNotNull()).withColumn("_next", F.lead(F.struct("event_id", "lat", "lon")).over(w)).where("_next is not null")
    moved = ~((F.col("lat") == F.col("_next.lat")) & (F.col("lon") == F.col("_next.lon")))
    return links.where(moved).select("day", category, F.col("event_id").alias("from_id"), F.col("_next.event_id").alias("to_id"), haversine_km(F.col("lat"), F.col("lon"), F.col("_next.lat"), F.col("_next.lon")).alias("km"))


def od_rollup(segs: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Counts, mean ends and date range of segments by origin cell, destination cell and gap bucket, at several cell sizes."""

    def cell(lat: Column, lon: Column, size: float) -> Column:
        return F.concat_ws(":", F.floor((F.least(lat, F.lit(89.999999)) + 90) / size).cast("string"), F.floor(F.pmod(lon + 180, F.lit(360.0)) / size).cast("string"))

    parts = []
    for size in levels:
        keys = [cell(F.col("from_lat"), F.col("from_lon"), size).alias("origin"), cell(F.col("to_lat"), F.col("to_lon"), size).alias("destination")]
        parts.append(F.struct(F.lit(size).alias("level"), *keys))
    long = segs.select("bucket", "from_lat", "from_lon", "to_lat", "from_day", "to_day", F.explode(F.array(*parts)).alias("x"))
    return long.groupBy("x.level", "x.origin", "x.destination", "bucket").agg(
        F.count("*").alias("n"), F.avg("from_lat").alias("mean_from_lat"), F.avg("to_lat").alias("mean_to_lat"), F.min("from_day").alias("first_day"), F.max("to_day").alias("last_day")
    )


def direction_counts(segs: DataFrame) -> DataFrame:
    """sector, n of segments by initial bearing; segments of no length are excluded."""
    b = bearing(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return segs.select(sector(b).alias("sector")).where("sector is not null").groupBy("sector").agg(F.count("*").alias("n"))


def interval_order(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """ordered, reversed or unknown (overlapping or missing) from two intervals."""
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    return F.when(~known, "unknown").when(a_end < b_start, "ordered").when(b_end < a_start, "reversed").otherwise("unknown")


def systematic_sample(rows: DataFrame, partition: list[str], order: list[str], parts: int) -> DataFrame:
    """The middle row of each of ``parts`` equal runs in order, with the run's length as weight."""
    w = Window.partitionBy(*partition).orderBy(*order)
    runs = rows.withColumns({"_part": F.ntile(parts).over(w), "_at": F.row_number().over(w)})
    inner = Window.partitionBy(*partition, "_part")
    sized = runs.withColumns({"_first": F.min("_at").over(inner), "weight": F.count("*").over(inner)})
    return sized.where(F.col("_at") == F.col("_first") + F.floor((F.col("weight") - 1) / 2)).withColumnRenamed("_part", "part").drop("_at", "_first")


def walk(segs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """trace_id, hop: the edges met from seed events when one edge is followed per hop, the first in id order going out.

    ``depth`` joins, one a hop; a small bounded number.
    """
    first = segs.groupBy("from_id").agg(F.min(F.struct("trace_id", "to_id")).alias("e")).select("from_id", "e.*")
    frontier, out = seeds.select(F.col("event_id").alias("at")).distinct(), []
    for hop in range(1, depth + 1):
        step = frontier.join(first, frontier["at"] == first["from_id"]).select("trace_id", F.col("to_id").alias("at"))
        out.append(step.select("trace_id", F.lit(hop).alias("hop")))
        frontier = step.select("at").distinct()
        if hop % 4 == 0:
            frontier = cut(frontier)
    return reduce(DataFrame.union, out).groupBy("trace_id").agg(F.min("hop").alias("hop"))
