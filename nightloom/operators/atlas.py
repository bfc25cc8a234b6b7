"""Field-by-row atlases with explicit evidence states, field assessments, and views by zoom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.geo import mercator_pixel
from nightloom.operators.predicates import evidence_state


def atlas(rows: DataFrame, row_key: str, source: str, axes: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """axis, row, column, state, source, n: one long table over all axes, from which any cell follows.

    ``axes``: name to (value, ready, excluded). Every axis gives each row exactly one
    state, so missing evidence is never a zero.
    """
    cells = []
    for name, (value, ready, excluded) in axes.items():
        state = evidence_state(ready, excluded, value)
        cells.append(F.struct(F.lit(name).alias("axis"), F.when(state == "supported", value.cast("string")).alias("column"), state.alias("state")))
    long = rows.select(F.col(row_key).alias("row"), F.col(source).alias("source"), F.explode(F.array(*cells)).alias("x")).select("x.axis", "row", "x.column", "x.state", "source")
    return long.groupBy("axis", "row", "column", "state", "source").agg(F.count("*").alias("n"))


def atlas_cells(table: DataFrame) -> DataFrame:
    """axis, row, column, n, row_share, balanced_share, low, high of an ``atlas``.

    balanced_share is the mean over sources of a source's own share; low and high
    are the share if none or all of the unknown rows belonged to the cell.
    """
    has = F.col("state") == "supported"
    by_row = table.groupBy("axis", "row").agg(F.sum(F.when(has, F.col("n"))).alias("of"), F.coalesce(F.sum(F.when(F.col("state") == "unknown", F.col("n"))), F.lit(0)).alias("open"))
    cell = table.where(has).groupBy("axis", "row", "column").agg(F.sum("n").alias("n"))
    by_source = table.where(has).groupBy("axis", "row", "source").agg(F.sum("n").alias("s_of"))
    sources = by_source.groupBy("axis", "row").agg(F.count("*").alias("sources"))
    part = table.where(has).join(by_source, ["axis", "row", "source"]).groupBy("axis", "row", "column").agg(F.sum(F.col("n") / F.col("s_of")).alias("shares"))
    both = cell.join(part, ["axis", "row", "column"]).join(by_row, ["axis", "row"]).join(sources, ["axis", "row"])
    every = F.col("of") + F.col("open")
    return both.select("axis", "row", "column", "n", (F.col("n") / F.col("of")).alias("row_share"), (F.col("shares") / F.col("sources")).alias("balanced_share"), (F.col("n") / every).alias("low"), ((F.col("n") + F.col("open")) / every).alias("high"))


def duration_seconds(value: Column) -> Column:
    """Seconds of a duration text (10 sec, about an hour, 5-10 minutes: the middle), null if it tells none."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"\b(?:about|approx\.?|around|nearly|roughly|over|a few)\b\s*", "")
    unit = F.when(low.rlike(r"\bsec|\bs$|\ds\b"), 1).when(low.rlike(r"\bmin|\bm$|\dm\b"), 60).when(low.rlike(r"\bhou?r|\bhrs?\b|\dh\b"), 3600).when(low.rlike(r"\bday"), 86400)
    a = F.nullif(F.regexp_extract(low, r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    b = F.nullif(F.regexp_extract(low, r"\d\s*(?:-|to)\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    one = F.when(low.rlike(r"^(?:an?|one)\b"), 1.0).when(low.rlike(r"^half an?\b"), 0.5)
    return F.coalesce(F.when(b.isNotNull(), (a + b) / 2), a, one) * unit


def duration_bin(seconds: Column) -> Column:
    """Bin of a duration."""
    out = F.when(seconds.isNotNull(), "over_hour")
    for bound, name in ((3600, "up_to_hour"), (600, "up_to_10_minutes"), (60, "up_to_minute"), (10, "up_to_10_seconds")):
        out = F.when(seconds <= bound, name).otherwise(out)
    return out


def clock_bin(minutes: Column) -> Column:
    """night, morning, afternoon or evening of a minute of the day."""
    return F.when(minutes < 360, "night").when(minutes < 720, "morning").when(minutes < 1080, "afternoon").when(minutes < 1440, "evening")


def clusters(points: DataFrame, zoom: int, most: int = 400, cell: int = 40) -> tuple[DataFrame, int]:
    """gx, gy, n, representative of pixel cells, doubled until at most ``most`` are left, and the cell size.

    Points are counted once at the first size; the doublings run over cells.
    """
    x, y = mercator_pixel(F.col("lat"), F.col("lon"), zoom)
    base = points.groupBy(F.floor(x / cell).alias("gx"), F.floor(y / cell).alias("gy")).agg(F.count("*").alias("n"), F.min("id").alias("representative"))
    size = cell
    while size < 256 << zoom and base.limit(most + 1).count() > most:
        base = base.groupBy(F.floor(F.col("gx") / 2).alias("gx"), F.floor(F.col("gy") / 2).alias("gy")).agg(F.sum("n").alias("n"), F.min("representative").alias("representative"))
        size *= 2
    return base, size


def neighbourhood(segs: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """trace_id, direction, hop: edges met from seed events, one edge a hop, the first going out and the last coming in."""
    out = None
    for direction, start, end, best in (("forward", "from_id", "to_id", F.min), ("backward", "to_id", "from_id", F.max)):
        step = segs.groupBy(F.col(start).alias("at")).agg(best(F.struct("trace_id", F.col(end).alias("then"))).alias("e")).select("at", "e.*")
        here = seeds.select(F.col("event_id").alias("at")).distinct()
        for hop in range(1, depth + 1):
            met = here.join(step, "at").select("trace_id", F.col("then").alias("at"))
            part = met.select("trace_id", F.lit(direction).alias("direction"), F.lit(hop).alias("hop"))
            out = part if out is None else out.union(part)
            here = met.select("at").distinct()
    return out.groupBy("trace_id", "direction").agg(F.min("hop").alias("hop"))


def similar_segments(segs: DataFrame, size: float) -> DataFrame:
    """a_cell, b_cell, n: undirected segments grouped by the cells of their ends."""
    key = lambda lat, lon: F.concat_ws(":", F.floor(F.col(lat) / size).cast("string"), F.floor((F.pmod(F.col(lon) + 180, F.lit(360.0)) - 180) / size).cast("string"))
    a, b = key("from_lat", "from_lon"), key("to_lat", "to_lon")
    return segs.groupBy(F.least(a, b).alias("a_cell"), F.greatest(a, b).alias("b_cell")).agg(F.count("*").alias("n"))


def result_page(rows: DataFrame, order: list[str], target: str, value: object, size: int) -> DataFrame:
    """The page of ``size`` rows, in order, that holds the first row of a key; empty without one.

    The rows before it are counted, and only those up to the page's end are put in order.
    """
    found = rows.where(F.col(target) == F.lit(value)).orderBy(*order).limit(1).collect()
    if not found:
        return rows.limit(0)
    at = F.struct(*[F.lit(found[0][c]).cast(rows.schema[c].dataType).alias(c) for c in order])
    page = rows.where(F.struct(*order) < at).count() // size
    return rows.orderBy(*order).offset(page * size).limit(size)
