"""Worklists and decisions, sensitivity gates, segments against sites, and lookups."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.geo import EARTH_KM, haversine_km
from nightloom.functions.stats import mantel_haenszel
from nightloom.operators.proximity import grid_cell, grid_cells


def apply_decisions(queue: DataFrame, decisions: DataFrame, key: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """The queue with its decision, and problem rows: unknown key, invalid or contradicting decision."""
    named = decisions.select(key, F.lower(F.trim("decision")).alias("decision"))
    by = named.groupBy(key).agg(F.min("decision").alias("decision"), F.max("decision").alias("_other"), F.count_if(~F.col("decision").isin(*allowed) | F.col("decision").isNull()).alias("_bad"))
    known = queue.select(key).distinct().withColumn("_known", F.lit(True))
    judged = by.join(known, key, "left").withColumn("problem", F.when(F.col("_known").isNull(), "unknown_key").when(F.col("_bad") > 0, "invalid_decision").when(F.col("decision") != F.col("_other"), "contradiction"))
    fine = judged.where("problem is null").select(key, "decision")
    return queue.join(fine, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending"))), judged.where("problem is not null").select(key, "problem")


def key_opportunities(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """family, groups, records, removable of key families: what merging by each alone would take away."""
    long = records.select(F.explode(F.array_compact(F.array(*[F.when(F.trim(c) != "", F.struct(F.lit(n).alias("family"), c.alias("key"))) for n, c in keys.items()]))).alias("x")).select("x.*")
    n = long.groupBy("family", "key").agg(F.count("*").alias("n")).where("n > 1")
    return n.groupBy("family").agg(F.count("*").alias("groups"), F.sum("n").alias("records"), F.sum(F.col("n") - 1).alias("removable"))


def disjoint_union(lanes: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All rows whose key one lane alone has, and the keys that several claim."""
    every = reduce(DataFrame.unionByName, [lane.withColumn("lane", F.lit(i)) for i, lane in enumerate(lanes)])
    claimed = every.groupBy(key).agg(F.countDistinct("lane").alias("lanes")).where("lanes > 1").select(key)
    return every.join(claimed, key, "left_anti"), claimed


def source_exclusions(strata: DataFrame, key: str, source: str) -> DataFrame:
    """key, excluded, odds_ratio, z, p and a of Mantel-Haenszel estimates without each source in turn.

    ``strata``: key, source, stratum, a, a_total, c, c_total. Strata are counts, so each
    exclusion is another pass over a small table; sources are the few of the catalogue.
    """
    sources = strata.select(F.col(source).alias("excluded")).distinct()
    left = strata.crossJoin(F.broadcast(sources)).where(F.col(source) != F.col("excluded"))
    merged = left.groupBy(key, "excluded", "stratum").agg(*[F.sum(c).alias(c) for c in ("a", "a_total", "c", "c_total")])
    observed = merged.groupBy(key, "excluded").agg(F.sum("a").alias("a"))
    return mantel_haenszel(merged, [key, "excluded"]).join(observed, [key, "excluded"]).select(key, "excluded", "a", "z", "p", "odds_ratio", "or_lower", "or_upper")


def stability(whole: DataFrame, exclusions: DataFrame, key: str, least: int = 25) -> DataFrame:
    """key, status: stable if each exclusion keeps the direction, an interval off 1 and enough cases; single_source_only with fewer than two."""
    both = exclusions.join(whole.select(key, F.col("odds_ratio").alias("_or")), key)
    ok = (F.col("a") >= least) & ((F.col("odds_ratio") > 1) == (F.col("_or") > 1)) & ((F.col("or_lower") > 1) | (F.col("or_upper") < 1))
    n = both.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("passed"))
    return n.select(key, F.when(F.col("n") < 2, "single_source_only").when(F.col("n") == F.col("passed"), "stable").otherwise("sensitive").alias("status"))


def findings(cells: DataFrame) -> Column:
    """Whether a compared cell is worth telling: cases, size of effect, expectation, strength and q."""
    big = (F.abs(F.col("difference")) >= 0.02) | (F.col("ratio") >= 1.25) | (F.col("ratio") <= 0.8)
    return (F.col("n") >= 25) & big & (F.col("expected") >= 10) & (F.col("cramers_v") >= 0.10) & (F.col("q") <= 0.05)


def classify_segments(segs: DataFrame, sites: DataFrame, km: float, size: float) -> DataFrame:
    """trace_id, class: between (both ends near a site), start, end or none.

    ``sites``: id, lat, lon. Each end is tested once against the grid, not each
    segment against each site.
    """
    spread = sites.select(F.col("id").alias("_site"), F.col("lat").alias("_y"), F.col("lon").alias("_x"), F.explode(grid_cells(F.col("lat"), F.col("lon"), km, size)).alias("_cell"))
    ends = segs.select("trace_id", F.explode(F.array(F.struct(F.lit("start").alias("which"), F.col("from_lat").alias("lat"), (F.pmod(F.col("from_lon") + 180, F.lit(360.0)) - 180).alias("lon")), F.struct(F.lit("end").alias("which"), F.col("to_lat").alias("lat"), (F.pmod(F.col("to_lon") + 180, F.lit(360.0)) - 180).alias("lon")))).alias("e")).select("trace_id", "e.*")
    near = ends.withColumn("_cell", grid_cell(F.col("lat"), F.col("lon"), size)).join(spread, "_cell").where(haversine_km(F.col("lat"), F.col("lon"), F.col("_y"), F.col("_x")) <= km)
    have = near.groupBy("trace_id").agg(F.max((F.col("which") == "start").cast("int")).alias("s"), F.max((F.col("which") == "end").cast("int")).alias("e"))
    label = F.when((F.col("s") == 1) & (F.col("e") == 1), "between").when(F.col("s") == 1, "start").when(F.col("e") == 1, "end").otherwise("none")
    return segs.select("trace_id").join(have, "trace_id", "left").select("trace_id", label.alias("class"))


def clip_segments(segs: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Segments with (enter, leave): the part of their great circle within a distance of a point, as fractions of their length.

    On the unit sphere the dot product with the point is a cos t + b sin t along the
    arc, so the ends of the part are solved for and need no search. In numpy: as
    Column expressions, pushed-down filters would repeat them beyond what compiles.
    """
    y, x = math.radians(lat), math.radians(lon)
    c = np.array([math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)])
    limit = math.cos(km / EARTH_KM)

    @F.pandas_udf("struct<enter:double,leave:double>")
    def part(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.DataFrame:
        def unit(a: pd.Series, b: pd.Series) -> np.ndarray:
            p, q = np.radians(a.to_numpy(float)), np.radians(b.to_numpy(float))
            return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)], axis=1)

        u, v = unit(lat1, lon1), unit(lat2, lon2)
        cos_d = np.clip((u * v).sum(axis=1), -1, 1)
        d = np.arccos(cos_d)
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = u @ c, ((v - u * cos_d[:, None]) / np.sin(d)[:, None]) @ c
            reach = np.hypot(a, b)
            half = np.arccos(np.minimum(1, limit / reach))
            low, high = np.maximum(0, (np.arctan2(b, a) - half) / d), np.minimum(1, (np.arctan2(b, a) + half) / d)
            fine = (d > 0) & (reach >= limit) & (low <= high)
        return pd.DataFrame({"enter": np.where(fine, low, np.nan), "leave": np.where(fine, high, np.nan)})

    got = segs.withColumn("_p", part("from_lat", "from_lon", "to_lat", "to_lon"))
    return got.where("_p.enter is not null and not isnan(_p.enter)").select(*segs.columns, "_p.enter", "_p.leave")


def year_controls(left: DataFrame, right: DataFrame, days: int, km: float, size: float, first: str, last: str) -> DataFrame:
    """left_id, observed, controls, expected: neighbours in a window against the same dates one and two years off.

    A row is no neighbour of its own. Only left rows all of whose windows lie inside the period count; expected is the
    controls' mean.
    """
    from nightloom.operators.proximity import day_window_pairs

    shifts = (0, -24, -12, 12, 24)
    at = left.select("id", "lat", "lon", F.explode(F.array(*[F.struct(F.lit(m).alias("shift"), F.add_months("day", m).alias("day")) for m in shifts])).alias("x")).select("id", "lat", "lon", "x.*")
    whole = at.groupBy("id").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where((F.date_add("lo", -days) >= F.lit(first).cast("date")) & (F.date_add("hi", days) <= F.lit(last).cast("date"))).select("id")
    keyed = at.join(whole, "id").select(F.struct("id", "shift").alias("id"), "day", "lat", "lon")
    n = day_window_pairs(keyed, right, days, km, size).where("left_id.id <> right_id").groupBy(F.col("left_id.id").alias("left_id")).agg(F.count_if(F.col("left_id.shift") == 0).alias("observed"), F.count_if(F.col("left_id.shift") != 0).alias("controls"))
    full = whole.select(F.col("id").alias("left_id")).join(n, "left_id", "left").fillna(0, ["observed", "controls"])
    return full.withColumn("expected", F.col("controls") / (len(shifts) - 1))


def coordinate_piles(rows: DataFrame, decimals: int, least: int) -> DataFrame:
    """lat, lon, n of positions, rounded, that ``least`` rows share."""
    return rows.groupBy(F.round("lat", decimals).alias("lat"), F.round("lon", decimals).alias("lon")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rehydrate(groups: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Groups without a position take that of their member of the highest rank: members have key, lat, lon, rank."""
    best = members.where("lat is not null and lon is not null").groupBy(key).agg(F.max_by(F.struct("lat", "lon"), "rank").alias("_at"))
    return groups.join(best, key, "left").withColumns({"lat": F.coalesce("lat", "_at.lat"), "lon": F.coalesce("lon", "_at.lon"), "rehydrated": F.col("lat").isNull() & F.col("_at").isNotNull()}).drop("_at")


def build_grams(rows: DataFrame, key: str, column: str, n: int = 3) -> DataFrame:
    """gram, id: distinct character n-grams of lower-cased texts."""
    low = F.lower(F.col(column))
    grams = F.when(F.length(low) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))))
    return rows.select(F.col(key).alias("id"), F.explode(grams).alias("gram"))


def gram_candidates(grams: DataFrame, term: str, n: int = 3) -> DataFrame:
    """Ids that have every n-gram of a term: a superset of those that contain it."""
    wanted = sorted({term.lower()[i : i + n] for i in range(len(term) - n + 1)})
    return grams.where(F.col("gram").isin(*wanted)).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).select("id")


def fragment_table(postings: DataFrame, fragments: list[str]) -> DataFrame:
    """fragment, id for common word fragments, so that a search need not scan the lexicon."""
    lists = F.array(*[F.lit(f) for f in fragments])
    return postings.select("id", F.explode(F.filter(lists, lambda f: F.contains(F.col("token"), f))).alias("fragment")).distinct()


def zone_of_place(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """id, zone: the zone of the alias that a text holds as a word, states before countries; none where two differ.

    ``aliases``: alias, kind (state, country), zone.
    """
    words = rows.select("id", F.explode(F.array_distinct(F.split(F.lower(F.col(column)), "[^a-z]+"))).alias("alias"))
    hit = words.join(aliases, "alias").groupBy("id", "kind").agg(F.min("zone").alias("zone"), F.max("zone").alias("_z"))
    sure = hit.where(F.col("zone") == F.col("_z")).groupBy("id").agg(F.min_by("zone", F.when(F.col("kind") == "state", 0).otherwise(1)).alias("zone"))
    return sure
