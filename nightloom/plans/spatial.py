"""Sequences, proximity, deduplication and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.geo import equal_area_cell, mercator_pixel, solar_minutes
from nightloom.operators import calendar, dedupe, evidence, graph, proximity, sequence
from nightloom.plans.base import EVENTS_SQL, REPORTS_SQL, haversine_sql, reports, stream_events
from nightloom.plans.statistics import _rounded
from nightloom.session import cut, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated events with a position from their keys."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("event_id"), "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("source"), (((k * 7919) % 17000).cast("double") / 100 - 85).alias("lat"), (((k * 104729) % 36000).cast("double") / 100 - 180).alias("lon")
    )


_ORDERS_SQL = """od as (select o_orderkey as event_id, o_custkey, cast(o_orderdate as date) as day, o_orderpriority as source, cast((o_orderkey * 7919) % 17000 as double) / 100 - 85 as lat, cast((o_orderkey * 104729) % 36000 as double) / 100 - 180 as lon from orders),
  nx as (select *, lead(event_id) over w as n_id, lead(day) over w as n_day, lead(lat) over w as n_lat, lead(lon) over w as n_lon, lead(source) over w as n_source from od window w as (partition by o_custkey order by day, cast(event_id as varchar))),
  seg as (select event_id || '->' || n_id as trace_id, event_id as from_id, n_id as to_id, lat as from_lat, lon as from_lon, n_lat as to_lat, lon + (((n_lon - lon + 180) - 360 * floor((n_lon - lon + 180) / 360)) - 180) as to_lon, day as from_day, n_day as to_day,
          abs(n_day - day) as gap_days, case when abs(n_day - day) <= 1 then 'gap_le_1' when abs(n_day - day) <= 2 then 'gap_le_2' when abs(n_day - day) <= 7 then 'gap_le_7' when abs(n_day - day) <= 30 then 'gap_le_30' else 'gap_gt_30' end as bucket, source || '->' || n_source as pair from nx where n_id is not null)"""


def _segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.segments(_orders(spark, sf_dir), ["o_custkey"], ["day"])


def segments_lead_gap_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segs(spark, sf_dir).select("trace_id", "gap_days", "bucket", "pair", F.round("to_lon", 6).alias("to_lon"))


def od_rollup_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sequence.od_rollup(_segs(spark, sf_dir)), 6)


def segments_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.global_segments(stream_events(spark, sf_dir), "ts").select("trace_id", "gap_days", "pair")


def same_day_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sequence.day_chains(stream_events(spark, sf_dir), "type", "ts"), 4)


def direction_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.direction_counts(_segs(spark, sf_dir))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.systematic_sample(stream_events(spark, sf_dir).select("event_id", "type", "ts"), ["type"], ["ts", "event_id"], 50).select("event_id", "type", "part", "weight")


def hop_traversal_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("event_id"))
    return sequence.walk(_segs(spark, sf_dir), seeds, 3)


def interval_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 30)
    ship = F.to_date("l_shipdate")
    return li.select(sequence.interval_order(start, end, F.date_add(ship, -2), F.date_add(ship, 2)).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def interval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).withColumn("at", F.unix_date("day"))
    spans = F.array(F.struct((F.lit(9500) + F.col("event_id") % 700).alias("start"), (F.lit(9900) + F.col("event_id") % 700).alias("end")), F.struct(F.lit(10800).cast("long").alias("start"), F.lit(11200).cast("long").alias("end")))
    return o.select(proximity.interval_state(F.col("at"), F.when(F.col("event_id") % 11 != 0, spans), 15).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).where("lat is not null and day is not null").select(F.col("event_id").alias("id"), "day", "lat", "lon", "craft")


def day_window_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cut(_mapped(spark, sf_dir))
    return _rounded(proximity.day_window_pairs(m, m, 400, 500.0, 5.0).where("left_id < right_id"), 4)


def first_later_day_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(proximity.first_later_nearest(cut(_mapped(spark, sf_dir)), 365, 300.0, 5.0), 4)


def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("lat is not null").select(F.col("event_id").alias("id"), "lat", "lon")
    f = table(spark, sf_dir, "facility_point").where("lat is not null and not isnan(lat) and abs(lat) <= 90 and lon is not null and not isnan(lon) and abs(lon) <= 180").select(F.concat_ws("#", "facility_key", F.round("lat", 5).cast("string"), F.round("lon", 5).cast("string")).alias("id"), "lat", "lon")
    n = proximity.nearest(proximity.near_pairs(r, f, 50.0, 2.0), "left_id", "right_id", "km")
    return n.select(F.round(F.floor("km"), 0).cast("int").alias("km"), F.lit(1).alias("one")).groupBy("km").agg(F.count("*").alias("n"))


def facility_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("lat is not null").select(F.col("event_id").alias("id"), "lat", "lon")
    f = table(spark, sf_dir, "facility_point").where("lat is not null and not isnan(lat) and abs(lat) <= 90 and lon is not null and not isnan(lon) and abs(lon) <= 180").select(F.col("facility_source").alias("id"), "lat", "lon")
    n = proximity.near_pairs(r, f, 250.0, 10.0).groupBy("left_id", "right_id").agg(F.min("km").alias("km"))
    return n.select("right_id", proximity.near_or_comparison(F.col("km")).alias("lane")).where("lane is not null").groupBy("right_id", "lane").agg(F.count("*").alias("n"))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("day is not null and lat is not null")
    return cut(sequence.segments(r, ["source", "craft"], ["day"]))


_CHAIN_SQL = f"""{REPORTS_SQL}, nx as (select *, lead(event_id) over w as n_id, lead(lat) over w as n_lat, lead(lon) over w as n_lon, lead(day) over w as n_day from reports where day is not null and lat is not null
  window w as (partition by source, craft order by day, event_id)), seg as (select event_id || '->' || n_id as trace_id, event_id as from_id, n_id as to_id, lat as y1, lon as x1, n_lat as y2, lon + (((n_lon - lon + 180) - 360 * floor((n_lon - lon + 180) / 360)) - 180) as x2, day as d1, n_day as d2, {haversine_sql('lat', 'lon', 'n_lat', 'n_lon')} as km from nx where n_id is not null)"""

_CROSS_SQL = f"""{_CHAIN_SQL}, t as (select seg.* replace (x1 + turn as x1, x2 + turn as x2) from seg, (values (-360.0::double), (0.0), (360.0)) v(turn)),
        q as (select a.trace_id as a, b.trace_id as b, a.x1, a.y1, a.km as km1, b.km as km2, a.x2 - a.x1 as rx, a.y2 - a.y1 as ry, b.x2 - b.x1 as sx, b.y2 - b.y1 as sy, b.x1 - a.x1 as px, b.y1 - a.y1 as py from seg a join t b on a.trace_id < b.trace_id and a.from_id <> b.from_id and a.from_id <> b.to_id and a.to_id <> b.from_id and a.to_id <> b.to_id),
        u as (select *, (px * sy - py * sx) / (rx * sy - ry * sx) as t, (px * ry - py * rx) / (rx * sy - ry * sx) as u from q where abs(rx * sy - ry * sx) > 1e-10), i as (select *, y1 + t * ry as lat, x1 + t * rx as x from u where least(t, u) > 1e-10 and greatest(t, u) < 1 - 1e-10 and least(t, 1 - t) * km1 >= 1 and least(u, 1 - u) * km2 >= 1),
        j as (select *, x - 360 * floor((x + 180) / 360) as lon, greatest(0.05, abs(cos(radians(lat)))) as k from i), n as (select a, b, lat, lon, degrees(acos(least(1.0, abs(rx * sx * k * k + ry * sy) / (sqrt(rx * rx * k * k + ry * ry) * sqrt(sx * sx * k * k + sy * sy))))) as angle from j), met as (select * from n where angle + 1e-10 >= 15)"""
_EQUAL_AREA = "'ea12x24:' || greatest(0, least(11, cast(floor((sin(radians(lat)) + 1) / 2 * 12) as bigint))) || ':' || greatest(0, least(23, cast(floor((lon + 180) / 360 * 24) as bigint)))"


def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(proximity.crossings(_chain(spark, sf_dir), buffer_km=1.0, least_angle=15.0), 4)


def crossing_cell_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = _chain(spark, sf_dir)
    met = cut(proximity.crossings(chain, buffer_km=1.0, least_angle=15.0).select("a", "b", "lat", "lon"))
    bands = chain.select(F.col("trace_id").alias("connector"), F.explode(F.array_distinct(F.array(*[F.floor(F.year(c) / 5) for c in ("from_day", "to_day")]))).alias("band"))
    return _rounded(evidence.crossing_cells(met, bands, cut(evidence.cell_opportunities(evidence.connector_cells(chain, 1.0)))))


def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "place_ref").select(F.col("place_id").alias("id"), "lat", "lon")
    return _rounded(proximity.points_along(_chain(spark, sf_dir), p, 40.0, 1.0), 4)


def equal_area_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).where("lat is not null").select(equal_area_cell(F.col("lat"), F.col("lon")).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


def viewport_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = mercator_pixel(F.col("lat"), F.col("lon"), 3)
    r = reports(spark, sf_dir).where("lat is not null").select("event_id", F.floor(x / 40).alias("gx"), F.floor(y / 40).alias("gy"))
    return r.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.min("event_id").alias("representative"))


def sunset_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_events(spark, sf_dir)
    return e.select("event_id", F.round(solar_minutes(F.col("day"), F.col("lat"), F.col("lon"), F.lit(0), rising=False), 3).alias("sunset"))


def day_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("lat is not null and day is not null").select(F.col("event_id").alias("id"), "day", "lat", "lon")
    return _rounded(proximity.day_forest(r, 3000.0), 4)


def calendar_exposure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.calendar_days(spark, "1995-01-01", "2001-12-31")
    return _rounded(calendar.exposure(_orders(spark, sf_dir), days, "day", F.weekday("day")))


def moon_phase_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = calendar.calendar_days(spark, "1995-01-01", "2001-12-31")
    return _rounded(calendar.exposure(_orders(spark, sf_dir), days, "day", calendar.moon_phase(F.col("day"))))


def exact_dedupe_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("t"))
    key = F.when(~F.col("t").rlike(r"^\s*$"), F.sha1("t"))
    return dedupe.exact_dedupe(d, key, F.struct(F.length("t").alias("n"), F.col("id").alias("i")), ["id", "source"]).select("id", "source", "members")


def record_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    f = dedupe.fingerprint(F.col("day").cast("string"), F.col("time_raw"), F.col("location"), F.col("description"))
    return r.select("source", f.isNotNull().alias("has"), f.alias("f")).groupBy("source").agg(F.count_if("has").alias("fingerprints"), F.countDistinct("f").alias("distinct_fingerprints"))


def multi_key_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record").select(F.col("input_id").alias("id"), F.lower(F.trim("event_id")).alias("e"), F.when(F.trim("text_hash") != "", F.col("text_hash")).alias("h"), F.when((F.trim("date_iso") != "") & (F.trim("time_key") != ""), F.concat_ws("|", "date_iso", "time_key", "shape_key")).alias("d"))
    g = dedupe.key_groups(c, {"event": F.col("e"), "text": F.col("h"), "night": F.col("d")})
    return g.select("id", "root", F.array_join("families", ",").alias("families"))


def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record").where("date_iso <> ''").select(F.col("input_id").alias("id"), "date_iso", "time_key", "shape_key", "location_region_key", "source_name")
    pairs = dedupe.blocked_pairs(c, ["date_iso"])
    side = lambda p: c.select(*[F.col(x).alias(f"{p}_{x}") for x in c.columns])
    both = pairs.join(side("l"), F.col("left_id") == F.col("l_id")).join(side("r"), F.col("right_id") == F.col("r_id"))
    score = dedupe.pair_score(
        date=(F.lit(True), 0.20, 0.0), time=(F.nullif(F.col("l_time_key"), F.lit("")) == F.nullif(F.col("r_time_key"), F.lit("")), 0.16, -0.04),
        region=(F.nullif(F.col("l_location_region_key"), F.lit("")) == F.nullif(F.col("r_location_region_key"), F.lit("")), 0.20, -0.08), shape=(F.nullif(F.col("l_shape_key"), F.lit("")) == F.nullif(F.col("r_shape_key"), F.lit("")), 0.20, -0.03), source=(F.col("l_source_name") == F.col("r_source_name"), 0.06, 0.04),
    )
    return both.select("left_id", "right_id", F.round(score, 4).alias("score"), dedupe.score_band(F.round(score, 4)).alias("band"))


def topk_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.top_per_group(candidate_scores(spark, sf_dir), ["band"], [F.desc("score"), F.col("left_id"), F.col("right_id")], 20)


def primary_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "match_pair").select(F.lower(F.trim("left_input_id")).alias("a"), F.lower(F.trim("right_input_id")).alias("b"), "score").where("a is not null and b is not null")
    return dedupe.best_per_pair(m, "a", "b", "score")


def verdict_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "match_pair").select(F.lower(F.trim("left_input_id")).alias("a"), F.lower(F.trim("right_input_id")).alias("b"))
    return graph.components(m).groupBy("root").agg(F.count("*").alias("members"))


def guarded_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    patches = base.where("p_partkey % 7 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit("stale")).alias("guard"), F.lit("Brand#fixed").alias("value"))
    return dedupe.guarded_overlay(base, patches, "p_partkey", "p_brand")


def gazetteer_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "place_ref").select(F.lower("city").alias("city"), "place_id")
    return dedupe.unique_matches(p, "city", "place_id")


def gazetteer_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return dedupe.dominant_match(o, "o_custkey", "o_orderpriority", "n", 2.0)


def lane_priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    exact = r.where("lat is not null and coordinate_source = 'source_coordinates'").select("event_id", F.lit("exact").alias("how"))
    near = r.where("lat is not null").select("event_id", F.lit("any").alias("how"))
    named = r.where("location is not null").select("event_id", F.lit("named").alias("how"))
    return dedupe.priority_union([exact, near, named], "event_id").groupBy("lane", "how").agg(F.count("*").alias("n"))


def source_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = dedupe.claims(table(spark, sf_dir, "canonical_input").select("canonical_input_id", "city", "country", "shape_raw", "type_raw"), "canonical_input_id", ["city", "country", "shape_raw", "type_raw"])
    return c.groupBy("field").agg(F.count("*").alias("claims"), F.countDistinct("claim_id").alias("ids"))


QUERIES = {f.__name__: f for f in (
    segments_lead_gap_bucket, od_rollup_levels, segments_global, same_day_chain, direction_sectors, systematic_sample, hop_traversal_k, interval_order, interval_state, day_window_radius_join, first_later_day_nearest,
    nearest_within, facility_classes, segment_crossings, crossing_cell_tiers, point_to_segment, equal_area_grid_counts, viewport_clusters, sunset_minutes, day_forest, calendar_exposure_ratio, moon_phase_exposure,
    exact_dedupe_fingerprint, record_fingerprints, multi_key_components, candidate_scores, topk_per_band, primary_record, best_pairs, verdict_components, guarded_patches, gazetteer_unique, gazetteer_dominant, lane_priority_union, source_claims,
)}

_FACILITIES = "f as (select facility_key, facility_source, lat, lon from facility_point where lat is not null and not isnan(lat) and abs(lat) <= 90 and lon is not null and not isnan(lon) and abs(lon) <= 180)"
_BEARING = "atan2(sin(radians(to_lon - from_lon)) * cos(radians(to_lat)), cos(radians(from_lat)) * sin(radians(to_lat)) - sin(radians(from_lat)) * cos(radians(to_lat)) * cos(radians(to_lon - from_lon)))"
_DAYS = "days as (select cast(range as date) as day from range(timestamp '1995-01-01', timestamp '2002-01-01', interval 1 day))"


def _exposure_sql(bin_of: str) -> str:
    return f"""with {_DAYS}, c as (select date_trunc('month', day) as month, {bin_of} as bin, count(*) as days from days group by all), s as (select date_trunc('month', day) as month, {bin_of} as bin, count(*) as n from (select cast(o_orderdate as date) as day from orders) group by all),
        e as (select bin, sum(m.n * c.days / a.days) as expected from c join (select month, sum(days) as days from c group by 1) a using (month) join (select month, sum(n) as n from s group by 1) m using (month) group by 1), o as (select bin, sum(n) as observed from s group by 1)
        select bin, coalesce(observed, 0) as observed, round(expected, 5) as expected, round(coalesce(observed, 0) / expected, 5) as ratio from e left join o using (bin)"""


def _cell_sql(lat: str, lon: str) -> str:
    return f"cast(floor((least({lat}, 89.999999) + 90) / size) as bigint) || ':' || cast(floor((({lon} + 180) - 360 * floor(({lon} + 180) / 360)) / size) as bigint)"


_SCORE_SQL = """c as (select input_id as id, date_iso, nullif(time_key, '') as t, nullif(shape_key, '') as s, nullif(location_region_key, '') as g, source_name from compact_record where date_iso <> ''),
  sc as (select l.id as left_id, r.id as right_id, round(least(1.0, greatest(0.0, 0.20 + case when l.t = r.t then 0.16 when l.t <> r.t then -0.04 else 0 end + case when l.g = r.g then 0.20 when l.g <> r.g then -0.08 else 0 end + case when l.s = r.s then 0.20 when l.s <> r.s then -0.03 else 0 end
    + case when l.source_name = r.source_name then 0.06 else 0.04 end)), 4)::double as score from c l join c r using (date_iso) where l.id < r.id), b as (select *, case when score >= 0.86 then 'auto' when score >= 0.72 then 'strong' when score >= 0.58 then 'review' else 'reject' end as band from sc)"""

SQL = {
    "segments_lead_gap_bucket": f"with {_ORDERS_SQL} select trace_id, gap_days, bucket, pair, round(to_lon, 6) as to_lon from seg",
    "od_rollup_levels": f"""with {_ORDERS_SQL}, l as (select *, {_cell_sql('from_lat', 'from_lon')} as origin, {_cell_sql('to_lat', 'to_lon')} as destination from seg, (values (10.0::double), (5.0), (2.5)) t(size))
        select size as level, origin, destination, bucket, count(*) as n, round(avg(from_lat), 6) as mean_from_lat, round(avg(to_lat), 6) as mean_to_lat, min(from_day) as first_day, max(to_day) as last_day from l group by 1, 2, 3, 4""",
    "segments_global": f"with {EVENTS_SQL}, n as (select event_id, day, source, lead(event_id) over w as n_id, lead(day) over w as n_day, lead(source) over w as n_source from ev window w as (order by day, ts, cast(event_id as varchar))) select event_id || '->' || n_id as trace_id, abs(n_day - day) as gap_days, source || '->' || n_source as pair from n where n_id is not null",
    "same_day_chain": f"with {EVENTS_SQL}, n as (select *, lead(event_id) over w as n_id, lead(lat) over w as n_lat, lead(lon) over w as n_lon from ev window w as (partition by day, type order by ts, cast(event_id as varchar))) select day, type, event_id as from_id, n_id as to_id, round({haversine_sql('lat', 'lon', 'n_lat', 'n_lon')}, 4) as km from n where n_id is not null and not (lat = n_lat and lon = n_lon)",
    "direction_sectors": f"with {_ORDERS_SQL}, b as (select degrees({_BEARING}) as d from seg where not (from_lat = to_lat and from_lon = to_lon)) select cast(floor(((d + 360) - 360 * floor((d + 360) / 360) + 22.5) / 45) as bigint) % 8 as sector, count(*) as n from b group by 1",
    "systematic_sample": f"with {EVENTS_SQL}, t as (select event_id, type, ntile(50) over w as part, row_number() over w as pos from ev window w as (partition by type order by ts, event_id)), s as (select *, min(pos) over (partition by type, part) as first_pos, count(*) over (partition by type, part) as weight from t) select event_id, type, part, weight from s where pos = first_pos + floor((weight - 1) / 2)",
    "hop_traversal_k": f"""with {_ORDERS_SQL}, f as (select from_id, arg_min(to_id, trace_id) as to_id, min(trace_id) as trace_id from seg group by 1), s1 as (select trace_id, to_id, 1 as hop from f where from_id in (select o_orderkey from orders where o_totalprice > 300000)),
        s2 as (select f.trace_id, f.to_id, 2 as hop from f where from_id in (select to_id from s1)), s3 as (select f.trace_id, f.to_id, 3 as hop from f where from_id in (select to_id from s2)) select trace_id, min(hop) as hop from (select * from s1 union all select * from s2 union all select * from s3) group by 1""",
    "interval_order": "with x as (select cast(o_orderdate as date) as a, cast(o_orderdate as date) + 30 as b, cast(l_shipdate as date) - 2 as c, cast(l_shipdate as date) + 2 as d from lineitem join orders on l_orderkey = o_orderkey) select case when a is null or c is null then 'unknown' when b < c then 'ordered' when d < a then 'reversed' else 'unknown' end as state, count(*) as n from x group by 1",
    "interval_state": f"with {_ORDERS_SQL}, x as (select event_id as e, (day - date '1970-01-01') as t, 9500 + event_id % 700 as a, 9900 + event_id % 700 as b from od) select case when e % 11 = 0 then 'unknown' when (t >= a + 15 and t <= b - 15) or (t >= 10815 and t <= 11185) then 'active' when (t >= a - 15 and t <= b + 15) or (t >= 10785 and t <= 11215) then 'unknown' else 'inactive' end as state, count(*) as n from x group by 1",
    "day_window_radius_join": f"with {REPORTS_SQL}, m as (select * from reports where lat is not null and day is not null), j as (select l.event_id as left_id, r.event_id as right_id, l.day - r.day as lag, {haversine_sql('l.lat', 'l.lon', 'r.lat', 'r.lon')} as km from m l, m r where l.event_id < r.event_id and abs(l.day - r.day) <= 400) select left_id, right_id, lag, round(km, 4) as km, case when lag < 0 then 'before' when lag > 0 then 'after' else 'same' end as phase from j where km <= 500",
    "first_later_day_nearest": f"with {REPORTS_SQL}, m as (select * from reports where lat is not null and day is not null), j as (select l.event_id as from_id, r.event_id as to_id, r.day - l.day as gap, {haversine_sql('l.lat', 'l.lon', 'r.lat', 'r.lon')} as km from m l join m r on r.day - l.day between 1 and 365), k as (select *, row_number() over (partition by from_id order by gap, km, to_id) as k from j where km <= 300) select from_id, to_id, gap, round(km, 4) as km from k where k = 1",
    "nearest_within": f"with {REPORTS_SQL}, {_FACILITIES}, j as (select event_id, min({haversine_sql('r.lat', 'r.lon', 'f.lat', 'f.lon')}) as km from reports r, f where r.lat is not null and abs(r.lat - f.lat) < 0.5 group by 1) select cast(floor(km) as int) as km, count(*) as n from j where km <= 50 group by 1",
    "facility_classes": f"with {REPORTS_SQL}, {_FACILITIES}, j as (select event_id, facility_source as right_id, min({haversine_sql('r.lat', 'r.lon', 'f.lat', 'f.lon')}) as km from reports r, f where r.lat is not null and abs(r.lat - f.lat) < 2.5 group by 1, 2) select right_id, case when km <= 25 then 'near' else 'comparison' end as lane, count(*) as n from j where km <= 25 or km between 100 and 250 group by 1, 2",
    "segment_crossings": f"with {_CROSS_SQL} select a, b, round(lat, 4) as lat, round(lon, 4) as lon, round(angle, 4) as angle from met",
    "crossing_cell_tiers": f"""with {_CROSS_SQL}, pts as (select {_EQUAL_AREA} as cell, a, b from met), l as (select cell, x, count(*) as n from (select cell, a as x from pts union all select cell, b from pts) group by 1, 2),
        k as (select cell, count(*) as connectors, max(n) as most from l group by 1), c as (select cell, count(*) as crossings from pts group by 1), p as (select cell, count(distinct band) as bands from l join (select trace_id as x, unnest([year(d1) // 5, year(d2) // 5]) as band from seg) using (x) group by 1),
        e as (select *, 1 / km as f0, greatest(2, ceil(greatest(abs(x2 - x1) / 360 * 24, abs(sin(radians(y2)) - sin(radians(y1))) / 2 * 12) * 3)) as n from seg where 1 / km < 0.5),
        g as (select trace_id, from_id, to_id, y1 + (y2 - y1) * (f0 + (1 - 2 * f0) * i / n) as lat, x1 + (x2 - x1) * (f0 + (1 - 2 * f0) * i / n) as x from e, range(0, 200) r(i) where i <= n), h as (select distinct {_EQUAL_AREA} as cell, trace_id, from_id, to_id from (select *, x - 360 * floor((x + 180) / 360) as lon from g)),
        m as (select cell, sum(m * (m - 1) // 2) as shared from (select cell, u, count(*) as m from (select cell, from_id as u from h union all select cell, to_id from h where from_id <> to_id) group by 1, 2) group by 1),
        o as (select cell, count(*) * (count(*) - 1) // 2 - any_value(shared) as opportunities from h join m using (cell) group by 1),
        w as (select sum(opportunities) as o, (select count(*) from met) as c from o)
        select cell, crossings, connectors, coalesce(bands, 0) as bands, round(most / crossings, 5) as share, case when crossings >= 20 and connectors >= 10 and bands >= 3 and most / crossings <= 0.35 then 'repeated_candidate' when crossings >= 5 and connectors >= 4 and most / crossings <= 0.6 then 'limited_candidate' else 'descriptive_only' end as tier,
        cast(coalesce(opportunities, 0) as bigint) as opportunities, round((crossings + 0.5) / (coalesce(opportunities, 0) * (w.c / w.o) + 0.5), 5) as lift from c join k using (cell) left join p using (cell) left join o using (cell), w""",
    "point_to_segment": f"""with {_CHAIN_SQL}, q as (select trace_id, place_id as id, cos(radians(p.lat)) * 111.195 as k, x1 + turn - p.lon as dx1, (y1 - p.lat) * 111.195 as ay, (y2 - p.lat) * 111.195 as b_y, x2 - x1 as w from seg, place_ref p, (values (-360.0::double), (0.0), (360.0)) v(turn)),
        r as (select trace_id, id, dx1 * k as ax, ay, dx1 * k + w * k as bx, b_y from q), t as (select *, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) as l from r), u as (select *, case when l > 0 then greatest(0, least(1, -(ax * (bx - ax) + ay * (b_y - ay)) / l)) else 0 end as f from t),
        v as (select trace_id, id, sqrt(pow(ax + f * (bx - ax), 2) + pow(ay + f * (b_y - ay), 2)) as km from u) select trace_id, id, round(min(km), 4) as km from v where km <= 40 group by 1, 2""",
    "equal_area_grid_counts": f"with {REPORTS_SQL} select 'ea12x24:' || greatest(0, least(11, cast(floor((sin(radians(lat)) + 1) / 2 * 12) as bigint))) || ':' || greatest(0, least(23, cast(floor(((case when lon = 180 then -180 else lon end) + 180) / 360 * 24) as bigint))) as cell, count(*) as n from reports where lat is not null group by 1",
    "viewport_clusters": f"with {REPORTS_SQL}, p as (select event_id, cast(floor((lon + 180) / 360 * 2048 / 40) as bigint) as gx, radians(greatest(-85.05112878, least(85.05112878, lat))) as phi from reports where lat is not null) select gx, cast(floor((1 - ln(tan(phi) + 1 / cos(phi)) / 3.141592653589793) / 2 * 2048 / 40) as bigint) as gy, count(*) as n, min(event_id) as representative from p group by 1, 2",
    "sunset_minutes": f"""with {EVENTS_SQL}, g as (select event_id, lat, lon, 2 * 3.141592653589793 / 365 * (dayofyear(day) - 1) as g, radians(lat) as phi from ev), e as (select *, 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) as eq,
        0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) as dec from g), h as (select *, cos(radians(90.833)) / (cos(phi) * cos(dec)) - tan(phi) * tan(dec) as c from e),
        m as (select event_id, 720 - 4 * (lon - degrees(acos(case when abs(c) <= 1 then c end))) - eq as m from h) select event_id, round(m - 1440 * floor(m / 1440), 3) as sunset from m""",
    "calendar_exposure_ratio": _exposure_sql("isodow(day) - 1"),
    "moon_phase_exposure": _exposure_sql("cast(floor((((day - date '1970-01-01') + 0.5 - 10962.759722::double) - 29.530588853::double * floor(((day - date '1970-01-01') + 0.5 - 10962.759722::double) / 29.530588853::double)) / 29.530588853::double * 8 + 0.5) as int) % 8"),
    "exact_dedupe_fingerprint": "with d as (select doc_id as id, source, text as t from documents), k as (select *, coalesce(case when not regexp_matches(t, '^\\s*$') then sha1(t) end, 'single_' || id) as key from d) select max(id) as id, arg_max(source, id) as source, count(*) as members from k group by key",
    "record_fingerprints": f"""with {REPORTS_SQL}, k as (select source, trim(regexp_replace(lower(coalesce(cast(day as varchar), '')), '[^a-z0-9]+', ' ', 'g')) as d, trim(regexp_replace(lower(coalesce(time_raw, '')), '[^a-z0-9]+', ' ', 'g')) as t, trim(regexp_replace(lower(coalesce(location, '')), '[^a-z0-9]+', ' ', 'g')) as l, trim(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9]+', ' ', 'g')) as x from reports)
        select source, count(*) filter (d <> '' and l <> '' and x <> '') as fingerprints, count(distinct case when d <> '' and l <> '' and x <> '' then d || '|' || t || '|' || l || '|' || x end) as distinct_fingerprints from k group by 1""",
    "multi_key_components": """with recursive k as (select input_id as id, 'event' as family, lower(trim(event_id)) as key from compact_record where trim(event_id) <> '' union all select input_id, 'text', text_hash from compact_record where trim(text_hash) <> ''
        union all select input_id, 'night', concat_ws('|', date_iso, time_key, shape_key) from compact_record where trim(date_iso) <> '' and trim(time_key) <> ''), h as (select family, key, min(id) as head from k group by 1, 2 having count(distinct id) > 1), m as (select id, family, head from k join h using (family, key)),
        e as (select id as u, head as v from m where id <> head union select head, id from m where id <> head), r(node, other) as (select distinct id, id from m union select r.node, e.v from r join e on e.u = r.other), c as (select node as id, min(other) as root from r group by 1), f as (select id, string_agg(distinct family, ',' order by family) as families from m group by 1)
        select id, root, families from c join f using (id)""",
    "candidate_scores": f"with {_SCORE_SQL} select left_id, right_id, score, band from b",
    "topk_per_band": f"with {_SCORE_SQL} select * from (select left_id, right_id, score, band, row_number() over (partition by band order by score desc, left_id, right_id) as rank from b) where rank <= 20",
    "primary_record": "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as k from orders) where k = 1",
    "best_pairs": "with m as (select lower(trim(left_input_id)) as x, lower(trim(right_input_id)) as y, score from match_pair) select least(x, y) as a, greatest(x, y) as b, max(score) as score from m where x is not null and y is not null group by 1, 2",
    "verdict_components": """with recursive m as (select lower(trim(left_input_id)) as a, lower(trim(right_input_id)) as b from match_pair), e as (select a as u, b as v from m where a is not null and b is not null and a <> b union select b, a from m where a is not null and b is not null and a <> b),
        r(node, other) as (select distinct u, u from e union select r.node, e.v from r join e on e.u = r.other), c as (select node, min(other) as root from r group by 1) select root, count(*) as members from c group by 1""",
    "guarded_patches": "select p_partkey, case when p_partkey % 14 = 0 then 'Brand#fixed' else p_brand end as p_brand, p_partkey % 14 = 0 as applied from part",
    "gazetteer_unique": "select lower(city) as city, min(place_id) as place_id from place_ref group by 1 having count(distinct place_id) = 1",
    "gazetteer_dominant": "with n as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2), r as (select *, row_number() over w as k, lead(n) over w as nn from n window w as (partition by o_custkey order by n desc, o_orderpriority)) select o_custkey, o_orderpriority from r where k = 1 and (nn is null or n >= nn * 2)",
    "lane_priority_union": f"with {REPORTS_SQL} select case when lat is not null and coordinate_source = 'source_coordinates' then 0 when lat is not null then 1 else 2 end as lane, case when lat is not null and coordinate_source = 'source_coordinates' then 'exact' when lat is not null then 'any' else 'named' end as how, count(*) as n from reports where lat is not null or location is not null group by 1, 2",
    "source_claims": "with c as (select distinct canonical_input_id, unnest(['city', 'country', 'shape_raw', 'type_raw']) as field, unnest([city, country, shape_raw, type_raw]) as value from canonical_input) select field, count(*) as claims, count(*) as ids from c where trim(value) <> '' group by 1",
}
