"""Sky exposure, sensitivity, segments against sites, decisions and indexes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.stats import mantel_haenszel
from nightloom.operators import review, search, sky
from nightloom.plans.base import REPORTS_SQL, haversine_sql, reports
from nightloom.plans.spatial import _ORDERS_SQL, _mapped, _orders, _segs
from nightloom.plans.statistics import _rounded
from nightloom.session import cut, table


def _sky(spark: SparkSession) -> DataFrame:
    return sky.day_table(spark, dt.date(1995, 1, 1), dt.date(2001, 12, 31))


def planet_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sky.sky_exposure(sky.fold(_orders(spark, sf_dir), "day", "source"), _sky(spark), F.col("sign").cast("string")))


def planet_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sky.sky_exposure(sky.fold(_orders(spark, sf_dir), "day"), _sky(spark), F.col("motion")))


def planet_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = sky.fold(_orders(spark, sf_dir), "day")
    return sky.aspects(_sky(spark)).join(daily, "day").groupBy("pair", "aspect").agg(F.sum("n").alias("n"), F.count("*").alias("days"))


def _source_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("key"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("source"), F.year("l_shipdate").alias("stratum"), (F.col("l_returnflag") == "R").alias("active"), (F.col("l_quantity") > 25).alias("hit"))
    return li.groupBy("key", "source", "stratum").agg(F.count_if(F.col("active") & F.col("hit")).alias("a"), F.count_if("active").alias("a_total"), F.count_if(~F.col("active") & F.col("hit")).alias("c"), F.count_if(~F.col("active")).alias("c_total"))


def source_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(review.source_exclusions(_source_strata(spark, sf_dir), "key", "source").select("key", "excluded", "a", "z", "odds_ratio"), 4)


def source_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _source_strata(spark, sf_dir)
    whole = mantel_haenszel(s.groupBy("key", "stratum").agg(*[F.sum(c).alias(c) for c in ("a", "a_total", "c", "c_total")]), ["key"])
    return review.stability(whole, review.source_exclusions(s, "key", "source"), "key")


def segment_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "place_ref").select(F.col("place_id").alias("id"), "lat", "lon")
    return review.classify_segments(_segs(spark, sf_dir), p, 400.0, 5.0).groupBy("class").agg(F.count("*").alias("n"))


def clipped_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(review.clip_segments(_segs(spark, sf_dir), 0.0, 0.0, 3000.0).select("trace_id", "enter", "leave"))


def same_season_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cut(_mapped(spark, sf_dir))
    return _rounded(review.year_controls(m, m, 90, 500.0, 5.0, "1980-01-01", "2024-12-31"))


def decision_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "compact_record").select(F.lower("input_id").alias("id"))
    said = table(spark, sf_dir, "match_pair").select(F.lower(F.trim("left_input_id")).alias("id"), F.col("verdict").alias("decision")).where("id is not null")
    _, problems = review.apply_decisions(queue, said, "id", ["same", "different"])
    return problems.groupBy("problem").agg(F.count("*").alias("n"))


def merge_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record")
    return review.key_opportunities(c, {"event": F.lower(F.trim("event_id")), "text": F.col("text_hash"), "night": F.concat_ws("|", "date_iso", "location_key")})


def lanes_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    kept, claimed = review.disjoint_union([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 5 = 0")], "o_orderkey")
    return kept.groupBy("lane").agg(F.count("*").alias("n")).union(claimed.agg(F.lit(-1).alias("lane"), F.count("*").alias("n")))


def coordinate_piles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coordinate_piles(reports(spark, sf_dir).where("lat is not null"), 1, 10)


def rehydrated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "event_provenance").select("event_id", "canonical_input_id").dropna().distinct()
    r = reports(spark, sf_dir).select(F.col("event_id").alias("canonical_input_id"), "lat", "lon", F.struct((F.col("coordinate_source") == "source_coordinates").alias("own"), F.col("event_id").alias("i")).alias("rank"))
    heads = p.groupBy("event_id").agg(F.min("canonical_input_id").alias("canonical_input_id")).join(r.drop("rank"), "canonical_input_id")
    got = review.rehydrate(heads, p.join(r, "canonical_input_id"), "event_id")
    return got.groupBy("rehydrated").agg(F.count("*").alias("n"), F.count("lat").alias("mapped"))


def gram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ids = review.gram_candidates(review.build_grams(d, "doc_id", "text"), "grass lay")
    return d.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").where(F.contains(F.lower("text"), F.lit("grass lay"))).select("doc_id")


def fragment_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return review.fragment_table(search.build_postings(d, "doc_id", "text"), ["light", "horse", "ing"]).groupBy("fragment").agg(F.count("*").alias("n"))


def place_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("arizona", "state", "America/Phoenix"), ("az", "state", "America/Phoenix"), ("texas", "state", "America/Chicago"), ("usa", "country", "America/New_York"), ("norway", "country", "Europe/Oslo")], "alias string, kind string, zone string")
    r = reports(spark, sf_dir).where("location is not null").select(F.col("event_id").alias("id"), "location")
    return review.zone_of_place(r, aliases, "location")


QUERIES = {f.__name__: f for f in (
    planet_signs, planet_motion, planet_aspects, source_exclusions, source_stability, segment_classes, clipped_segments, same_season_controls, decision_problems, merge_opportunities, lanes_apart, coordinate_piles,
    rehydrated_events, gram_search, fragment_hits, place_zones,
)}

SQL = {
    "source_exclusions": """with s as (select l_linestatus as key, 's' || (l_suppkey % 4) as source, year(l_shipdate) as stratum, count(*) filter (l_returnflag = 'R' and l_quantity > 25) as a, count(*) filter (l_returnflag = 'R') as n1, count(*) filter (l_returnflag <> 'R' and l_quantity > 25) as c, count(*) filter (l_returnflag <> 'R') as n0 from lineitem group by 1, 2, 3),
        x as (select key, e.source as excluded, stratum, sum(a)::double as a, sum(n1)::double as n1, sum(c)::double as c, sum(n0)::double as n0 from s, (select distinct source from s) e where s.source <> e.source group by 1, 2, 3), t as (select key, excluded, sum(a) as all_a from x group by 1, 2),
        k as (select *, n1 + n0 as n, a + c as m from x where n1 > 0 and n0 > 0), g as (select key, excluded, sum(a) as o, sum(n1 * m / n) as e, sum(case when n > 1 then n1 * n0 * m * (n - m) / (n * n * (n - 1)) else 0 end) as v, sum(a * (n0 - c) / n) as r, sum((n1 - a) * c / n) as s from k group by 1, 2)
        select key, excluded, all_a as a, round(case when v > 0 then (o - e) / sqrt(v) else 0 end, 4) as z, round(case when s > 0 then r / s end, 4) as odds_ratio from g join t using (key, excluded)""",
    "segment_classes": f"""with {_ORDERS_SQL}, e as (select trace_id, 1 as w, from_lat as lat, from_lon as lon from seg union all select trace_id, 2, to_lat, to_lon from seg), h as (select trace_id, max((w = 1)::int) as s, max((w = 2)::int) as e from e, place_ref p where abs(e.lat - p.lat) < 4 and {haversine_sql('e.lat', 'e.lon', 'p.lat', 'p.lon')} <= 400 group by 1)
        select case when s = 1 and e = 1 then 'between' when s = 1 then 'start' when e = 1 then 'end' else 'none' end as class, count(*) as n from seg left join h using (trace_id) group by 1""",
    "clipped_segments": f"""with {_ORDERS_SQL}, u as (select trace_id, radians(from_lat) as p, radians(from_lon) as q, radians(to_lat) as r, radians(to_lon) as s from seg), v as (select trace_id, cos(p) * cos(q) as ux, cos(r) * cos(s) as vx, acos(greatest(-1, least(1, cos(p) * cos(q) * cos(r) * cos(s) + cos(p) * sin(q) * cos(r) * sin(s) + sin(p) * sin(r)))) as d from u),
        w as (select trace_id, d, ux as a, (vx - ux * cos(d)) / sin(d) as b from v where d > 0), k as (select *, sqrt(a * a + b * b) as m, atan2(b, a) as t from w), h as (select *, acos(least(1, cos(3000 / 6371.0088) / m)) as f from k where m >= cos(3000 / 6371.0088)), e as (select trace_id, greatest(0, (t - f) / d) as enter, least(1, (t + f) / d) as leave from h)
        select trace_id, round(enter, 5) as enter, round(leave, 5) as leave from e where enter <= leave""",
    "same_season_controls": f"""with {REPORTS_SQL}, m as (select event_id as id, day, lat, lon, source from reports where lat is not null and day is not null), l as (select id, lat, lon, k, cast(day + to_months(k) as date) as day from m, (values (0), (-24), (-12), (12), (24)) t(k)),
        w as (select id from l group by 1 having min(day) - 90 >= date '1980-01-01' and max(day) + 90 <= date '2024-12-31'), j as (select l.id, k from l join w using (id) join m r on r.id <> l.id and abs(l.day - r.day) <= 90 and {haversine_sql('l.lat', 'l.lon', 'r.lat', 'r.lon')} <= 500)
        select id as left_id, count(k) filter (k = 0) as observed, count(k) filter (k <> 0) as controls, round(count(k) filter (k <> 0) / 4, 5) as expected from w left join j using (id) group by 1""",
    "decision_problems": """with d as (select lower(trim(left_input_id)) as id, min(lower(trim(verdict))) as a, max(lower(trim(verdict))) as b, count(*) filter (lower(trim(verdict)) not in ('same', 'different')) as bad from match_pair where left_input_id is not null group by 1),
        p as (select case when id not in (select lower(input_id) from compact_record) then 'unknown_key' when bad > 0 then 'invalid_decision' when a <> b then 'contradiction' end as problem from d) select problem, count(*) as n from p where problem is not null group by 1""",
    "merge_opportunities": """with k as (select 'event' as family, lower(trim(event_id)) as key from compact_record union all select 'text', text_hash from compact_record union all select 'night', concat_ws('|', date_iso, location_key) from compact_record),
        g as (select family, key, count(*) as n from k where trim(key) <> '' group by 1, 2 having count(*) > 1) select family, count(*) as groups, sum(n) as records, sum(n - 1) as removable from g group by 1""",
    "lanes_apart": """with c as (select o_orderkey as k, (o_orderkey % 2 = 0)::int + (o_orderkey % 3 = 0)::int + (o_orderkey % 5 = 0)::int as lanes from orders) select case when lanes > 1 then -1 when k % 2 = 0 then 0 when k % 3 = 0 then 1 else 2 end as lane, count(*) as n from c where lanes > 0 group by 1""",
    "coordinate_piles": f"with {REPORTS_SQL} select round(lat, 1) as lat, round(lon, 1) as lon, count(*) as n from reports where lat is not null group by 1, 2 having count(*) >= 10",
    "rehydrated_events": f"""with {REPORTS_SQL}, p as (select distinct event_id as e, canonical_input_id as id from event_provenance where event_id is not null and canonical_input_id is not null), h as (select e, min(id) as id from p group by 1), b as (select e, count(lat) as n from p join reports r on r.event_id = p.id group by 1)
        select r.lat is null and coalesce(b.n, 0) > 0 as rehydrated, count(*) as n, count(*) filter (r.lat is not null or b.n > 0) as mapped from h join reports r on r.event_id = h.id left join b using (e) group by 1""",
    "gram_search": "select doc_id from documents where contains(lower(text), 'grass lay')",
    "fragment_hits": r"with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as token from documents) select f as fragment, count(distinct doc_id) as n from t, (values ('light'), ('horse'), ('ing')) v(f) where contains(token, f) group by 1",
    "place_zones": f"""with {REPORTS_SQL}, a(alias, kind, zone) as (values ('arizona', 'state', 'America/Phoenix'), ('az', 'state', 'America/Phoenix'), ('texas', 'state', 'America/Chicago'), ('usa', 'country', 'America/New_York'), ('norway', 'country', 'Europe/Oslo')),
        w as (select distinct event_id as id, unnest(regexp_split_to_array(lower(location), '[^a-z]+')) as alias from reports where location is not null), h as (select id, kind, min(zone) as zone from w join a using (alias) group by 1, 2 having min(zone) = max(zone))
        select id, arg_min(zone, case when kind = 'state' then 0 else 1 end) as zone from h group by 1""",
}
