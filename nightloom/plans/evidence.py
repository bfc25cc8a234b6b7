"""Co-occurrence, exposure lanes, votes, cross-tabs and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators import evidence, proximity
from nightloom.plans.base import EVENTS_SQL, REPORTS_SQL, haversine_sql, reports, stream_events
from nightloom.plans.spatial import _FACILITIES
from nightloom.plans.statistics import _P_SQL, _rounded
from nightloom.session import cut, table


def _night(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(reports(spark, sf_dir).where("lat is not null and day is not null and craft is not null").select(F.col("event_id").alias("id"), "day", "lat", "lon", "craft", "source"))


def craft_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _night(spark, sf_dir)
    edges = proximity.day_window_pairs(r, r, 365, 300.0, 5.0).where("left_id < right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return evidence.exposure_matrix(edges, r.select("id", F.col("craft").alias("label")))


def craft_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _night(spark, sf_dir)
    edges = proximity.day_window_pairs(r, r, 365, 300.0, 5.0).where("left_id < right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return _rounded(evidence.cooccurrence(edges, r, "source", "craft"))


def facility_lane_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("lat is not null and craft is not null")
    f = table(spark, sf_dir, "facility_point").where("lat is not null and not isnan(lat) and abs(lat) <= 90 and lon is not null and not isnan(lon) and abs(lon) <= 180").select(F.col("facility_source").alias("id"), "lat", "lon")
    d = proximity.near_pairs(r.select(F.col("event_id").alias("id"), "lat", "lon"), f, 250.0, 10.0).groupBy("left_id").agg(F.min("km").alias("km"))
    return _rounded(evidence.facility_lane(d.join(r, d["left_id"] == r["event_id"]).select("craft", "source", "km"), "craft", "source"), 4)


def craft_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "event_provenance").select("event_id", "canonical_input_id").distinct()
    r = reports(spark, sf_dir).select(F.col("event_id").alias("canonical_input_id"), "craft")
    return evidence.majority_vote(p.join(r, "canonical_input_id"), "event_id", "craft")


def token_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record").where("tokens is not null").select("input_id", F.filter("tokens", lambda t: t.isin("beam", "horses", "whistle", "siren")).alias("things"), F.filter("tokens", lambda t: t.isin("amber", "teal", "white", "silver", "copper")).alias("colours"))
    return evidence.list_crosstab(c, "input_id", "things", "colours")


def lane_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.lane_pairs(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


def period_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("a"), F.when(F.col("l_linenumber") != 3, F.date_add(F.to_date("l_shipdate"), F.col("l_linenumber"))).alias("b"))
    return evidence.period_counts(li, "a", "b", "month")


def reporting_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(evidence.delay_bin(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).alias("bin"), "o_orderpriority").groupBy("bin", "o_orderpriority").agg(F.count("*").alias("n"))


def lookup_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("lat is null and location is not null").select(F.lower("location").alias("query"), F.when(F.col("date_precision") == "day", 2).otherwise(1).alias("score"), "event_id")
    return evidence.worklist(r, "query", "score", "event_id", 3).select("query", "score", "n", "rank", F.array_join("sample", "|").alias("sample"))


def category_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_events(spark, sf_dir).select(F.col("event_id").alias("id"), "day", F.col("type").alias("category"), F.col("ts").alias("at"), "lat", "lon")
    both = e.union(e.withColumn("category", F.lit("all")))
    return evidence.category_connections(both, 2000.0).select("a", "b", F.array_join("categories", ",").alias("categories"))


def control_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    anchors = spark.createDataFrame([("t1", "1996-03-10"), ("t2", "1998-07-01"), ("t3", "1999-06-25"), ("t4", "2001-05-30")], "id string, day string").withColumn("day", F.col("day").cast("date"))
    return evidence.with_controls(days, anchors, 15, (-364, 364), "1995-01-01", "2001-08-01")


_RING = [(30.0, -115.0), (42.0, -118.0), (45.0, -95.0), (31.0, -90.0)]


def polygon_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).where(evidence.in_polygon(F.col("lat"), F.col("lon"), _RING)).select("event_id")


def raw_field_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").select("canonical_input_id", F.concat_ws(", ", *[F.concat(F.lit(f"{k}: "), F.lit('"'), F.col("raw_fields")[k], F.lit('"')) for k in ("row", "batch")]).alias("text")).distinct()
    m = evidence.key_values(F.col("text"))
    return c.select("canonical_input_id", m["row"].alias("row"), m["batch"].alias("batch"))


def share_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    token = evidence.encode_token(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))
    back = evidence.decode_token(F.col("token"), "name string, key int")
    return n.select("n_nationkey", token.alias("token")).select("n_nationkey", back["name"].alias("name"), back["key"].alias("key"), F.col("token").rlike("^v1[.][A-Za-z0-9_-]+$").alias("safe"))


def conflict_free_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record").where("date_iso <> '' and location_country_key <> ''").select(F.col("input_id").alias("id"), "date_iso", "location_country_key", F.nullif(F.col("location_region_key"), F.lit("")).alias("state"))
    k = evidence.group_keys(c, ["date_iso", "location_country_key"], "state", F.concat_ws("|", "date_iso", "location_country_key"))
    return k.groupBy("key").agg(F.count("*").alias("n"))


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    plan = s.where("s_suppkey % 3 = 1").select("s_suppkey", (F.col("s_suppkey") - 1).alias("into"))
    return evidence.apply_merges(s, plan, "s_suppkey")


QUERIES = {f.__name__: f for f in (
    craft_exposure, craft_cooccurrence, facility_lane_odds, craft_votes, token_crosstab, lane_cooccurrence, period_membership, reporting_delays, lookup_worklist, category_connections,
    control_windows, polygon_members, raw_field_pairs, share_tokens, conflict_free_keys, merged_rows,
)}

_NIGHT_SQL = f"{REPORTS_SQL}, m as (select event_id as id, day, lat, lon, craft, source from reports where lat is not null and day is not null and craft is not null)"


def _ring_sql() -> str:
    out = []
    for (y1, x1), (y2, x2) in zip(_RING, [*_RING[1:], _RING[0]], strict=True):
        out.append(f"case when ({y1} > lat) <> ({y2} > lat) and lon < {x1} + (lat - {y1}) * ({x2 - x1}::double / {y2 - y1}::double) then 1 else 0 end")
    return " + ".join(out)


SQL = {
    "craft_exposure": f"with {_NIGHT_SQL}, e as (select distinct l.id, l.craft as focal, r.craft as neighbour from m l join m r on l.id <> r.id and abs(l.day - r.day) <= 365 and {haversine_sql('l.lat', 'l.lon', 'r.lat', 'r.lon')} <= 300) select focal, neighbour, count(*) as n from e group by 1, 2",
    "facility_lane_odds": f"""with {REPORTS_SQL}, {_FACILITIES}, d as (select event_id, any_value(craft) as craft, any_value(source) as source, min({haversine_sql('r.lat', 'r.lon', 'f.lat', 'f.lon')}) as km from reports r, f where r.lat is not null and craft is not null and abs(r.lat - f.lat) < 2.5 group by 1),
        l as (select craft, source, km <= 25 as near from d where km <= 25 or km between 100 and 250), t as (select source, count(*) filter (near) as na, count(*) filter (not near) as nc from l group by 1), g as (select craft, t.source, na, nc, (select count(*) from l where l.craft = k.craft and l.source = t.source and near) as a, (select count(*) from l where l.craft = k.craft and l.source = t.source and not near) as c from (select distinct craft from l) k, t where na > 0 and nc > 0),
        s as (select craft, a::double as x, (na - a)::double as b, c::double as c, (nc - c)::double as d, na::double as n1, nc::double as n0, (a + c)::double as m, (na + nc)::double as n from g),
        q as (select craft, count(*) as strata, sum(x) as o, sum(n1 * m / n) as e, sum(case when n > 1 then n1 * n0 * m * (n - m) / (n * n * (n - 1)) else 0 end) as v, sum(x * d / n) as r, sum(b * c / n) as s, sum((x + d) / n * x * d / n) as pr, sum((x + d) / n * b * c / n + (b + c) / n * x * d / n) as ps, sum((b + c) / n * b * c / n) as qs, sum(n) as total from s group by 1),
        z as (select *, case when v > 0 then (o - e) / sqrt(v) else 0 end as z, sqrt(pr / nullif(2 * r * r, 0) + ps / nullif(2 * r * s, 0) + qs / nullif(2 * s * s, 0)) as se from q)
        select craft, strata, round(z, 4) as z, round({_P_SQL}, 4) as p, round(case when s > 0 then r / s end, 4) as odds_ratio, round(case when r > 0 and s > 0 then exp(ln(r / s) - 1.959963984540054 * se) end, 4) as or_lower, round(case when r > 0 and s > 0 then exp(ln(r / s) + 1.959963984540054 * se) end, 4) as or_upper, round(sqrt(z * z / total), 4) as cramers_v from z""",
    "craft_votes": f"""with {REPORTS_SQL}, v as (select p.event_id, craft, count(*) as n from (select distinct event_id, canonical_input_id from event_provenance) p join reports r on r.event_id = p.canonical_input_id where craft is not null group by 1, 2), t as (select *, max(n) over (partition by event_id) as m, count(*) over (partition by event_id) as k from v), q as (select event_id, m, max(k) as k, count(*) filter (n = m) as leaders, max(case when n = m then craft end) as c from t group by 1, 2)
        select event_id, case when leaders = 1 then c end as craft, m as votes, case when leaders > 1 then 'blocked' when k > 1 then 'conflict' else 'agreed' end as status from q""",
    "token_crosstab": "with t as (select distinct input_id, unnest(tokens) as w from compact_record) select a.w as things, b.w as colours, count(*) as n from t a join t b using (input_id) where a.w in ('beam', 'horses', 'whistle', 'siren') and b.w in ('amber', 'teal', 'white', 'silver', 'copper') group by 1, 2",
    "lane_cooccurrence": 'with l as (select distinct o_custkey, o_orderpriority as p from orders) select a.p as "left", b.p as "right", count(*) as sites from l a join l b on a.o_custkey = b.o_custkey and a.p < b.p group by 1, 2',
    "period_membership": "with i as (select cast(l_shipdate as date) as a, case when l_linenumber <> 3 then cast(l_shipdate as date) + l_linenumber end as b from lineitem) select case when a is null or b is null then 'unknown' when date_trunc('month', a) <> date_trunc('month', b) then 'ambiguous' else cast(cast(date_trunc('month', a) as date) as varchar) end as period, count(*) as n from i group by 1",
    "reporting_delays": """with d as (select cast(l_shipdate as date) - cast(o_orderdate as date) as d, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey)
        select case when d < 0 then 'negative' when d <= 0 then 'same_day' when d <= 7 then 'up_to_week' when d <= 30 then 'up_to_month' when d <= 90 then 'up_to_quarter' when d <= 365 then 'up_to_year' when d <= 1826 then 'up_to_5_years' when d <= 3652 then 'up_to_10_years' when d is not null then 'over_10_years' end as bin, o_orderpriority, count(*) as n from d group by 1, 2""",
    "lookup_worklist": f"""with {REPORTS_SQL}, q as (select lower(location) as query, case when date_precision = 'day' then 2 else 1 end as score, event_id, row_number() over (partition by lower(location) order by event_id) as k from reports where lat is null and location is not null), t as (select query, sum(score) as score, count(*) as n, string_agg(event_id, '|' order by event_id) filter (k <= 3) as sample from q group by 1)
        select query, score, n, row_number() over (order by score desc, n desc, query) as rank, sample from t""",
    "category_connections": f"""with {EVENTS_SQL}, b as (select event_id as id, day, type as category, ts, lat, lon from ev union all select event_id, day, 'all', ts, lat, lon from ev), n as (select *, lead(id) over w as n_id, lead(lat) over w as n_lat, lead(lon) over w as n_lon from b window w as (partition by day, category order by ts, id))
        select least(id, n_id) as a, greatest(id, n_id) as b, string_agg(distinct category, ',' order by category) as categories from n where n_id is not null and {haversine_sql('lat', 'lon', 'n_lat', 'n_lon')} <= 2000 group by 1, 2""",
    "control_windows": """with a(id, day) as (values ('t1', date '1996-03-10'), ('t2', date '1998-07-01'), ('t3', date '1999-06-25'), ('t4', date '2001-05-30')), w as (select id as anchor, day + s as mid, case when s = 0 then 'test' else 'control' end as role from a, (values (0), (-364), (364)) t(s)),
        k as (select * from w where role = 'test' or (mid - 15 >= date '1995-01-01' and mid + 15 <= date '2001-08-01')), c as (select * from k where role = 'test' or not exists (select 1 from a where abs(a.day - k.mid) <= 30))
        select anchor, role, count(distinct mid) as windows, count(o_orderkey) as n from c left join orders on cast(o_orderdate as date) between mid - 15 and mid + 15 group by 1, 2""",
    "polygon_members": f"with {REPORTS_SQL} select event_id from reports where lat is not null and ({_ring_sql()}) % 2 = 1",
    "raw_field_pairs": "select distinct canonical_input_id, raw_fields['row'] as row, raw_fields['batch'] as batch from canonical_input",
    "share_tokens": "select n_nationkey, n_name as name, n_nationkey as key, true as safe from nation",
    "conflict_free_keys": "with c as (select date_iso || '|' || location_country_key as key, nullif(location_region_key, '') as s from compact_record where date_iso <> '' and location_country_key <> '') select key, count(*) as n from c group by 1 having count(distinct s) <= 1",
    "merged_rows": "select s_suppkey, s_name, (exists (select 1 from supplier x where x.s_suppkey % 3 = 1 and x.s_suppkey - 1 = s.s_suppkey))::int as merged from supplier s where s_suppkey % 3 <> 1",
}
