"""Field atlases, assessments and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.dates import clock_minutes
from nightloom.operators import atlas, cohort, document
from nightloom.operators.predicates import Filters
from nightloom.plans.application import Catalogue
from nightloom.plans.base import EVENTS_SQL, REPORTS_SQL, reports, stream_events
from nightloom.plans.spatial import _ORDERS_SQL, _segs
from nightloom.plans.statistics import _L1, _L2, _P_SQL, _U1, _U2, _rounded
from nightloom.plans.texts import _ONE
from nightloom.session import table


def evidence_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    always, never = F.lit(True), F.lit(False)
    t = atlas.atlas(r, "type", "source", {"craft": (F.col("craft"), always, F.col("date_precision") == "approximate"), "country": (F.col("country"), F.col("lat").isNotNull(), never)})
    return _rounded(atlas.atlas_cells(t.where("row is not null")))


def atlas_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    t = atlas.atlas(r, "type", "source", {"craft": (F.col("craft"), F.lit(True), F.col("date_precision") == "approximate"), "country": (F.col("country"), F.col("lat").isNotNull(), F.lit(False))})
    return t.groupBy("axis", "state").agg(F.sum("n").alias("n"))


def duration_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    return c.select("source_name", atlas.duration_seconds(F.col("duration_raw")).alias("seconds")).select("source_name", atlas.duration_bin(F.col("seconds")).alias("bin")).groupBy("source_name", "bin").agg(F.count("*").alias("n"))


def clock_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    return c.select("source_name", clock_minutes(F.col("time_raw")).alias("minutes")).select("source_name", atlas.clock_bin(F.col("minutes")).alias("bin")).groupBy("source_name", "bin").agg(F.count("*").alias("n"))


def bounded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_events(spark, sf_dir).select(F.col("event_id").alias("id"), "lat", "lon")
    got, size = atlas.clusters(e, 3, most=200)
    return got.agg(F.count("*").alias("cells"), F.sum("n").alias("points")).withColumn("cell_px", F.lit(size))


def neighbourhood_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("event_id"))
    return atlas.neighbourhood(_segs(spark, sf_dir), seeds, 2)


def similar_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.similar_segments(_segs(spark, sf_dir), 20.0)


def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.result_page(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "c_custkey", 77, 20)


def catalogue_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).withColumns({"legend": F.col("craft"), "date_start": F.col("day"), "date_end": F.col("day")})
    return _rounded(Catalogue(rows).analyse(Filters(), "2000-01-01", "2009-12-31", "other_dates_balanced", ("source", "legend")), 4)


def analysis_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven families of the dated reports, the first decade of the century against other dates, within countries."""
    r = cohort.label_cohorts(reports(spark, sf_dir).where("day is not null"), "day", "2000-01-01", "2009-12-31", "other_dates_balanced")
    families = {c: F.col(c) for c in ("type", "craft", "precision", "coordinate_source")} | {"month": F.month("day"), "weekday": F.weekday("day"), "mapped": F.col("lat").isNotNull()}
    return _rounded(document.analysis_document(document.comparison_cells(r, families, F.col("country"), F.col("source"))))


QUERIES = {f.__name__: f for f in (analysis_document, evidence_atlas, atlas_states, duration_assessment, clock_assessment, bounded_clusters, neighbourhood_both_ways, similar_segments, result_page, catalogue_analysis)}

_ATLAS = f"""{REPORTS_SQL}, t as (select 'craft' as axis, type as row, craft as v, case when date_precision = 'approximate' then 'excluded' when craft is null then 'unknown' else 'supported' end as state, source from reports
  union all select 'country', type, country, case when lat is null then 'not_loaded' when country is null then 'unknown' else 'supported' end, source from reports)"""

SQL = {
    "evidence_atlas": f"""with {_ATLAS}, r as (select axis, row, count(*) filter (state = 'supported') as total, count(*) filter (state = 'unknown') as missing from t where row is not null group by 1, 2), s as (select axis, row, source, count(*) as st from t where state = 'supported' group by 1, 2, 3), k as (select axis, row, count(*) as sources from s group by 1, 2),
        c as (select axis, row, v, source, count(*) as n from t where state = 'supported' and row is not null group by 1, 2, 3, 4), b as (select axis, row, v, sum(n) as n, sum(n / st) as sh from c join s using (axis, row, source) group by 1, 2, 3)
        select axis, row, v as column, n, round(n / total, 5) as row_share, round(sh / sources, 5) as balanced_share, round(n / (total + missing), 5) as low, round((n + missing) / (total + missing), 5) as high from b join r using (axis, row) join k using (axis, row)""",
    "catalogue_analysis": f"""with {REPORTS_SQL}, s as (select source, craft, coalesce(day between date '2000-01-01' and date '2009-12-31', false) as x, day is not null and not (day between date '2000-01-01' and date '2009-12-31') as y from reports), l as (select 'source' as family, coalesce(source, 'unknown') as key, x, y from s union all select 'legend', coalesce(craft, 'unknown'), x, y from s),
        n as (select family, key, (count(*) filter (x))::double as a, (count(*) filter (y))::double as c from l group by 1, 2 having count(*) filter (x or y) > 0), t as (select *, sum(a) over (partition by family) as a_total, sum(c) over (partition by family) as c_total from n),
        i as (select *, {_L1} as l1, {_U1} as u1, {_L2} as l2, {_U2} as u2, a / a_total as p1, c / c_total as p2, (a + c) / (a_total + c_total) as q0 from t), z as (select *, coalesce((p1 - p2) / nullif(sqrt(q0 * (1 - q0) * (1 / a_total + 1 / c_total)), 0), 0) as z from i), p as (select *, {_P_SQL} as p from z),
        r as (select *, row_number() over (partition by family order by p, key) as k, count(*) over (partition by family) as m from p)
        select family, key, a, c, round(p1, 4) as active_share, round(p2, 4) as reference_share, round(greatest(p1 - p2 - sqrt(pow(p1 - l1, 2) + pow(u2 - p2, 2)), -1), 4) as lower, round(least(p1 - p2 + sqrt(pow(u1 - p1, 2) + pow(p2 - l2, 2)), 1), 4) as upper, round(p, 4) as p,
        round(least(1.0, min(p * m / k) over (partition by family order by p, key rows between current row and unbounded following)), 4) as q from r""",
    "duration_assessment": rf"""with {_ONE}, t as (select source_name, regexp_replace(lower(trim(duration_raw)), '\b(?:about|approx\.?|around|nearly|roughly|over|a few)\b\s*', '', 'g') as x from c),
        p as (select source_name, case when regexp_matches(x, '\bsec|\bs$|\ds\b') then 1 when regexp_matches(x, '\bmin|\bm$|\dm\b') then 60 when regexp_matches(x, '\bhou?r|\bhrs?\b|\dh\b') then 3600 when regexp_matches(x, '\bday') then 86400 end as unit,
          try_cast(nullif(regexp_extract(x, '(\d+(?:\.\d+)?)', 1), '') as double) as a, try_cast(nullif(regexp_extract(x, '\d\s*(?:-|to)\s*(\d+(?:\.\d+)?)', 1), '') as double) as b, case when regexp_matches(x, '^(?:an?|one)\b') then 1.0 when regexp_matches(x, '^half an?\b') then 0.5 end as one from t),
        s as (select source_name, coalesce((a + b) / 2, a, one) * unit as s from p)
        select source_name, case when s <= 10 then 'up_to_10_seconds' when s <= 60 then 'up_to_minute' when s <= 600 then 'up_to_10_minutes' when s <= 3600 then 'up_to_hour' when s is not null then 'over_hour' end as bin, count(*) as n from s group by 1, 2""",
    "bounded_clusters": f"""with {EVENTS_SQL}, p as (select cast(floor((lon + 180) / 360 * 2048 / 40) as bigint) as gx, radians(greatest(-85.05112878, least(85.05112878, lat))) as phi from ev), c as (select gx, cast(floor((1 - ln(tan(phi) + 1 / cos(phi)) / 3.141592653589793) / 2 * 2048 / 40) as bigint) as gy from p),
        s as (select i, count(distinct (cast(floor(gx / pow(2, i)) as bigint), cast(floor(gy / pow(2, i)) as bigint))) as cells, count(*) as points from c, range(0, 7) r(i) group by 1)
        select cells, points, cast(40 * pow(2, i) as int) as cell_px from s where i = (select coalesce(min(i) filter (cells <= 200), 6) from s)""",
    "atlas_states": f"with {_ATLAS} select axis, state, count(*) as n from t group by 1, 2",
    "clock_assessment": f"""with {_ONE}, t as (select source_name, regexp_replace(lower(trim(time_raw)), '^(?:at|approx\\.?|about)\\s+|\\s*(?:hrs|hours)$', '', 'g') as x from c),
        p as (select *, regexp_extract(x, '^(\\d{{1,2}})[:h](\\d{{2}})(?::\\d{{2}}(?:\\.\\d+)?)?$', ['h', 'm']) as a, regexp_extract(x, '^(\\d{{2}})(\\d{{2}})$', ['h', 'm']) as b, regexp_extract(x, '^(\\d{{1,2}})(?:[:.](\\d{{2}}))?\\s*([ap])\\.?m\\.?$', ['h', 'm', 'p']) as d from t),
        n as (select *, try_cast(coalesce(nullif(a.h, ''), nullif(b.h, '')) as int) as h, try_cast(coalesce(nullif(a.m, ''), nullif(b.m, '')) as int) as m, try_cast(nullif(d.h, '') as int) as h12, coalesce(try_cast(nullif(d.m, '') as int), 0) as m12 from p),
        r as (select source_name, coalesce(case when h <= 23 and m <= 59 then h * 60 + m end, case when h12 between 1 and 12 and m12 <= 59 then (h12 % 12 + case when d.p = 'p' then 12 else 0 end) * 60 + m12 end) as k from n)
        select source_name, case when k < 360 then 'night' when k < 720 then 'morning' when k < 1080 then 'afternoon' when k < 1440 then 'evening' end as bin, count(*) as n from r group by 1, 2""",
    "neighbourhood_both_ways": f"""with {_ORDERS_SQL}, s as (select o_orderkey as k from orders where o_totalprice > 300000), f as (select from_id, min(trace_id) as trace_id, arg_min(to_id, trace_id) as then_id from seg group by 1), b as (select to_id, max(trace_id) as trace_id, arg_max(from_id, trace_id) as then_id from seg group by 1),
        f1 as (select * from f where from_id in (select k from s)), f2 as (select * from f where from_id in (select then_id from f1)), b1 as (select * from b where to_id in (select k from s)), b2 as (select * from b where to_id in (select then_id from b1))
        select trace_id, direction, min(hop) as hop from (select trace_id, 'forward' as direction, 1 as hop from f1 union all select trace_id, 'forward', 2 from f2 union all select trace_id, 'backward', 1 from b1 union all select trace_id, 'backward', 2 from b2) group by 1, 2""",
    "similar_segments": f"""with {_ORDERS_SQL}, e as (select cast(floor(from_lat / 20) as bigint) || ':' || cast(floor((((from_lon + 180) - 360 * floor((from_lon + 180) / 360)) - 180) / 20) as bigint) as a, cast(floor(to_lat / 20) as bigint) || ':' || cast(floor((((to_lon + 180) - 360 * floor((to_lon + 180) / 360)) - 180) / 20) as bigint) as b from seg)
        select least(a, b) as a_cell, greatest(a, b) as b_cell, count(*) as n from e group by 1, 2""",
    "result_page": "with n as (select c_custkey, c_acctbal, row_number() over (order by c_acctbal, c_custkey) - 1 as k from customer) select c_custkey, c_acctbal from n where k // 20 = (select k // 20 from n where c_custkey = 77)",
}
