"""Facets, filters, search and profiles over the catalogue."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.text import searchable, stable_hash
from nightloom.operators import facets, predicates, search
from nightloom.operators.predicates import Filters
from nightloom.plans.base import EVENTS_SQL, REPORTS_SQL, haversine_sql, reports, stream_events
from nightloom.session import ensure_checkpoint_dir, table

_SELECT = {"source": ("skyledger", "harbor_log"), "type": ("light", "landing", "radar")}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).withColumns({"legend": F.col("craft"), "date_start": F.lit(None).cast("date"), "date_end": F.lit(None).cast("date")})


def facet_drill_sideways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.drill_sideways(_rows(spark, sf_dir), Filters(selected=_SELECT, hide_low_precision=True))


def facet_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.drill_sideways(_rows(spark, sf_dir), Filters(selected={"source": ("skyledger",)}, start="1990-01-01", end="2009-12-31"))


def facet_legend_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.legend_counts(_rows(spark, sf_dir), Filters(selected=_SELECT, legend=("disk", "oval"), start="1980-01-01", end="2020-12-31"))


def filtered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.filtered_ids(_rows(spark, sf_dir), Filters(selected=_SELECT, legend=("disk", "oval"), exact_day_only=True, start="1980-01-01", end="2020-12-31"))


def filter_undated_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where(predicates.overlaps("1990-01-01", "1999-12-31", include_undated=True)).groupBy("source").agg(F.count("*").alias("n"), F.count("day").alias("dated"))


def filter_area_rect_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_events(spark, sf_dir).where(predicates.in_rectangle(F.col("lat"), F.col("lon"), -40.0, 150.0, 30.0, -150.0)).select("event_id", "lat", "lon")


def filter_area_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).where(predicates.in_circle(F.col("lat"), F.col("lon"), (33.5, -112.0), 150.0)).select("event_id", "source")


def filter_any_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.col("lat"), F.col("lon")
    shapes = [predicates.in_circle(lat, lon, (51.0, 0.0), 300.0), predicates.in_rectangle(lat, lon, -45.0, 110.0, -10.0, 180.0), F.coalesce(F.col("country").isin("france", "fr"), F.lit(False))]
    return reports(spark, sf_dir).where(predicates.in_any(shapes)).groupBy("source").agg(F.count("*").alias("n"))


def filter_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(predicates.has_any_bit(F.col("p_size"), 0b010110)).select("p_partkey", "p_size")


def eligibility_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    reason = predicates.first_failing(not_exact_day=F.col("date_precision") == "day", undated=F.col("day").isNotNull(), unmapped=F.col("lat").isNotNull(), not_source_coordinates=F.col("coordinate_source") == "source_coordinates", unknown_craft=F.col("craft").isNotNull())
    return r.select(reason.alias("reason"), "source").groupBy("reason", "source").agg(F.count("*").alias("n"))


def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    state = predicates.evidence_state(F.col("lat").isNotNull(), F.col("date_precision") == "approximate", F.col("craft"))
    return r.select(state.alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def drill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderdate")
    return predicates.page(rows, ["o_orderdate", "o_orderkey"], 40, 25)


def _search(query: str, mode: str = "auto"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(table(spark, sf_dir, "documents"), "text", query, mode).select("doc_id", "source")

    return run


_INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the index of the documents is, written on first use by an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        path = os.path.join(ensure_checkpoint_dir(spark), f"text-index-{uuid.uuid4().hex}")
        search.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", path)
        _INDEXES[at] = path
    return _INDEXES[at]


def search_index_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, lexicon = search.read_index(spark, text_index(spark, sf_dir))
    return lexicon.where(F.length("token") > 3).join(postings.groupBy("token").agg(F.min("id").alias("first_id")), "token")


def search_postings_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, lexicon = search.read_index(spark, text_index(spark, sf_dir))
    docs = table(spark, sf_dir, "documents")
    return search.search_postings(postings, docs, "doc_id", "text", 'beam AND ("grass lay flat" OR whistle)', lexicon=lexicon).select(F.col("id").alias("doc_id"))


def search_token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.token_counts(search.build_postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


def search_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).withColumn("all_text", searchable(F.col("description"), F.col("location"), F.col("source"), F.col("craft")))
    return r.where(search.matches(search.compile_query("harbor_log AND (disk OR oval)"), F.col("all_text"))).select("event_id")


def search_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = search.compile_query("beam OR horses OR bolted")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").where(search.matches(tree, F.lower("text")))
    return d.select("doc_id", F.size(search.match_ranges(F.col("text"), tree)).alias("ranges"), F.length(search.excerpt(F.col("text"), tree)).alias("excerpt_chars"))


def json_props_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.get_json_object("props", "$.k").alias("k"), "event_type").groupBy("k", "event_type").agg(F.count("*").alias("n"))


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    cols = ["type", "craft", "country", "lat", "day", "description", "location", "time_raw"]
    shares = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("there")) for c in cols])
    long = r.select("source", F.explode(shares).alias("x")).select("source", "x.*")
    return long.groupBy("source", "field").agg(F.count("*").alias("n"), F.count_if("there").alias("present"), F.round(F.avg(F.col("there").cast("int")), 6).alias("share"))


def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    ci = table(spark, sf_dir, "canonical_input")
    return ci.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.countDistinct("canonical_input_id").alias("ids"), F.countDistinct("source_row_hash").alias("hashes"), F.min("source_row_number").alias("first_row"), F.max("source_row_number").alias("last_row"),
        F.count_if(F.trim(F.coalesce("date_raw", F.lit(""))) == "").alias("empty_dates"),
    )


def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", stable_hash("nat_", 24, name=F.col("n_name"), region=F.col("n_regionkey")).alias("hash"))


_SEL = "source in ('skyledger', 'harbor_log')"
_TYP = "type in ('light', 'landing', 'radar')"
_LOW = "coalesce(precision not in ('country', 'state', 'province', 'state_province', 'region', 'county', 'approximate', 'multi_location', 'unknown'), true)"


def _search_sql(condition: str) -> str:
    return f"select doc_id, source from documents where text is not null and ({condition})"


def _has(word: str) -> str:
    return f"contains(lower(text), '{word}')"


QUERIES = {
    "facet_drill_sideways": facet_drill_sideways, "facet_date_range": facet_date_range, "facet_legend_relaxed": facet_legend_relaxed, "filtered_ids": filtered_ids,
    "filter_undated_passes": filter_undated_passes, "filter_area_rect_antimeridian": filter_area_rect_antimeridian, "filter_area_circle": filter_area_circle, "filter_any_shape": filter_any_shape,
    "filter_bitmask": filter_bitmask, "eligibility_reason": eligibility_reason, "evidence_states": evidence_states, "drill_page": drill_page,
    "search_literal": _search("grass lay flat"), "search_all": _search("beam whistle", "all"), "search_any": _search("pilot engineer", "any"), "search_expression": _search('"no sound" AND (boat OR horses) OR "blamed ball lightning"'),
    "search_postings_and_or": search_postings_and_or, "search_index_lexicon": search_index_lexicon, "search_token_df": search_token_df, "search_multi_field": search_multi_field, "search_highlights": search_highlights,
    "json_props_facet": json_props_facet, "missingness": missingness, "source_profile": source_profile, "row_hashes": row_hashes,
}

SQL = {
    "facet_drill_sideways": f"""with {REPORTS_SQL}, base as (select * from reports where {_LOW})
        select 'source' as facet, source as value, count(*) as n from base where {_TYP} and trim(source) <> '' group by 2
        union all select 'type', type, count(*) from base where {_SEL} and trim(type) <> '' group by 2
        union all select 'precision', precision, count(*) from base where {_SEL} and {_TYP} and trim(precision) <> '' group by 2
        union all select 'legend', craft, count(*) from base where {_SEL} and {_TYP} and trim(craft) <> '' group by 2""",
    "facet_date_range": f"""with {REPORTS_SQL}, base as (select * from reports where day between date '1990-01-01' and date '2009-12-31')
        select 'source' as facet, source as value, count(*) as n from base where trim(source) <> '' group by 2
        union all select 'type', type, count(*) from base where source = 'skyledger' and trim(type) <> '' group by 2
        union all select 'precision', precision, count(*) from base where source = 'skyledger' and trim(precision) <> '' group by 2
        union all select 'legend', craft, count(*) from base where source = 'skyledger' and trim(craft) <> '' group by 2""",
    "facet_legend_relaxed": f"with {REPORTS_SQL} select craft as legend, count(*) as n from reports where {_SEL} and {_TYP} and day between date '1980-01-01' and date '2020-12-31' and trim(craft) <> '' group by 1",
    "filtered_ids": f"with {REPORTS_SQL} select event_id from reports where {_SEL} and {_TYP} and craft in ('disk', 'oval') and date_precision in ('day', 'exact_day')",
    "filter_undated_passes": f"with {REPORTS_SQL} select source, count(*) as n, count(day) as dated from reports where day is null or day between date '1990-01-01' and date '1999-12-31' group by 1",
    "filter_area_rect_antimeridian": f"with {EVENTS_SQL} select event_id, lat, lon from ev where lat between -40 and 30 and (lon >= 150 or lon <= -150)",
    "filter_area_circle": f"with {REPORTS_SQL} select event_id, source from reports where {haversine_sql('lat', 'lon', '33.5', '-112.0')} <= 150",
    "filter_any_shape": f"with {REPORTS_SQL} select source, count(*) as n from reports where coalesce({haversine_sql('lat', 'lon', '51.0', '0.0')} <= 300, false) or coalesce(lat between -45 and -10 and lon between 110 and 180, false) or coalesce(country in ('france', 'fr'), false) group by 1",
    "filter_bitmask": "select p_partkey, p_size from part where (p_size & 22) <> 0",
    "eligibility_reason": f"""with {REPORTS_SQL} select case when not coalesce(date_precision = 'day', false) then 'not_exact_day' when day is null then 'undated' when lat is null then 'unmapped'
        when not coalesce(coordinate_source = 'source_coordinates', false) then 'not_source_coordinates' when craft is null then 'unknown_craft' else 'eligible' end as reason, source, count(*) as n from reports group by 1, 2""",
    "evidence_states": f"with {REPORTS_SQL} select case when lat is null then 'not_loaded' when date_precision = 'approximate' then 'excluded' when craft is null then 'unknown' else 'supported' end as state, count(*) as n from reports group by 1",
    "drill_page": "select o_orderkey, o_orderdate, (select count(*) from orders where o_orderpriority = '1-URGENT') as total from orders where o_orderpriority = '1-URGENT' order by o_orderdate, o_orderkey limit 25 offset 40",
    "search_literal": _search_sql(_has("grass lay flat")),
    "search_all": _search_sql(f"{_has('beam')} and {_has('whistle')}"),
    "search_any": _search_sql(f"{_has('pilot')} or {_has('engineer')}"),
    "search_expression": _search_sql(f"({_has('no sound')} and ({_has('boat')} or {_has('horses')})) or {_has('blamed ball lightning')}"),
    "search_postings_and_or": f"select doc_id from documents where {_has('beam')} and ({_has('grass lay flat')} or {_has('whistle')})",
    "search_token_df": r"select token, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as token from documents) group by 1",
    "search_index_lexicon": r"select token, count(*) as df, min(doc_id) as first_id from (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) as token from documents) where length(token) > 3 group by 1",
    "search_highlights": """with t as (select doc_id, text, lower(text) as x from documents where contains(lower(text), 'beam') or contains(lower(text), 'horses') or contains(lower(text), 'bolted')),
        h as (select doc_id, i, w from t, (values ('beam'), ('horses'), ('bolted')) v(w), unnest(range(1, length(x) - length(w) + 2)) r(i) where substr(x, i, length(w)) = w),
        k as (select doc_id, i, i + length(w) as e from (select *, row_number() over (partition by doc_id order by i, w) as n from h) where n <= 128),
        m as (select doc_id, count(*) filter (fresh) as ranges, min(i) as first from (select *, coalesce(i > max(e) over (partition by doc_id order by i, e rows between unbounded preceding and 1 preceding), true) as fresh from k) group by 1)
        select doc_id, cast(ranges as int) as ranges, cast(least(240, length(text) - greatest(0, least(first - 80, length(text) - 239) - 1)) as int) as excerpt_chars from t join m using (doc_id)""",
    "search_multi_field": f"""with {REPORTS_SQL}, t as (select event_id, lower(coalesce(description, '') || chr(10) || coalesce(location, '') || chr(10) || coalesce(source, '') || chr(10) || coalesce(craft, '')) as x from reports)
        select event_id from t where contains(x, 'harbor_log') and (contains(x, 'disk') or contains(x, 'oval'))""",
    "json_props_facet": "select json_extract_string(props, '$.k') as k, event_type, count(*) as n from events group by 1, 2",
    "missingness": f"""with {REPORTS_SQL} select source, field, count(*) as n, count(*) filter (there) as present, round(avg(cast(there as int)), 6) as share from (
        select source, unnest([{', '.join(f"{{'field': '{c}', 'there': {c} is not null}}" for c in ('type', 'craft', 'country', 'lat', 'day', 'description', 'location', 'time_raw'))}], recursive := true) from reports) group by 1, 2""",
    "source_profile": "select source_file, count(*) as rows, count(distinct canonical_input_id) as ids, count(distinct source_row_hash) as hashes, min(source_row_number) as first_row, max(source_row_number) as last_row, count(*) filter (trim(coalesce(date_raw, '')) = '') as empty_dates from canonical_input group by 1",
    "row_hashes": """select n_nationkey, 'nat_' || substr(sha1('{"name":"' || n_name || '","region":' || n_regionkey || '}'), 1, 24) as hash from nation""",
}
