"""Merge rules, similarity and accounting over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.unknown import clean
from nightloom.operators import dedupe, merge_rules, review
from nightloom.plans.base import clean_sql
from nightloom.plans.statistics import _rounded
from nightloom.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record").drop("event_id").unionByName(table(spark, sf_dir, "compact_partner"))
    return c.select(
        F.col("input_id").alias("id"), F.col("source_name").alias("source"), F.col("source_native_id").alias("native_id"), F.try_to_date("date_iso").alias("day"), F.trim("date_precision").alias("date_precision"),
        F.when(F.length("time_key") == 4, F.concat(F.substring("time_key", 1, 2), F.lit(":"), F.substring("time_key", 3, 2))).alias("time_raw"), clean(F.col("location_key")).alias("location"),
        F.when(~F.isnan("lat"), F.col("lat")).alias("lat"), F.when(~F.isnan("lon"), F.col("lon")).alias("lon"), F.lower(F.trim("coordinate_source")).alias("coordinate_source"),
        clean(F.col("type_key")).alias("type"), clean(F.substring_index("location_key", " ", 2)).alias("city"), clean(F.col("location_region_key")).alias("state"), clean(F.col("location_country_key")).alias("country"), clean(F.col("summary")).alias("description"),
    )


def merge_family_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = merge_rules.key_parts(_records(spark, sf_dir))
    return review.key_opportunities(parts, merge_rules.family_keys("maximal_v2"))


def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge_rules.merge_records(_records(spark, sf_dir), "maximal_v3")
    return m.groupBy("confidence").agg(F.count("*").alias("records"), F.countDistinct("root").alias("events"))


def near_duplicate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "compact_record").where("date_iso <> '' and location_key <> ''").select(F.col("input_id").alias("id"), "date_iso", "location_region_key", F.coalesce("text_normalized", F.lit("")).alias("t"))
    pairs = dedupe.blocked_pairs(c.where("location_region_key <> ''"), ["date_iso", "location_region_key"])
    a, b = c.select(F.col("id").alias("left_id"), F.col("t").alias("a")), c.select(F.col("id").alias("right_id"), F.col("t").alias("b"))
    both = pairs.join(a, "left_id").join(b, "right_id").select("left_id", "right_id", merge_rules.text_similarity(F.col("a"), F.col("b")).alias("s"))
    return _rounded(both.select("left_id", "right_id", "s", merge_rules.near_duplicate_score(F.col("s"), F.lit(False)).alias("score")))


def location_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"]).select(F.col("canonical_input_id").alias("id"), clean(F.col("location_raw")).alias("location")).where("location is not null")
    p = r.select("id", merge_rules.text_precision(F.col("location"), F.lit(False)).alias("precision"), F.size(merge_rules.location_candidates(F.col("location"))).alias("queries"))
    return p.groupBy("precision", "queries").agg(F.count("*").alias("n"))


def time_token_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_input").select(merge_rules.time_token_class(F.col("time_raw")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def column_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_rules.column_accounting(table(spark, sf_dir, "canonical_input"), "source_name", ["date_raw", "time_raw", "city", "shape_raw", "summary", "source_url"])


def qualified_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.month("l_shipdate").alias("month")).agg(F.count("*").alias("n"))
    return merge_rules.qualified_cells(n, "l_suppkey", "month", "n", 5)


QUERIES = {f.__name__: f for f in (merge_family_groups, merged_records, near_duplicate_scores, location_precision, time_token_classes, column_accounting, qualified_cells)}

_KEY = lambda c: f"nullif(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), '')"


def _place_sql(column: str) -> str:
    names = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in merge_rules.STATES.items()) + "}"
    return f"array_to_string(list_transform(string_split(regexp_replace({_KEY(column)}, '\\bunited states(?: of america)?\\b', 'usa', 'g'), ' '), lambda t: coalesce({names}[t], t)), ' ')"


def _families_sql() -> str:
    out = []
    for name, (_, parts) in merge_rules.MAXIMAL_2.items():
        names = parts.split()
        out.append(f"select '{name}' as family, {' || chr(124) || '.join(names)} as key from k where {' and '.join(n + ' is not null' for n in names)}")
    return " union all ".join(out)


_TIME_SQL = r"""case when contains(tm, 'noon') then 'noon' when contains(tm, 'midnight') then 'midnight' else nullif(trim(regexp_replace(regexp_extract(tm, '\b(?:(?:[01]?\d|2[0-3])(?::[0-5]\d){1,2}|(?:[01]?\d|2[0-3])[0-5]\d)\b'), '[^a-z0-9]+', ' ', 'g')), '') end"""

SQL = {
    "merge_family_groups": f"""with c as (select * exclude (event_id) from compact_record union all by name select * from compact_partner),
        r as (select source_name as ss, source_native_id as nat, lower(trim(date_precision)) in ('day', 'exact_day') as strong, cast(try_cast(date_iso as date) as varchar) as day, case when length(time_key) = 4 then substr(time_key, 1, 2) || ':' || substr(time_key, 3, 2) end as tm,
              {clean_sql('location_key')} as l, {clean_sql('type_key')} as t, {clean_sql("array_to_string(string_split(location_key, ' ')[:2], ' ')")} as ci, {clean_sql('location_region_key')} as st, {clean_sql('location_country_key')} as co, {clean_sql('summary')} as d,
              regexp_replace(lower(trim(coordinate_source)), '[^a-z0-9]+', ' ', 'g') in ('raw latlong', 'source coordinates', 'location coordinates') and not isnan(lat) and not isnan(lon) as sure, lat, lon from c),
        n as (select *, {_KEY('nat')} as native_key, {_KEY('t')} as type, {_KEY('l')} as l_key, {_KEY('d')} as d_key, {_KEY('tm')} as t_key from r),
        k as (select {_KEY('ss')} as ss, case when length(native_key) >= 3 and native_key not in ('none', 'null', 'unknown', 'n a', 'na', '000', '999') then native_key end as native, case when strong then day end as date, {_TIME_SQL} as time,
              {_place_sql("coalesce(l, nullif(concat_ws(', ', ci, st, co), ''))")} as place, {_place_sql('ci')} as city, {_place_sql('st')} as state, {_place_sql('co')} as country, type, case when type not in ('unknown', 'other', 'sighting', 'ufo', 'nuforc', 'ufodna', 'nicap', 'brazilgov') then type end as kind,
              case when sure then round_even(cast(lat as decimal(18, 12)), 3) || ',' || round_even(cast(lon as decimal(18, 12)), 3) end as coord, case when sure then cast(trunc(lat / 0.05) as int) || ',' || cast(trunc(lon / 0.05) as int) end as cell,
              case when day is not null and l_key is not null and d_key is not null then day || chr(10) || l_key || chr(10) || d_key || chr(10) || coalesce(t_key, '') end as fingerprint from n),
        f as ({_families_sql()}), g as (select family, key, count(*) as n from f group by 1, 2 having count(*) > 1) select family, count(*) as groups, sum(n) as records, sum(n - 1) as removable from g group by 1""",
    "location_precision": rf"""with c as (select *, row_number() over (partition by canonical_input_id order by ingested_at) as k from canonical_input), r as (select {clean_sql('location_raw')} as t from c where k = 1),
        b as (select t, lower(trim(t)) as low, trim(regexp_replace(regexp_replace(t, '[\(\[].*?[\)\]]', ' ', 'g'), '\s+', ' ', 'g')) as bare from r where t is not null),
        n as (select *, regexp_replace(bare, '(?i)^(?:near|just outside|outskirts of|in/around|approx\.?\s*\d+\s*km \w+ of|\d+ mi \w+ of)\s+', '') as lead from b), p as (select *, regexp_split_to_array(lead, '\s*[,;/]\s*') as parts from n)
        select case when regexp_matches(low, '\b(?:near|outside|outskirts|around|vicinity|approx|mi [nsew]|km (?:north|south|east|west))') then 'approximate' when len(regexp_split_to_array(low, '[,;/]')) >= 2 then 'city' when length(low) <= 3 then 'region' when low <> '' then 'place' else 'unknown' end as precision,
          cast(len(list_distinct(list_filter([t, bare, lead, parts[1], case when len(parts) > 1 then array_to_string(parts[2:11], ', ') end], lambda x: length(trim(x)) > 0))) as int) as queries, count(*) as n from p group by 1, 2""",
    "time_token_classes": """with t as (select lower(trim(time_raw)) as x from canonical_input) select case when regexp_matches(x, '^(?:at )?(?:[01]?\\d|2[0-3])[:h.][0-5]\\d(?:[:.]\\d+)*\\s*(?:[ap]\\.?m\\.?)?$|^(?:[01]\\d|2[0-3])[0-5]\\d(?: hrs)?$|^\\d{1,2}\\s*[ap]\\.?m\\.?$') then 'exact'
        when regexp_matches(x, '^(?:approx|about|around|circa|~)|dawn|dusk|night|evening|morning|noon|afternoon') then 'fuzzy' when regexp_matches(x, '^\\d{1,2}(?:\\s*o''?clock)?$') then 'ambiguous' else 'none' end as class, count(*) as n from t group by 1""",
    "column_accounting": "select source_name, c as column, count(*) as rows, count(*) filter (trim(coalesce(v, '')) <> '') as filled from (select source_name, unnest(['date_raw', 'time_raw', 'city', 'shape_raw', 'summary', 'source_url']) as c, unnest([date_raw, time_raw, city, shape_raw, summary, source_url]) as v from canonical_input) group by 1, 2",
    "qualified_cells": """with n as (select l_suppkey, month(l_shipdate) as month, count(*) as n from lineitem group by 1, 2), r as (select l_suppkey from (select l_suppkey, max(n) as e from n group by 1) order by e desc, l_suppkey limit 5), c as (select month from (select month, max(n) as e from n group by 1) order by e desc, month limit 5)
        select month, l_suppkey, n from n where l_suppkey in (from r) and month in (from c)""",
}
