"""Scalar functions, sources, sinks and windows of time."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import chronology, classify, dates, historical
from nightloom.functions.geo import bearing, distance_class, haversine_km
from nightloom.functions.text import collapse_whitespace, fnv1a, join_present, normalize_key
from nightloom.operators import sequence
from nightloom.plans.base import EVENTS_SQL, REPORTS_SQL, reports, stream_events
from nightloom.session import ensure_checkpoint_dir, table
from nightloom.sources import files
from nightloom.streaming import windows


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    return r.select("event_id", normalize_key(F.col("description")).alias("key"), F.length(collapse_whitespace(F.col("location"))).alias("location_chars"))


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "place_ref")
    return p.select("place_id", join_present(F.col("city"), F.when(F.col("place_id") % 3 != 0, F.col("state_province")), F.col("country")).alias("place"))


def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", fnv1a(F.col("n_name")).alias("hash"))


def date_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"]).select("canonical_input_id", dates.date_expression(F.col("date_raw")).alias("d"))
    return c.where("d is not null").select("canonical_input_id", F.col("d.start").alias("start"), F.col("d.end").alias("end"), F.col("d.sort").alias("sort"), F.col("d.precision").alias("precision"))


def historical_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    d = historical.historical_date(F.col("date_raw"), F.lit(None).cast("string"), F.col("posted_date_raw"), F.lit(None).cast("string"), F.col("source_file"))
    return c.select("canonical_input_id", d.alias("d")).where("d is not null").select("canonical_input_id", "d.*")


def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    return c.select("canonical_input_id", dates.clock_minutes(F.col("time_raw")).alias("minutes"), dates.clock_bucket(F.col("time_raw"))["mid"].alias("bucket_mid")).where("minutes is not null or bucket_mid is not null")


def clock_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    return c.select("canonical_input_id", F.inline(F.array(chronology.clock_evidence(F.col("time_raw")))))


def playback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a full numeric date in ISO form, zones as written with the record."""
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    day = F.try_to_date(F.when(F.col("date_raw").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_raw")))
    c = c.select("canonical_input_id", day.alias("day"), "date_precision", F.col("raw_fields")["local_zone"].alias("zone"), F.inline(F.array(F.struct(chronology.clock_evidence(F.col("time_raw")).alias("told")))))
    zone = F.when(F.col("zone").contains("/"), F.col("zone"))
    key = chronology.playback(F.col("day"), F.col("date_precision") == "day", F.col("told"), zone, F.when(zone.isNotNull(), "high").otherwise("none"), F.col("canonical_input_id"))
    return c.where("day is not null").select("canonical_input_id", "day", F.inline(F.array(key))).drop("id_text")


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 30)")).alias("at"))
    t = dates.local_to_utc(F.col("at"), F.lit("America/New_York"))
    return o.select("o_orderkey", t["utc"].cast("timestamp_ntz").alias("utc"), t["state"].alias("state"))


def day_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return o.select("day", F.unix_date("day").alias("unix_day"), dates.python_ordinal(F.col("day")).alias("ordinal"), F.date_format("day", "yyyyMMdd").cast("int").alias("day_key"))


def shape_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    k = classify.classify({"shape": (F.col("shape_raw"), "high"), "summary": (F.col("summary"), "medium"), "description": (F.col("description"), "low")})
    return c.select(k["label"].alias("label"), k["source"].alias("source"), k["confidence"].alias("confidence")).groupBy("label", "source", "confidence").agg(F.count("*").alias("n"))


def geo_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_events(spark, sf_dir)
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return e.select("event_id", F.round(km, 3).alias("km"), F.round(bearing(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 4).alias("bearing"), distance_class(km, F.lit(40.0), 5000.0).alias("class"))


def text_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"]).select("canonical_input_id", dates.decimal_coordinates(F.col("location_raw")).alias("at"))
    return c.where("at is not null").select("canonical_input_id", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"))


def tumbling_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(stream_events(spark, sf_dir), "ts", "1 day", "type").withColumn("start", F.to_date("start"))


def sliding_7d_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(stream_events(spark, sf_dir), "ts", "7 days", "1 day").withColumn("start", F.to_date("start"))


def session_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.sessions(stream_events(spark, sf_dir), "ts", "30 minutes", "user_id")
    return s.select("user_id", F.unix_timestamp("start").alias("start"), "n")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    s = windows.read_stream(spark, _stream_dir(spark, sf_dir), schema)
    out = windows.run_available(windows.windowed_stream(s.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", F.col("event_type")).select(F.col("w.start").alias("start"), "event_type", "n"), _shared(spark, "windows"), _shared(spark, "windows-state"))
    # windows that the watermark has not passed stay open in append mode
    return out.select(F.to_date("start").alias("start"), "event_type", "n")


def _stream_dir(spark: SparkSession, sf_dir: str) -> str:
    """The events as a folder that a file stream can read, in time order over several files."""
    path = _shared(spark, "events")
    table(spark, sf_dir, "events").repartitionByRange(6, "ts").write.parquet(path)
    return path


def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stream_dir(spark, sf_dir)
    table(spark, sf_dir, "events").where("event_id % 5 = 0").write.mode("append").parquet(path)
    s = windows.read_stream(spark, path, table(spark, sf_dir, "events").schema, 100).withColumn("ts", F.col("ts").cast("timestamp"))
    out = windows.run_available(windows.deduplicated(s, ["event_id"], "ts", "60 days").select("event_id", "event_type"), _shared(spark, "dedupe"), _shared(spark, "dedupe-state"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.read_stream(spark, _stream_dir(spark, sf_dir), table(spark, sf_dir, "events").schema, 2)
    b = windows.running_bursts(s, "user_id", "ts", "1 day", 86400, 3)
    return windows.run_available(b, _shared(spark, "bursts"), _shared(spark, "bursts-state")).groupBy("user_id").agg(F.count("*").alias("bursts"))


def chunked_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.write_chunks(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), _shared(spark, "chunks"), "o_orderkey", 2000)
    return m.agg(F.sum("rows").alias("rows"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.col("rows") <= 2000).alias("bounded"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "lines")
    files.write_json_lines(table(spark, sf_dir, "nation"), path, gzip=True)
    return files.read_json_lines(spark, path, "n_nationkey int, n_name string, n_regionkey int")


def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return files.latest_by_key(e, ["user_id", "event_type"], "event_id")


def dictionary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = files.dictionary_encode(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])
    return coded


def filtered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_events(spark, sf_dir).where("value > 0")
    return sequence.segments(e, ["user_id"], ["ts"]).select("trace_id", "gap_days")


QUERIES = {f.__name__: f for f in (
    text_keys, place_texts, fnv_hashes, date_expressions, historical_dates, clock_texts, clock_evidence, playback_order, local_times, day_ordinals, shape_classes, geo_measures, text_coordinates, tumbling_1d, sliding_7d_1d, session_30m,
    stream_tumbling, stream_deduplicated, stream_bursts, chunked_manifest, json_round_trip, cache_latest, dictionary_codes, filtered_segments,
)}

_SHAPE_RULES = classify.SHAPES


def _class_sql(column: str, level: str) -> str:
    cases = " ".join(f"when regexp_matches(lower({column}), '{p}') then '{label}'" for label, p in _SHAPE_RULES)
    return f"case {cases} end as {level}"


_ONE = "c as (select * from (select *, row_number() over (partition by canonical_input_id order by ingested_at) as k from canonical_input) where k = 1)"

def _clock_sql(token: str, inherited: str = "null") -> str:
    """Minutes of one clock, from its definition."""
    part = lambda p, i: f"nullif(regexp_extract({token}, '{p}', {i}), '')"
    clock, hours = r"(?i)^\s*(\d{1,2})(?::(\d{2}))?\s*(?:([ap])\.?m\.?)?\s*$", r"(?i)^\s*(\d{1,2})(\d{2})\s*hours?\s*$"
    h, m, half = f"cast({part(clock, 1)} as int)", f"coalesce(cast({part(clock, 2)} as int), 0)", f"coalesce(lower({part(clock, 3)}), {inherited})"
    h2, m2 = f"cast({part(hours, 1)} as int)", f"cast({part(hours, 2)} as int)"
    return (
        f"case when regexp_matches({token}, '(?i)^\\s*(?:12\\s+)?noon\\s*$') then 720 when regexp_matches({token}, '(?i)^\\s*(?:12\\s+)?midnight\\s*$') then 0 when {h} is not null and {m} <= 59 and {half} is null and {h} <= 23 then {h} * 60 + {m} "
        f"when {h} between 1 and 12 and {m} <= 59 and {half} is not null then ({h} % 12 + case when {half} = 'p' then 12 else 0 end) * 60 + {m} when {h2} <= 23 and {m2} <= 59 then {h2} * 60 + {m2} end"
    )


_TOKENS = "|".join(sorted(chronology.OFFSETS, key=len, reverse=True))
_PART_CASE = " ".join(f"when regexp_matches(b, '(?i)\\b{word}\\b') then '{part}'" for word, part in chronology.PART_WORDS)
_SPAN_CASE = lambda i: " ".join(f"when '{k}' then {v[i]}" for k, v in chronology.PARTS.items())
_EVIDENCE_SQL = rf"""{_ONE}, s as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(time_raw, ''), '(\d)[oO](\d)', '\10\2', 'g'), '(\d)[lI](\d)', '\11\2', 'g'), '(\d)\.(\d)', '\1:\2', 'g'), '\s+', ' ', 'g')) as t from c),
        z as (select *, nullif(upper(regexp_extract(t, '(?i)(?:^|[^A-Z])({_TOKENS})(?:[^A-Z]|$)', 1)), '') as token, trim(regexp_replace(regexp_replace(t, '(?i)(^|[^A-Z])(?:{_TOKENS})([^A-Z]|$)', '\1 \2'), '\s+', ' ', 'g')) as b from s),
        n as (select *, case {_PART_CASE} end as part, regexp_extract(b, '(?i)^(?:between|from)\s+(.+?)\s+(?:and|to)\s+(.+)$', 1) as l, regexp_extract(b, '(?i)^(?:between|from)\s+(.+?)\s+(?:and|to)\s+(.+)$', 2) as r, trim(regexp_replace(regexp_replace(b, '(?i)^(?:~|about|around|approx(?:\.|imately)?|ca\.?|circa)\s+', ''), '\?$', '')) as one from z),
        m as (select *, {_clock_sql('l', "nullif(lower(regexp_extract(r, '(?i)([ap])[.]?m', 1)), '')")} as f, {_clock_sql('r')} as g, {_clock_sql('one')} as clock, case token {" ".join(f"when '{a}' then {b}" for a, b in chronology.OFFSETS.items())} end as "offset" from n),
        told as (select canonical_input_id, date_raw, date_precision, raw_fields, part, "offset", case when part is not null then case when lower(b) = 'around midnight' then 'approximate' else 'bucketed' end when f is not null and g is not null then 'approximate' when clock is not null then case when one <> b then 'approximate' else 'exact' end else 'unknown' end as kind,
          case when part is not null then case part {_SPAN_CASE(2)} end when f is not null and g is not null then (f + case when g < f then g + 1440 else g end) // 2 % 1440 else clock end as minutes,
          case when part is not null then case part {_SPAN_CASE(0)} end when f is not null and g is not null then f when one <> b then greatest(0, clock - 30) else clock end as start,
          case when part is not null then case part {_SPAN_CASE(1)} end when f is not null and g is not null then g when one <> b then least(1439, clock + 30) else clock end as "end" from m)"""

_NAMES = "case lower(substr({0}, 1, 3)) " + " ".join(f"when '{n[:3]}' then {i}" for i, n in enumerate(historical.NAMES, 1)) + " end"
_LAST = "least({0}, day(last_day(make_date({1}, {2}, 1))))"

SQL = {
    # full years only: the test tables have no headings, and their file names tell no years
    "historical_dates": rf"""with {_ONE}, v as (select canonical_input_id, 1 as turn, date_raw as x from c union all select canonical_input_id, 2, posted_date_raw from c), q as (select *, trim(regexp_replace(trim(x), '\s+', ' ', 'g')) as y from v where x is not null),
        t as (select *, trim(regexp_replace(lower(y), '[?~]', '', 'g')) as t from q), e as (select *, t <> lower(y) as vague, regexp_extract(t, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{1,4}})$', ['m', 'd', 'y']) as a, regexp_extract(t, '^(\d{{1,2}})/(\d{{1,4}})$', ['m', 'y']) as b,
          regexp_extract(t, '^([a-z]+) (?:(\d{{1,2}}), ?)?(\d{{1,4}})$', ['n', 'd', 'y']) as n, regexp_extract(t, '^(?:around|circa|ca[.]|c[.]|approx[.]|approx|approximately) (\d{{1,4}})$', 1) as near, regexp_extract(t, '^(\d{{1,4}})$', 1) as y4, regexp_extract(t, '^(early|mid|late) (\d{{1,4}})$', ['s', 'y']) as part, regexp_extract(t, '^(spring|summer|autumn|fall|winter) (\d{{1,4}})$', ['s', 'y']) as w, coalesce(nullif(regexp_extract(t, '^(\d{{1,4}}0)s$', 1), ''), regexp_extract(t, '^(\d{{1,4}})''s$', 1)) as dec from t),
        m as (select *, case when n.n in ({", ".join(f"'{n}', '{n[:3]}'" for n in historical.NAMES)}) then {_NAMES.format('n.n')} end as nm from e),
        i as (select canonical_input_id, turn, vague, case
          when a.y <> '' and try_cast(a.m as int) between 1 and 12 and a.d <> '0' and a.d <> '00' then {{'p': 'exact_day', 'f': try_cast(make_date(try_cast(a.y as int), try_cast(a.m as int), {_LAST.format('try_cast(a.d as int)', 'try_cast(a.y as int)', 'try_cast(a.m as int)')}) as date), 'l': make_date(try_cast(a.y as int), try_cast(a.m as int), {_LAST.format('try_cast(a.d as int)', 'try_cast(a.y as int)', 'try_cast(a.m as int)')})}}
          when b.y <> '' and try_cast(b.m as int) between 1 and 12 then {{'p': 'month', 'f': make_date(try_cast(b.y as int), try_cast(b.m as int), 1), 'l': last_day(make_date(try_cast(b.y as int), try_cast(b.m as int), 1))}}
          when nm is not null and n.d <> '' and n.d <> '0' and n.d <> '00' then {{'p': 'exact_day', 'f': make_date(try_cast(n.y as int), nm, {_LAST.format('try_cast(n.d as int)', 'try_cast(n.y as int)', 'nm')}), 'l': make_date(try_cast(n.y as int), nm, {_LAST.format('try_cast(n.d as int)', 'try_cast(n.y as int)', 'nm')})}}
          when nm is not null and n.d = '' then {{'p': 'month', 'f': make_date(try_cast(n.y as int), nm, 1), 'l': last_day(make_date(try_cast(n.y as int), nm, 1))}}
          when part.y <> '' then {{'p': 'approximate', 'f': case part.s when 'early' then make_date(try_cast(part.y as int), 1, 1) when 'mid' then make_date(try_cast(part.y as int), 1, 1) + 121 + (dayofyear(make_date(try_cast(part.y as int), 12, 31)) // 366)::int else make_date(try_cast(part.y as int), 12, 31) - 120 - (dayofyear(make_date(try_cast(part.y as int), 12, 31)) // 366)::int end,
            'l': case part.s when 'early' then make_date(try_cast(part.y as int), 1, 1) + 120 + (dayofyear(make_date(try_cast(part.y as int), 12, 31)) // 366)::int when 'mid' then make_date(try_cast(part.y as int), 1, 1) + 241 + 2 * (dayofyear(make_date(try_cast(part.y as int), 12, 31)) // 366)::int else make_date(try_cast(part.y as int), 12, 31) end}}
          when y4 <> '' then {{'p': 'year', 'f': make_date(try_cast(y4 as int), 1, 1), 'l': make_date(try_cast(y4 as int), 12, 31)}} when near <> '' then {{'p': 'approximate', 'f': make_date(try_cast(near as int), 1, 1), 'l': make_date(try_cast(near as int), 12, 31)}}
          when w.y <> '' then {{'p': 'approximate', 'f': make_date(try_cast(w.y as int), case w.s when 'spring' then 3 when 'summer' then 6 when 'winter' then 12 else 9 end, 1), 'l': last_day(make_date(try_cast(w.y as int), case w.s when 'spring' then 3 when 'summer' then 6 when 'winter' then 12 else 9 end, 1) + interval 2 month)}}
          when dec <> '' then {{'p': 'decade', 'f': make_date(try_cast(dec as int) // 10 * 10, 1, 1), 'l': make_date(try_cast(dec as int) // 10 * 10 + 9, 12, 31)}} end as r from m),
        o as (select canonical_input_id, arg_min(r, turn) as r, arg_min(vague, turn) as vague from i where r is not null group by 1)
        select canonical_input_id, strftime(r.f, '%Y-%m-%d') as date_iso, case when r.l <> r.f then strftime(r.l, '%Y-%m-%d') end as end_date_iso, strftime(r.f + try_cast((r.l - r.f) // 2 as int), '%Y-%m-%d') as sort_date_iso, case when vague then 'approximate' else r.p end as date_precision from o""",
    "clock_evidence": f"""with {_EVIDENCE_SQL} select canonical_input_id, kind, case kind when 'exact' then 'high' when 'approximate' then 'medium' when 'bucketed' then 'low' else 'none' end as confidence, part, cast(minutes as int) as minutes, cast(start as int) as start, cast("end" as int) as "end", cast("offset" as int) as "offset" from told""",
    "playback_order": f"""with {_EVIDENCE_SQL}, d as (select *, try_cast(date_raw as date) as day, case when contains(raw_fields['local_zone'], '/') then raw_fields['local_zone'] end as zone from told where regexp_matches(date_raw, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')),
        p as (select *, date_precision = 'day' and minutes is not null as knows, cast(day as timestamp) + to_minutes(start) as la, cast(day as timestamp) + to_minutes(case when "end" < start then "end" + 1440 else "end" end) as lb from d where day is not null),
        u as (select *, case when "offset" is not null then la - to_minutes("offset") when zone is not null then timezone('UTC', timezone(zone, la)) end as a, case when "offset" is not null then lb - to_minutes("offset") when zone is not null then timezone('UTC', timezone(zone, lb)) end as b from p),
        w as (select *, coalesce("offset" is not null or (timezone(zone, timezone('UTC', a)) = la and timezone(zone, timezone('UTC', b)) = lb and timezone(zone, timezone('UTC', a - interval 1 hour)) <> la and timezone(zone, timezone('UTC', a + interval 1 hour)) <> la
          and timezone(zone, timezone('UTC', b - interval 1 hour)) <> lb and timezone(zone, timezone('UTC', b + interval 1 hour)) <> lb), false) and a is not null and coalesce(knows, false) as utc from u)
        select canonical_input_id, day, case when utc then 1 when knows then 2 else 3 end as "group", case when utc then (epoch_ms(a) + epoch_ms(b)) // 2 when knows then minutes end as value, case when utc then epoch_ms(b) - epoch_ms(a) when knows then case when "end" < start then "end" - start + 1440 else "end" - start end end as width,
          case when utc or knows then case kind when 'exact' then 0 when 'approximate' then 1 else 2 end else 3 end as rank, 1 as id_kind, case when utc or knows then case kind when 'exact' then 'high' when 'approximate' then 'medium' else 'low' end else 'none' end as confidence,
          case when utc then kind || '_time_with_' || case when "offset" is not null then 'explicit' else 'inferred' end || '_timezone' when knows then 'local_time_only' else 'stable_fallback' end as reason from w""",
    "text_keys": f"with {REPORTS_SQL} select event_id, trim(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9]+', ' ', 'g')) as key, length(trim(regexp_replace(location, '\\s+', ' ', 'g'))) as location_chars from reports",
    "fnv_hashes": "select n_name, cast(list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(n_name, ''), lambda x: ascii(x)::ubigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as bigint) as hash from nation",
    "place_texts": "select place_id, concat_ws(', ', city, case when place_id % 3 <> 0 then state_province end, country) as place from place_ref",
    "clock_texts": f"""with {_ONE}, t as (select canonical_input_id, lower(time_raw) as low, regexp_replace(lower(trim(time_raw)), '^(?:at|approx\\.?|about)\\s+|\\s*(?:hrs|hours)$', '', 'g') as x from c),
        p as (select *, regexp_extract(x, '^(\\d{{1,2}})[:h](\\d{{2}})(?::\\d{{2}}(?:\\.\\d+)?)?$', ['h', 'm']) as a, regexp_extract(x, '^(\\d{{2}})(\\d{{2}})$', ['h', 'm']) as b, regexp_extract(x, '^(\\d{{1,2}})(?:[:.](\\d{{2}}))?\\s*([ap])\\.?m\\.?$', ['h', 'm', 'p']) as d from t),
        n as (select *, try_cast(coalesce(nullif(a.h, ''), nullif(b.h, '')) as int) as h, try_cast(coalesce(nullif(a.m, ''), nullif(b.m, '')) as int) as m, try_cast(nullif(d.h, '') as int) as h12, coalesce(try_cast(nullif(d.m, '') as int), 0) as m12 from p),
        r as (select canonical_input_id, coalesce(case when h <= 23 and m <= 59 then h * 60 + m end, case when h12 between 1 and 12 and m12 <= 59 then (h12 % 12 + case when d.p = 'p' then 12 else 0 end) * 60 + m12 end) as minutes,
        case {' '.join(f"when contains(low, '{w}') then {v[2]}" for w, v in dates.BUCKETS.items())} end as bucket_mid from n) select * from r where minutes is not null or bucket_mid is not null""",
    "day_ordinals": "select distinct cast(o_orderdate as date) as day, cast(o_orderdate as date) - date '1970-01-01' as unix_day, cast(o_orderdate as date) - date '0001-01-01' + 1 as ordinal, cast(strftime(o_orderdate, '%Y%m%d') as int) as day_key from orders",
    "shape_classes": f"""with {_ONE}, s as (select {_class_sql('shape_raw', 'a')}, {_class_sql('summary', 'b')}, {_class_sql('description', 'd')} from c) select coalesce(a, b, d, 'unknown') as label, case when a is not null then 'shape' when b is not null then 'summary' when d is not null then 'description' end as source,
        case when a is not null then 'high' when b is not null then 'medium' when d is not null then 'low' else 'none' end as confidence, count(*) as n from s group by all""",
    "geo_measures": f"""with {EVENTS_SQL}, m as (select event_id, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(10.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(10.0)) * pow(sin(radians(20.0 - lon) / 2), 2)))) as km,
        degrees(atan2(sin(radians(20.0 - lon)) * cos(radians(10.0)), cos(radians(lat)) * sin(radians(10.0)) - sin(radians(lat)) * cos(radians(10.0)) * cos(radians(20.0 - lon)))) as d, lat, lon from ev)
        select event_id, round(km, 3) as km, round(case when not (lat = 10 and lon = 20) then (d + 360) - 360 * floor((d + 360) / 360) end, 4) as bearing, case when km + 40 <= 5000 then 'near' when km - 40 > 5000 then 'far' else 'ambiguous' end as class from m""",
    "tumbling_1d": f"with {EVENTS_SQL} select day as start, type, count(*) as n from ev group by 1, 2",
    "sliding_7d_1d": f"with {EVENTS_SQL} select day - o::int as start, count(*) as n from ev, range(7) t(o) group by 1",
    "session_30m": f"with {EVENTS_SQL}, l as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from ev), g as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from l) select user_id, cast(floor(epoch(min(ts))) as bigint) as start, count(*) as n from g group by user_id, s",
    "stream_tumbling": "select cast(ts as date) as start, event_type, count(*) as n from events where cast(ts as date) + 1 <= (select max(ts) - interval 1 hour from events) group by 1, 2",
    "local_times": """with t as (select o_orderkey, o_orderdate + interval 30 minute as at_local from orders) select o_orderkey, timezone('UTC', timezone('America/New_York', at_local)) as utc,
        case when timezone('America/New_York', timezone('America/New_York', at_local)) <> at_local then 'missing' else 'exact' end as state from t""",
    "text_coordinates": f"""with {_ONE}, p as (select canonical_input_id, regexp_extract(location_raw, '(-?\\d{{1,2}}\\.\\d+)\\s*[,; ]\\s*(-?\\d{{1,3}}\\.\\d+)', ['a', 'b']) as d, regexp_extract(location_raw, '(\\d{{1,2}}(?:\\.\\d+)?)\\s*°?\\s*([NS])[,;\\s]+(\\d{{1,3}}(?:\\.\\d+)?)\\s*°?\\s*([EW])', ['a', 's', 'b', 'w']) as h from c),
        n as (select canonical_input_id, coalesce(try_cast(nullif(h.a, '') as double) * case h.s when 'S' then -1 else 1 end, try_cast(nullif(d.a, '') as double)) as lat, coalesce(try_cast(nullif(h.b, '') as double) * case h.w when 'W' then -1 else 1 end, try_cast(nullif(d.b, '') as double)) as lon from p)
        select * from n where abs(lat) <= 90 and abs(lon) <= 180""",
    "stream_deduplicated": "select event_type, count(*) as n from events group by 1",
    "chunked_manifest": "select count(*) as rows, min(o_orderkey) as first, max(o_orderkey) as last, true as bounded from orders",
    "json_round_trip": "select n_nationkey, n_name, n_regionkey from nation",
    "cache_latest": "select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2",
    "dictionary_codes": "select p_partkey, dense_rank() over (order by p_brand) - 1 as p_brand_code, dense_rank() over (order by p_type) - 1 as p_type_code from part",
    "filtered_segments": f"with {EVENTS_SQL}, f as (select * from ev where value > 0), n as (select event_id, day, lead(event_id) over w as n_id, lead(day) over w as n_day from f window w as (partition by user_id order by ts, cast(event_id as varchar))) select event_id || '->' || n_id as trace_id, abs(n_day - day) as gap_days from n where n_id is not null",
}
