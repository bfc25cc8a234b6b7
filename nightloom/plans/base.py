"""The catalogue views that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions.unknown import clean
from nightloom.session import table


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per source record: labels cleaned, positions checked, dates where the import gave one."""
    ci = table(spark, sf_dir, "canonical_input").select(
        "canonical_input_id", "source_name", "source_native_id", "date_precision", "time_raw", "location_raw", "description", "lat", "lon",
        "coordinate_source", "shape_normalized", "type_raw", "state_province", "country", "date_iso", "summary",
    )
    fine = F.col("lat").isNotNull() & ~F.isnan("lat") & (F.abs("lat") <= 90) & F.col("lon").isNotNull() & ~F.isnan("lon") & (F.abs("lon") <= 180)
    return ci.dropDuplicates(["canonical_input_id"]).select(
        F.col("canonical_input_id").alias("event_id"), F.col("source_name").alias("source"), F.lower(clean(F.col("type_raw"))).alias("type"), F.lower(F.trim("date_precision")).alias("precision"),
        F.lower(F.trim("date_precision")).alias("date_precision"), F.lower(clean(F.col("shape_normalized"))).alias("craft"), F.lower(clean(F.col("country"))).alias("country"),
        F.lower(clean(F.col("coordinate_source"))).alias("coordinate_source"),
        F.when(fine, F.col("lat")).alias("lat"), F.when(fine, F.col("lon")).alias("lon"), F.try_to_date(F.when(F.col("date_iso").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("date_iso"))).alias("day"),
        clean(F.col("description")).alias("description"), clean(F.col("location_raw")).alias("location"), F.col("source_native_id").alias("native_id"), clean(F.col("time_raw")).alias("time_raw"),
    )


_NOTHING = "('', 'unknown', 'unk', 'n/a', 'na', 'none', 'null', '-', 'unresolved', 'not_provided')"


def clean_sql(column: str) -> str:
    return f"case when lower(trim(regexp_replace({column}, '\\s+', ' ', 'g'))) not in {_NOTHING} then trim({column}) end"


_FINE = "lat is not null and not isnan(lat) and abs(lat) <= 90 and lon is not null and not isnan(lon) and abs(lon) <= 180"

REPORTS_SQL = f"""reports as (
  select canonical_input_id as event_id, source_name as source, lower({clean_sql("type_raw")}) as type, lower(trim(date_precision)) as precision, lower(trim(date_precision)) as date_precision,
         lower({clean_sql("shape_normalized")}) as craft, lower({clean_sql("country")}) as country, lower({clean_sql("coordinate_source")}) as coordinate_source,
         case when {_FINE} then lat end as lat, case when {_FINE} then lon end as lon,
         case when regexp_matches(date_iso, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then try_cast(date_iso as date) end as day,
         {clean_sql("description")} as description, {clean_sql("location_raw")} as location, source_native_id as native_id, {clean_sql("time_raw")} as time_raw
  from (select *, row_number() over (partition by canonical_input_id order by ingested_at) as k from canonical_input) where k = 1
)"""


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with a source, a day and a position derived from its ids."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", F.col("event_type").alias("type"), "value", "props", F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("source"), F.to_date("ts").alias("day"),
        (((F.col("event_id") * 7919) % 17000).cast("double") / 100 - 85).alias("lat"), (((F.col("event_id") * 104729) % 36000).cast("double") / 100 - 180).alias("lon"),
        F.concat(F.lit("p"), F.hour("ts").cast("string")).alias("precision"),
    )


EVENTS_SQL = """ev as (
  select event_id, ts, user_id, event_type as type, value, props, 's' || cast(user_id % 5 as varchar) as source, cast(ts as date) as day,
         cast((event_id * 7919) % 17000 as double) / 100 - 85 as lat, cast((event_id * 104729) % 36000 as double) / 100 - 180 as lon, 'p' || cast(hour(ts) as varchar) as precision
  from events
)"""


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )
