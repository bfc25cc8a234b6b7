"""Core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.operators.instants import normalise_instants
from nightloom.operators.nearby import within_distance, within_regions
from nightloom.plans import assessments, catalogue, evidence, merging, review, spatial, statistics, texts
from nightloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "canonical_input").selectExpr("canonical_input_id as id", "lat", "lon").where("not (lat = 0 and lon = 0)")
    sites = table(spark, sf_dir, "facility_point").selectExpr("facility_key as site", "lat", "lon")
    return within_distance(points, sites, 5.0).selectExpr("id as canonical_input_id", "site as facility_key")


#: Rings of latitude and longitude: a five-sided one, one with a notch, one over the date line, and one that overlaps the first.
REGIONS = {
    "plains": [(30.0, -115.0), (42.0, -118.0), (49.0, -104.0), (45.0, -95.0), (31.0, -90.0)], "north sea": [(50.0, -6.0), (60.0, -6.0), (60.0, 10.0), (55.0, 0.0), (50.0, 10.0)],
    "pacific": [(-50.0, 160.0), (10.0, 150.0), (20.0, 200.0), (-45.0, 190.0)], "south": [(20.0, -110.0), (36.0, -110.0), (36.0, -75.0), (20.0, -75.0)],
}


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the regions hold each position."""
    points = table(spark, sf_dir, "canonical_input").selectExpr("canonical_input_id as id", "lat", "lon").where("not (lat = 0 and lon = 0)")
    rings = spark.createDataFrame([(name, [(float(a), float(b)) for a, b in ring]) for name, ring in REGIONS.items()], "region string, ring array<struct<lat:double,lon:double>>")
    return within_regions(points, rings).select(F.col("id").alias("canonical_input_id"), "region")


def _regions_sql() -> str:
    tests = []
    for name, ring in REGIONS.items():
        edges = [f"case when ({y1} > lat) <> ({y2} > lat) and x < {x1} + (lat - {y1}) * ({x2 - x1}::double / {y2 - y1}::double) then 1 else 0 end" for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True) if y1 != y2]
        tests.append(f"select canonical_input_id, '{name}' as region from p where ({' + '.join(edges)}) % 2 = 1")
    return " union ".join(tests)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalise_instants(table(spark, sf_dir, "canonical_input"), table(spark, sf_dir, "source_registry"))
    return found.select("canonical_input_id", "utc_seconds")


def p6_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: records with an instant, those with several readings, and those read alike without the registered orders."""
    records, registry = table(spark, sf_dir, "canonical_input"), table(spark, sf_dir, "source_registry")
    known = normalise_instants(records, registry).select("canonical_input_id", F.col("utc_seconds").alias("known"))
    guess = normalise_instants(records, registry.withColumn("date_order", F.lit(None).cast("string")))
    of = records.select("canonical_input_id", "source_name").dropDuplicates(["canonical_input_id"])
    both = known.join(guess, "canonical_input_id").join(of, "canonical_input_id")
    return both.groupBy("source_name").agg(F.count("*").alias("records"), F.count_if(F.col("readings") > 1).alias("several"), F.count_if(F.col("known") == F.col("utc_seconds")).alias("alike"))


P4_SQL = """
with s as (
  select distinct facility_key, lat, ((lon + 180) - 360 * floor((lon + 180) / 360)) - 180 as lon from facility_point
  where facility_key is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90
), p as (
  select distinct canonical_input_id, lat, ((lon + 180) - 360 * floor((lon + 180) / 360)) - 180 as lon from canonical_input
  where lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and not (lat = 0 and lon = 0)
)
select distinct canonical_input_id, facility_key from p, s
where abs(p.lat - s.lat) <= 0.05
  and 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p4_found": p4_found, "p4_regions": p4_regions, "p6_found": p6_found, "p6_inferred": p6_inferred}
for part in (catalogue, statistics, spatial, texts, evidence, assessments, review, merging):
    QUERIES |= part.QUERIES
P4_REGIONS_SQL = f"""with p as (select distinct canonical_input_id, lat, ((lon + 180) - 360 * floor((lon + 180) / 360)) - 180 + turn as x from canonical_input, (values (-360.0::double), (0.0), (360.0)) t(turn)
  where canonical_input_id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon) and abs(lat) <= 90 and not (lat = 0 and lon = 0)) {_regions_sql()}"""

SQL: dict[str, str] = {"p4_found": P4_SQL, "p4_regions": P4_REGIONS_SQL}
for part in (catalogue, statistics, spatial, texts, evidence, assessments, review, merging):
    SQL |= part.SQL

#: Sums of whole numbers are wider in the SQL engine than here; they are brought to the same type.
WHOLE = {
    "cohort_previous_period": ("active_total", "reference_total"), "cohort_other_dates": ("active_total", "reference_total"), "cohort_full_overlap": ("active_total", "reference_total"), "adaptive_bins": ("n",), "rolling_bins": ("rolling",),
    "crosstab_residuals": ("observed",), "loo_source_range": ("n",), "calendar_exposure_ratio": ("observed",), "moon_phase_exposure": ("observed",), "lookup_worklist": ("score",), "evidence_atlas": ("n",), "catalogue_analysis": ("a", "c"),
    "source_exclusions": ("a",), "merge_opportunities": ("records", "removable"), "merge_family_groups": ("records", "removable"),
}
for name, columns in WHOLE.items():
    SQL[name] = f"select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in columns)}) from ({SQL[name]})"
