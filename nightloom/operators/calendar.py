"""Counts against what the calendar alone would give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mean synodic month in days and a new moon (2000-01-06 18:14 UTC) as days since 1970.
SYNODIC, NEW_MOON = 29.530588853, 10962.759722


def calendar_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """day of a date range, one row each."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def moon_phase(day: Column) -> Column:
    """Index 0 (new) to 7 of the mean moon phase at noon UTC."""
    age = F.pmod(F.unix_date(day) + 0.5 - NEW_MOON, F.lit(SYNODIC)) / SYNODIC
    return F.floor(age * 8 + 0.5).cast("int") % 8


def exposure(events: DataFrame, calendar: DataFrame, day: str, bin_of: Column) -> DataFrame:
    """bin, observed, expected, ratio: expected counts spread each month's events over its days.

    ``bin_of`` is an expression over ``day``; the calendar is one row a day and is
    reduced to (month, bin) before it meets the events' monthly counts.
    """
    month = F.trunc("day", "month")
    days = calendar.select(month.alias("month"), bin_of.alias("bin")).groupBy("month", "bin").agg(F.count("*").alias("days"))
    of = days.groupBy("month").agg(F.sum("days").alias("all_days"))
    seen = events.select(F.col(day).alias("day")).where("day is not null").select(month.alias("month"), bin_of.alias("bin")).groupBy("month", "bin").agg(F.count("*").alias("n"))
    monthly = seen.groupBy("month").agg(F.sum("n").alias("month_n"))
    expected = days.join(of, "month").join(monthly, "month").groupBy("bin").agg(F.sum(F.col("month_n") * F.col("days") / F.col("all_days")).alias("expected"))
    observed = seen.groupBy("bin").agg(F.sum("n").alias("observed"))
    return expected.join(observed, "bin", "left").select("bin", F.coalesce("observed", F.lit(0)).alias("observed"), "expected", (F.coalesce("observed", F.lit(0)) / F.col("expected")).alias("ratio"))
