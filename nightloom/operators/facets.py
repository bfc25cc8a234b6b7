"""Facet counts, each with the other selections applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.operators.predicates import FACETS, Filters, every


def drill_sideways(rows: DataFrame, filters: Filters) -> DataFrame:
    """facet, value, n: counts of every facet under the other facets' selections, and of the legend under all but its own.

    One scan: each row becomes one (facet, value) pair for every facet it counts
    for; empty and null labels are not counted. Partial counts precede the shuffle.
    """
    pairs = []
    for facet in FACETS:
        ok = every([filters.selection(f) for f in FACETS if f != facet])
        pairs.append(F.when(ok & filters.in_legend(), F.struct(F.lit(facet).alias("facet"), F.col(facet).alias("value"))))
    if "legend" in rows.columns:
        pairs.append(F.when(every([filters.selection(f) for f in FACETS]), F.struct(F.lit("legend").alias("facet"), F.col("legend").alias("value"))))
    long = rows.where(filters.base()).select(F.explode(F.array_compact(F.array(*pairs))).alias("x")).select("x.*")
    return long.where(F.trim("value") != "").groupBy("facet", "value").agg(F.count("*").alias("n"))


def filtered_ids(rows: DataFrame, filters: Filters) -> DataFrame:
    """event_id of the rows that pass all filters but the dates."""
    undated = Filters(filters.selected, filters.reject, filters.hide_low_precision, filters.exact_day_only, filters.legend)
    return rows.where(undated.whole()).select("event_id")


def legend_counts(rows: DataFrame, filters: Filters) -> DataFrame:
    """legend, n: counts with the legend's own filter dropped, dates applied."""
    return rows.where(filters.base() & every([filters.selection(f) for f in FACETS])).where(F.trim("legend") != "").groupBy("legend").agg(F.count("*").alias("n"))
