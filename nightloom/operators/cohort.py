"""Cohorts against references: labels, balanced shares, bins, bursts, funnels and crosses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_cohorts(rows: DataFrame, day: str, start: str, end: str, baseline: str) -> DataFrame:
    """Adds active and reference by a baseline: other_dates_balanced, previous_equal_duration or full_catalog.

    Under full_catalog a row can be on both sides. Undated rows are never active.
    """
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    active = F.coalesce(F.col(day).between(low, high), F.lit(False))
    if baseline == "full_catalog":
        reference = F.lit(True)
    elif baseline == "other_dates_balanced":
        reference = F.col(day).isNotNull() & ~active
    elif baseline == "previous_equal_duration":
        length = F.date_diff(high, low) + 1
        reference = ~active & F.coalesce(F.col(day).between(F.date_add(low, -length), F.date_add(low, -1)), F.lit(False))
    else:
        raise ValueError(baseline)
    return rows.withColumns({"active": active, "reference": reference})


def baseline_state(baseline: str, active: int, reference: int) -> str:
    """inferential, descriptive_overlap, or why there is no comparison."""
    if baseline == "full_catalog":
        return "descriptive_overlap"
    if not active:
        return "unavailable_no_active"
    return "inferential" if reference else "unavailable_no_reference"


def count_sides(labelled: DataFrame, *by: str) -> DataFrame:
    """by, active_n, reference_n with the totals of both sides over all rows; one shuffle of partial counts."""
    n = labelled.groupBy(*by).agg(F.count_if("active").alias("active_n"), F.count_if("reference").alias("reference_n")).where("active_n + reference_n > 0")
    total = n.agg(F.sum("active_n").alias("active_total"), F.sum("reference_n").alias("reference_total"))
    return n.crossJoin(F.broadcast(total))


def balanced_shares(rows: DataFrame, source: str, period: str) -> DataFrame:
    """period, share: the mean over all sources of each source's own share; an absent source counts as 0."""
    n = rows.where(F.col(period).isNotNull()).groupBy(source, period).agg(F.count("*").alias("n"))
    of = n.groupBy(source).agg(F.sum("n").alias("of"))
    sources = of.agg(F.count("*").alias("sources"))
    return n.join(of, source).crossJoin(F.broadcast(sources)).groupBy(period).agg((F.sum(F.col("n") / F.col("of")) / F.max("sources")).alias("share"))


def adaptive_bins(counts: DataFrame, year: str, n: str) -> DataFrame:
    """bin_start, width, n: bins of 1, 5 or 10 years by the span and density of the years; empty bins are dropped."""
    span = counts.where(F.col(n) > 0).agg((F.max(year) - F.min(year) + 1).alias("span"), F.countDistinct(year).alias("years"))
    density = F.col("years") / F.col("span")
    width = F.when((F.col("span") <= 40) | ((F.col("span") <= 80) & (density >= 0.25)), 1).when((F.col("span") <= 300) & (density >= 0.10), 5).otherwise(10)
    both = counts.crossJoin(F.broadcast(span.select(width.alias("width"))))
    return both.groupBy((F.floor(F.col(year) / F.col("width")) * F.col("width")).alias("bin_start"), "width").agg(F.sum(n).alias("n")).where("n > 0")


def bursts(counts: DataFrame, period: str, n: str, least: int = 25, least_mean: float = 10.0, ratio: float = 1.5, sigmas: float = 3.0, least_total: int = 200) -> DataFrame:
    """Periods far above the mean of the five before (gaps count as 0); nothing when there are too few counts in all.

    ``counts`` is one row a period: the window runs over the aggregate, not over the rows.
    """
    before = Window.orderBy(period).rangeBetween(-5, -1)
    whole = counts.agg(F.sum(n).alias("_total"), F.min(period).alias("_first"))
    out = counts.withColumn("trailing_mean", F.coalesce(F.sum(n).over(before), F.lit(0)) / 5).crossJoin(F.broadcast(whole))
    deviation = (F.col(n) - F.col("trailing_mean")) / F.sqrt("trailing_mean")
    keep = (F.col("_total") >= least_total) & (F.col(period) >= F.col("_first") + 5) & (F.col(n) >= least) & (F.col("trailing_mean") >= least_mean) & (F.col(n) / F.col("trailing_mean") >= ratio) & (deviation >= sigmas)
    return out.where(keep).select(period, n, "trailing_mean", deviation.alias("deviation"))


def rolling_bins(binned: DataFrame, start: str, width: int, n: str) -> DataFrame:
    """Adds rolling: the sum over the five bins up to each."""
    return binned.withColumn("rolling", F.sum(n).over(Window.orderBy(start).rangeBetween(-4 * width, 0)))


def funnel(rows: DataFrame, stages: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Rows left after each stage, every stage within the ones before it, as columns."""
    held, cols = F.lit(True), []
    for name, test in stages.items():
        held = held & F.coalesce(test, F.lit(False))
        cols.append(F.count_if(held).alias(name))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("all_rows"), *cols)


def pool_rare(rows: DataFrame, column: str, keep: int, other: str = "Other") -> DataFrame:
    """``column`` with all but its ``keep`` most frequent values pooled; ties in alphabetical order."""
    n = rows.groupBy(column).agg(F.count("*").alias("_n"))
    top = n.where(F.col(column).isNotNull()).orderBy(F.desc("_n"), column).limit(keep).select(column, F.lit(True).alias("_top"))
    return rows.join(F.broadcast(top), column, "left").withColumn(column, F.when(F.col("_top"), F.col(column)).when(F.col(column).isNotNull(), other)).drop("_top")


def cross_with_margins(rows: DataFrame, a: str, b: str) -> DataFrame:
    """level (cell, row, column, all), both labels (null in a margin) and n, unknown labels as 'Unknown'; one pass of grouping sets."""
    known = rows.select(F.coalesce(F.col(a).cast("string"), F.lit("Unknown")).alias(a), F.coalesce(F.col(b).cast("string"), F.lit("Unknown")).alias(b))
    sets = known.cube(a, b).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    level = F.when(F.col("_g") == 0, "cell").when(F.col("_g") == 1, "row").when(F.col("_g") == 2, "column").otherwise("all")
    return sets.select(level.alias("level"), a, b, "n")


def compare_groups(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: ids in both, only left, only right and in either; ids count once."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.expr("_l = 1 and _r = 1")).alias("overlap"), F.count_if(F.expr("_l = 1 and _r is null")).alias("only_left"), F.count_if(F.expr("_l is null and _r = 1")).alias("only_right"), F.count("*").alias("either"))


def compare_domain(left: DataFrame, right: DataFrame, category: str) -> DataFrame:
    """category, both counts and shares of eligible rows and their difference; a category missing on a side counts 0 there."""

    def side(df: DataFrame, name: str) -> DataFrame:
        n = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias(f"{name}_n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum(f"{name}_n").alias(f"{name}_total"))))

    both = side(left, "left").join(side(right, "right"), category, "full")
    share = lambda s: F.coalesce(F.col(f"{s}_n") / F.col(f"{s}_total"), F.lit(0.0))
    return both.select(category, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"), share("left").alias("left_share"), share("right").alias("right_share"), (share("left") - share("right")).alias("difference"))


def mask_counts(rows: DataFrame, mask: str, labels: list[str]) -> DataFrame:
    """label, n, reports: rows with each bit, beside the rows with any bit; labels overlap, so their sum exceeds the reports."""
    bits = F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(labels)]))
    any_bit = reduce(lambda a, b: a | b, [F.col(mask).bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(labels))])
    total = rows.where(any_bit).agg(F.count("*").alias("reports"))
    return rows.select(F.explode(bits).alias("label")).groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))


def leave_one_out(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """excluded, n, mean: the mean of ``value`` without each group in turn, from the groups' sums alone."""
    g = rows.groupBy(group).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    total = g.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    return g.crossJoin(F.broadcast(total)).select(F.col(group).alias("excluded"), (F.col("_tn") - F.col("_n")).alias("n"), ((F.col("_ts") - F.col("_s")) / F.nullif(F.col("_tn") - F.col("_n"), F.lit(0))).alias("mean"))


def supported_strata(rows: DataFrame, fine: str, coarse: str, least: int = 20) -> DataFrame:
    """Adds stratum: the fine one if it has ``least`` rows, else the coarse one if that has, else null; counts are joined back, not windowed."""
    f = rows.groupBy(fine).agg(F.count("*").alias("_f"))
    c = rows.groupBy(coarse).agg(F.count("*").alias("_c"))
    both = rows.join(f, fine, "left").join(c, coarse, "left")
    return both.withColumn("stratum", F.when(F.col("_f") >= least, F.concat(F.lit("fine:"), fine)).when(F.col("_c") >= least, F.concat(F.lit("coarse:"), coarse))).drop("_f", "_c")
