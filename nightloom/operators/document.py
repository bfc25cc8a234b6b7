"""The analysis document: every category of several families compared between a cohort and its reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.stats import benjamini_hochberg, mantel_haenszel, newcombe, rate, standardized_difference
from nightloom.operators.review import findings
from nightloom.session import cut, small

SIDES = ("a", "a_total", "c", "c_total")
KEYS = ["family", "key"]


def comparison_cells(labelled: DataFrame, families: dict[str, Column], stratum: Column, source: Column) -> DataFrame:
    """family, key, stratum, source, a, a_total, c, c_total: counts of both sides of rows labelled active and reference.

    One pass over the rows, one shuffle of counts. A null category, stratum or
    source is 'unknown'. Every category has a row for each stratum and source there
    is, without any count too: these are pairs of labels, as many as a table of them.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    # the whole is a family of its own with one category, from which the totals come
    kinds = F.array(F.struct(F.lit("").alias("family"), F.lit("").alias("key")), *[F.struct(F.lit(f).alias("family"), name(c).alias("key")) for f, c in families.items()])
    long = labelled.select("active", "reference", name(stratum).alias("stratum"), name(source).alias("source"), F.explode(kinds).alias("x")).select("active", "reference", "stratum", "source", "x.*")
    n = cut(long.groupBy(*KEYS, "stratum", "source").agg(F.count_if("active").alias("a"), F.count_if("reference").alias("c")))
    totals = n.where("family = ''").select("stratum", "source", F.col("a").alias("a_total"), F.col("c").alias("c_total"))
    places = totals.select("stratum").distinct().join(small(totals.select("source").distinct())).join(totals, ["stratum", "source"], "left")
    grid = n.where("family <> ''").select(*KEYS).distinct().join(small(places))
    return grid.join(n, [*KEYS, "stratum", "source"], "left").fillna(0, list(SIDES)).select(*KEYS, "stratum", "source", *SIDES)


def without_each_source(cells: DataFrame) -> DataFrame:
    """family, key, source, a, odds_ratio, or_lower, or_upper, z of the estimates that leave each source out: what it adds to a stratum is taken off its sum."""
    w = Window.partitionBy(*KEYS, "stratum")
    rest = cells.select(*KEYS, "stratum", "source", *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in SIDES])
    observed = rest.groupBy(*KEYS, "source").agg(F.sum("a").alias("a"))
    return observed.join(mantel_haenszel(rest, [*KEYS, "source"]), [*KEYS, "source"]).select(*KEYS, "source", "a", "odds_ratio", "or_lower", "or_upper", "z")


def analysis_document(cells: DataFrame, least: int = 25) -> DataFrame:
    """One row per family and key of ``comparison_cells``: counts and shares, the plain and the standardised difference with its interval and support, the stratified odds ratio with z, p and q, stability and whether it is a finding.

    status: stable if every estimate without one source keeps the direction, an
    interval off 1 and ``least`` cases; single_source_only where one source alone
    has cases; else sensitive. q is within a family. A finding is stable and passes
    the gates of ``review.findings``.
    """
    cells = cut(cells)
    strata = cells.groupBy(*KEYS, "stratum").agg(*[F.sum(c).alias(c) for c in SIDES])
    whole = strata.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SIDES])
    a, na, c, nc = (F.col(x) for x in SIDES)
    low, high = newcombe(a, na, c, nc)
    plain = whole.select(*KEYS, "a", "c", rate(a, na).alias("active_share"), rate(c, nc).alias("reference_share"), low.alias("lower"), high.alias("upper"), ((a + c) * na / F.nullif(na + nc, F.lit(0))).alias("expected"))
    adjusted = standardized_difference(strata, KEYS).select(*KEYS, F.col("effect").alias("difference"), "support")
    tested = benjamini_hochberg(mantel_haenszel(strata, KEYS), "p", "key", ["family"]).drop("strata")
    sources = cells.where("a > 0").groupBy(*KEYS).agg(F.countDistinct("source").alias("_sources"))
    each = without_each_source(cells).join(tested.select(*KEYS, F.col("odds_ratio").alias("_whole")), KEYS)
    holds = (F.col("a") >= least) & ((F.col("odds_ratio") > 1) == (F.col("_whole") > 1)) & ((F.col("or_lower") > 1) | (F.col("or_upper") < 1))
    kept = each.groupBy(*KEYS).agg(F.min(F.coalesce(holds, F.lit(False))).alias("_holds"))
    out = reduce(lambda x, y: x.join(y, KEYS, "left"), [plain, adjusted, tested, sources, kept])
    status = F.when(F.coalesce("_sources", F.lit(0)) < 2, "single_source_only").when(F.col("_holds"), "stable").otherwise("sensitive")
    judged = out.withColumns({"status": status, "n": F.col("a"), "ratio": rate(F.col("active_share"), F.col("reference_share"))})
    return judged.withColumn("finding", F.coalesce(findings(judged) & (F.col("status") == "stable"), F.lit(False))).drop("_sources", "_holds", "n", "ratio")
