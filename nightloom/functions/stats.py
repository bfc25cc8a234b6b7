"""Closed-form statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def rate(count: Column, total: Column) -> Column:
    """count / total, 0 for a total of 0."""
    return F.when(total > 0, count / total).otherwise(F.lit(0.0))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Rounded with halves towards plus infinity."""
    f = float(10**digits)
    return F.floor(value * f + 0.5) / f


def erf(x: Column) -> Column:
    """The error function by the rational approximation of Abramowitz and Stegun 7.1.26."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    # The approximation's coefficients.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p value."""
    return F.lit(1.0) - erf(F.abs(z) / F.lit(2.0**0.5))


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval (lower, upper); (0, 1) for a total of 0."""
    n = F.nullif(total, F.lit(0)).cast("double")
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.coalesce(F.greatest(centre - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(centre + half, F.lit(1.0)), F.lit(1.0))


def newcombe(a: Column, na: Column, b: Column, nb: Column) -> tuple[Column, Column]:
    """Newcombe interval of the difference of two proportions, within -1 and 1."""
    (l1, u1), (l2, u2) = wilson(a, na), wilson(b, nb)
    p1, p2 = rate(a, na), rate(b, nb)
    low = (p1 - p2) - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2))
    high = (p1 - p2) + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))
    return F.greatest(low, F.lit(-1.0)), F.least(high, F.lit(1.0))


def two_proportions(a: Column, na: Column, b: Column, nb: Column) -> tuple[Column, Column]:
    """(z, p) of the pooled test; (0, 1) without spread."""
    pooled = (a + b) / F.nullif((na + nb).cast("double"), F.lit(0.0))
    se = F.nullif(F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(na.cast("double"), F.lit(0.0)) + 1 / F.nullif(nb.cast("double"), F.lit(0.0)))), F.lit(0.0))
    z = F.coalesce((rate(a, na) - rate(b, nb)) / se, F.lit(0.0))
    return z, F.when(se.isNull(), 1.0).otherwise(two_sided_p(z))


def mantel_haenszel(strata: DataFrame, keys: list[str]) -> DataFrame:
    """Cochran-Mantel-Haenszel test with the Robins-Breslow-Greenland interval, one row per key.

    ``strata``: keys, a and a_total (active), c and c_total (reference), one row a
    stratum. Strata without both sides add nothing.
    """
    s = strata.where("a_total > 0 and c_total > 0")
    cols = {
        "x": F.col("a").cast("double"), "m": (F.col("a") + F.col("c")).cast("double"), "n1": F.col("a_total").cast("double"), "n0": F.col("c_total").cast("double"),
    }
    s = s.select(*keys, *[v.alias(k) for k, v in cols.items()]).withColumn("n", F.col("n1") + F.col("n0"))
    s = s.withColumns({"b": F.expr("n1 - x"), "c": F.expr("m - x"), "d": F.expr("n0 - (m - x)")})
    sums = {
        "o": "x", "e": "n1 * m / n", "v": "case when n > 1 then n1 * n0 * m * (n - m) / (n * n * (n - 1)) else 0 end",
        "r": "x * d / n", "s": "b * c / n", "pr": "(x + d) / n * x * d / n", "ps": "(x + d) / n * b * c / n + (b + c) / n * x * d / n", "qs": "(b + c) / n * b * c / n", "total": "n",
    }
    g = s.groupBy(*keys).agg(*[F.sum(F.expr(e)).alias(f"_{k}") for k, e in sums.items()], F.count("*").alias("strata"))
    z = F.expr("case when _v > 0 then (_o - _e) / sqrt(_v) else 0 end")
    ratio = F.expr("case when _s > 0 then _r / _s end")
    se = F.expr("sqrt(_pr / (2 * _r * _r) + _ps / (2 * _r * _s) + _qs / (2 * _s * _s))")
    safe = F.expr("_r > 0 and _s > 0")
    return g.select(
        *keys, "strata", z.alias("z"), two_sided_p(z).alias("p"), ratio.alias("odds_ratio"),
        F.when(safe, F.exp(F.log(ratio) - Z95 * se)).alias("or_lower"), F.when(safe, F.exp(F.log(ratio) + Z95 * se)).alias("or_upper"), F.sqrt(z * z / F.col("_total")).alias("cramers_v"),
    )


def standardized_difference(strata: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of shares standardised to the active side on common strata, with its support (eligible from 0.80)."""
    w = Window.partitionBy(*keys)
    s = strata.withColumn("common", (F.col("a_total") > 0) & (F.col("c_total") > 0)).withColumn("all_active", F.sum("a_total").over(w))
    s = s.where("common").withColumn("base", F.sum("a_total").over(w).cast("double"))
    s = s.withColumn("w", F.col("a_total") / F.col("base"))
    g = s.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("a") / F.col("a_total")).alias("adjusted_active"), F.sum(F.col("w") * F.col("c") / F.col("c_total")).alias("adjusted_reference"),
        F.max(F.col("base") / F.col("all_active")).alias("support"), F.greatest(F.lit(1.0), F.floor(1 / F.sum(F.col("w") * F.col("w") / F.col("c_total")) + 0.5)).alias("effective_reference"),
    )
    return g.withColumn("effect", F.col("adjusted_active") - F.col("adjusted_reference")).withColumn("eligible", F.col("support") >= 0.80)


def benjamini_hochberg(tests: DataFrame, p: str, order: str, family: list[str]) -> DataFrame:
    """Adds q: p times tests by rank, made monotone from the largest down, at most 1; a family is a list of tests, not of rows."""
    rank = Window.partitionBy(*family).orderBy(p, order)
    whole = Window.partitionBy(*family)
    ranked = tests.withColumn("_rank", F.row_number().over(rank)).withColumn("_m", F.count("*").over(whole))
    after = rank.rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(after))).drop("_rank", "_m")


def residuals(cells: DataFrame, row: str, column: str, stratum: str, count: str) -> DataFrame:
    """Stratified expected counts, standardised residuals and log2 ratios of a cross-tab.

    ``cells`` is an aggregated table; margins are sums over it, not over the rows behind it.
    """
    # a row and column that meet in a stratum without a count still have an expectation there
    r = cells.groupBy(stratum, row).agg(F.sum(count).alias("r"))
    c = cells.groupBy(stratum, column).agg(F.sum(count).alias("c"))
    n = cells.groupBy(stratum).agg(F.sum(count).alias("n"))
    grid = r.join(c, stratum).join(n, stratum).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    grid = grid.withColumn("v", F.expr("e * (1 - r / n) * (1 - c / n)"))
    expected = grid.groupBy(row, column).agg(F.sum("e").alias("expected"), F.sum("v").alias("variance"))
    seen = cells.groupBy(row, column).agg(F.sum(count).alias("observed"))
    out = expected.join(seen, [row, column], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return out.withColumns({"residual": F.expr("case when variance > 0 then (observed - expected) / sqrt(variance) end"), "log2_ratio": F.expr("case when observed > 0 and expected > 0 then log2(observed / expected) end")})


def frequency_quantile(table: DataFrame, value: str, count: str, q: float) -> DataFrame:
    """The nearest-rank quantile of a table of counts: the least value at which ceil(q n) is reached."""
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = table.withColumn("_to", F.sum(count).over(w)).crossJoin(table.agg(F.sum(count).alias("_n")))
    return ranked.where(F.col("_to") >= F.ceil(F.col("_n") * q)).agg(F.min(value).alias("quantile"))
