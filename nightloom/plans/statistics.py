"""Cohort comparisons and closed-form statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightloom.functions import stats
from nightloom.operators import cohort, resampling
from nightloom.plans.base import EVENTS_SQL, REPORTS_SQL, reports, stream_events
from nightloom.session import table


def _labelled(spark: SparkSession, sf_dir: str, baseline: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("year"))
    return cohort.label_cohorts(o, "day", "1997-01-01", "1998-06-30", baseline)


def _cohort(baseline: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = cohort.count_sides(_labelled(spark, sf_dir, baseline), "o_orderpriority")
        return c.withColumns({"active_share": F.round(stats.rate(F.col("active_n"), F.col("active_total")), 6), "reference_share": F.round(stats.rate(F.col("reference_n"), F.col("reference_total")), 6)})

    return run


def source_balanced_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"))
    return cohort.balanced_shares(o, "o_orderpriority", "year").select("year", F.round("share", 6).alias("share"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).where("day is not null").groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"))


def adaptive_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.adaptive_bins(_yearly(spark, sf_dir), "year", "n")


def rolling_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.rolling_bins(_yearly(spark, sf_dir), "year", 1, "n")


def burst_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.year("o_orderdate") * 12 + F.month("o_orderdate"))
    n = o.groupBy("month").agg(F.count("*").alias("n"))
    found = cohort.bursts(n, "month", "n", least=10, least_mean=5.0, ratio=1.02, sigmas=0.2)
    return found.select("month", "n", F.round("trailing_mean", 6).alias("trailing_mean"), F.round("deviation", 6).alias("deviation"))


def eligibility_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = {"dated": F.col("day").isNotNull(), "exact_day": F.col("date_precision") == "day", "mapped": F.col("lat").isNotNull(), "source_coordinates": F.col("coordinate_source") == "source_coordinates", "known_craft": F.col("craft").isNotNull()}
    return cohort.funnel(reports(spark, sf_dir), stages, ["source"])


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned items (active: flag R; reference: flag N) by line status within ship mode years; the key is the tax class."""
    li = table(spark, sf_dir, "lineitem").select(F.round(F.col("l_tax") * 100, 0).cast("int").cast("string").alias("key"), F.year("l_shipdate").alias("stratum"), (F.col("l_returnflag") == "R").alias("active"), (F.col("l_returnflag") != "R").alias("reference"), (F.col("l_quantity") > 25).alias("hit"))
    return li.groupBy("key", "stratum").agg(F.count_if(F.col("active") & F.col("hit")).alias("a"), F.count_if("active").alias("a_total"), F.count_if(F.col("reference") & F.col("hit")).alias("c"), F.count_if("reference").alias("c_total"))


_STRATA_SQL = """strata as (
  select cast(cast(round(l_tax * 100, 0) as int) as varchar) as key, year(l_shipdate) as stratum, count(*) filter (l_returnflag = 'R' and l_quantity > 25) as a, count(*) filter (l_returnflag = 'R') as a_total,
         count(*) filter (l_returnflag <> 'R' and l_quantity > 25) as c, count(*) filter (l_returnflag <> 'R') as c_total from lineitem group by 1, 2
)"""


def _rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def cmh_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.mantel_haenszel(_strata(spark, sf_dir), ["key"]))


def standardized_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.standardized_difference(_strata(spark, sf_dir), ["key"]))


def proportion_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _strata(spark, sf_dir).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("a", "a_total", "c", "c_total")])
    a, na, c, nc = (F.col(x) for x in ("a", "a_total", "c", "c_total"))
    (wl, wu), (nl, nu), (z, p) = stats.wilson(a, na), stats.newcombe(a, na, c, nc), stats.two_proportions(a, na, c, nc)
    return _rounded(s.select("key", wl.alias("wilson_lower"), wu.alias("wilson_upper"), nl.alias("newcombe_lower"), nu.alias("newcombe_upper"), z.alias("z"), p.alias("p")))


def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _strata(spark, sf_dir)
    p = s.select("key", "stratum", F.round(stats.two_proportions(F.col("a"), F.col("a_total"), F.col("c"), F.col("c_total"))[1], 6).alias("p"))
    return stats.benjamini_hochberg(p, "p", "key", ["stratum"]).select("key", "stratum", "p", F.round("q", 4).alias("q"))


def crosstab_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("craft is not null").groupBy("precision", "craft", "source").agg(F.count("*").alias("n"))
    return _rounded(stats.residuals(r, "source", "craft", "precision", "n"), 4)


def top_categories_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cohort.pool_rare(reports(spark, sf_dir), "country", 6)
    return r.groupBy("country").agg(F.count("*").alias("n"))


def cube_pairs_with_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).withColumn("decade", (F.floor(F.year("day") / 10) * 10).cast("string"))
    return cohort.cross_with_margins(r, "craft", "decade")


def cohort_ab_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return cohort.compare_groups(o.where("o_totalprice > 200000"), o.where("o_orderpriority = '1-URGENT'"), "o_custkey")


def cohort_ab_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir)
    return _rounded(cohort.compare_domain(r.where("source = 'skyledger'"), r.where("source = 'harbor_log'"), "craft"))


def freq_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return stats.frequency_quantile(t, "l_quantity", "n", 0.9)


def multilabel_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.mask_counts(table(spark, sf_dir, "part"), "p_size", ["b0", "b1", "b2", "b3", "b4", "b5"])


def loo_source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cohort.leave_one_out(reports(spark, sf_dir).where("craft is not null"), "source", (F.col("craft") == "disk").cast("int")))


def strata_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reports(spark, sf_dir).where("day is not null and craft is not null").withColumns({"coarse": F.col("source"), "fine": F.concat_ws("|", "source", F.year("day").cast("string"))})
    return cohort.supported_strata(r, "fine", "coarse").groupBy("stratum").agg(F.count("*").alias("n"))


def percentiles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_events(spark, sf_dir).groupBy("type").agg(F.round(F.percentile("value", F.lit(0.975)), 6).alias("p975"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.bootstrap_difference(_strata(spark, sf_dir), "key")


def mc_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.permutation_test(_strata(spark, sf_dir), "key")


QUERIES = {
    "cohort_previous_period": _cohort("previous_equal_duration"), "cohort_other_dates": _cohort("other_dates_balanced"), "cohort_full_overlap": _cohort("full_catalog"),
    "source_balanced_share": source_balanced_share, "adaptive_bins": adaptive_bins, "rolling_bins": rolling_bins, "burst_months": burst_months, "eligibility_funnel": eligibility_funnel,
    "cmh_or": cmh_or, "standardized_difference": standardized_difference, "proportion_intervals": proportion_intervals, "bh_qvalues": bh_qvalues, "crosstab_residuals": crosstab_residuals,
    "top_categories_pooled": top_categories_pooled, "cube_pairs_with_margins": cube_pairs_with_margins, "cohort_ab_overlap": cohort_ab_overlap, "cohort_ab_domain": cohort_ab_domain,
    "freq_quantile": freq_quantile, "multilabel_mask_counts": multilabel_mask_counts, "loo_source_range": loo_source_range, "strata_fallback": strata_fallback, "percentiles_by_type": percentiles_by_type,
    "bootstrap_ci": bootstrap_ci, "mc_permutation_p": mc_permutation_p,
}

_ACTIVE = "cast(o_orderdate as date) between date '1997-01-01' and date '1998-06-30'"


def _cohort_sql(reference: str) -> str:
    return f"""with n as (select o_orderpriority, count(*) filter ({_ACTIVE}) as active_n, count(*) filter ({reference}) as reference_n from orders group by 1)
        select *, round(case when active_total > 0 then active_n / active_total else 0 end, 6) as active_share, round(case when reference_total > 0 then reference_n / reference_total else 0 end, 6) as reference_share
        from (select *, sum(active_n) over () as active_total, sum(reference_n) over () as reference_total from n where active_n + reference_n > 0)"""


_T = "(1.0 / (1.0 + 0.3275911 * abs(z) / sqrt(2)))"
_P_SQL = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-z * z / 2))"
_Z2 = "3.8414588206941236"


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    p = f"({k} / {n})"
    centre, half = f"(({p} + {_Z2} / (2 * {n})) / (1 + {_Z2} / {n}))", f"(1.959963984540054 / (1 + {_Z2} / {n}) * sqrt({p} * (1 - {p}) / {n} + {_Z2} / (4.0 * {n} * {n})))"
    return f"greatest({centre} - {half}, 0)", f"least({centre} + {half}, 1)"


(_L1, _U1), (_L2, _U2) = _wilson_sql("a", "a_total"), _wilson_sql("c", "c_total")

SQL = {
    "cohort_previous_period": _cohort_sql("cast(o_orderdate as date) between date '1995-07-05' and date '1996-12-31'"),
    "cohort_other_dates": _cohort_sql(f"o_orderdate is not null and not ({_ACTIVE})"),
    "cohort_full_overlap": _cohort_sql("true"),
    "source_balanced_share": """with n as (select o_orderpriority as s, year(o_orderdate) as year, count(*) as n from orders group by 1, 2)
        select year, round(sum(n / total) / (select count(distinct s) from n), 6) as share from (select *, sum(n) over (partition by s) as total from n) group by 1""",
    "adaptive_bins": f"""with {REPORTS_SQL}, y as (select year(day) as year, count(*) as n from reports where day is not null group by 1), s as (select max(year) - min(year) + 1 as span, count(*) as years from y),
        w as (select case when span <= 40 or (span <= 80 and years / span >= 0.25) then 1 when span <= 300 and years / span >= 0.1 then 5 else 10 end as width from s)
        select cast(floor(year / width) * width as bigint) as bin_start, width, sum(n) as n from y, w group by 1, 2""",
    "rolling_bins": f"with {REPORTS_SQL}, y as (select year(day) as year, count(*) as n from reports where day is not null group by 1) select year, n, sum(n) over (order by year range between 4 preceding and current row) as rolling from y",
    "burst_months": """with m as (select year(o_orderdate) * 12 + month(o_orderdate) as month, count(*) as n from orders group by 1),
        t as (select *, coalesce(sum(n) over (order by month range between 5 preceding and 1 preceding), 0) / 5 as mean, sum(n) over () as total, min(month) over () as first from m)
        select month, n, round(mean, 6) as trailing_mean, round((n - mean) / sqrt(mean), 6) as deviation from t
        where total >= 200 and month >= first + 5 and n >= 10 and mean >= 5 and n / mean >= 1.02 and (n - mean) / sqrt(mean) >= 0.2""",
    "eligibility_funnel": f"""with {REPORTS_SQL}, f as (select source, day is not null as a, coalesce(date_precision = 'day', false) as b, lat is not null as c, coalesce(coordinate_source = 'source_coordinates', false) as d, craft is not null as e from reports)
        select source, count(*) as all_rows, count(*) filter (a) as dated, count(*) filter (a and b) as exact_day, count(*) filter (a and b and c) as mapped, count(*) filter (a and b and c and d) as source_coordinates, count(*) filter (a and b and c and d and e) as known_craft from f group by 1""",
    "cmh_or": f"""with {_STRATA_SQL}, s as (select key, a::double as x, (a_total - a)::double as b, c::double as c, (c_total - c)::double as d, a_total::double as n1, c_total::double as n0, (a + c)::double as m, (a_total + c_total)::double as n from strata where a_total > 0 and c_total > 0),
        g as (select key, count(*) as strata, sum(x) as o, sum(n1 * m / n) as e, sum(case when n > 1 then n1 * n0 * m * (n - m) / (n * n * (n - 1)) else 0 end) as v, sum(x * d / n) as r, sum(b * c / n) as s, sum((x + d) / n * x * d / n) as pr,
              sum((x + d) / n * b * c / n + (b + c) / n * x * d / n) as ps, sum((b + c) / n * b * c / n) as qs, sum(n) as total from s group by 1),
        z as (select *, case when v > 0 then (o - e) / sqrt(v) else 0 end as z, sqrt(pr / (2 * r * r) + ps / (2 * r * s) + qs / (2 * s * s)) as se from g)
        select key, strata, round(z, 5) as z, round({_P_SQL}, 5) as p, round(r / s, 5) as odds_ratio, round(exp(ln(r / s) - 1.959963984540054 * se), 5) as or_lower, round(exp(ln(r / s) + 1.959963984540054 * se), 5) as or_upper, round(sqrt(z * z / total), 5) as cramers_v from z""",
    "standardized_difference": f"""with {_STRATA_SQL}, s as (select *, sum(a_total) over (partition by key) as every from strata), k as (select *, sum(a_total) over (partition by key) as base from s where a_total > 0 and c_total > 0),
        g as (select key, sum(a_total / base * a / a_total) as aa, sum(a_total / base * c / c_total) as ar, max(base / every) as support, greatest(1.0, floor(1 / sum(a_total / base * a_total / base / c_total) + 0.5)) as eff from k group by 1)
        select key, round(aa, 5) as adjusted_active, round(ar, 5) as adjusted_reference, round(support, 5) as support, eff as effective_reference, round(aa - ar, 5) as effect, support >= 0.8 as eligible from g""",
    "proportion_intervals": f"""with {_STRATA_SQL}, s as (select key, sum(a)::double as a, sum(a_total)::double as a_total, sum(c)::double as c, sum(c_total)::double as c_total from strata group by 1),
        i as (select *, {_L1} as l1, {_U1} as u1, {_L2} as l2, {_U2} as u2, a / a_total as p1, c / c_total as p2, (a + c) / (a_total + c_total) as q from s), t as (select *, (p1 - p2) / sqrt(q * (1 - q) * (1 / a_total + 1 / c_total)) as z from i)
        select key, round(l1, 5) as wilson_lower, round(u1, 5) as wilson_upper, round(greatest(p1 - p2 - sqrt(pow(p1 - l1, 2) + pow(u2 - p2, 2)), -1), 5) as newcombe_lower, round(least(p1 - p2 + sqrt(pow(u1 - p1, 2) + pow(p2 - l2, 2)), 1), 5) as newcombe_upper,
        round(z, 5) as z, round({_P_SQL}, 5) as p from t""",
    "bh_qvalues": f"""with {_STRATA_SQL}, b as (select *, (a + c)::double / (a_total + c_total) as q0 from strata), t as (select key, stratum, coalesce((case when a_total > 0 then a / a_total else 0 end - case when c_total > 0 then c / c_total else 0 end) / nullif(sqrt(q0 * (1 - q0) * (1.0 / nullif(a_total, 0) + 1.0 / nullif(c_total, 0))), 0), 0) as z,
        nullif(sqrt(q0 * (1 - q0) * (1.0 / nullif(a_total, 0) + 1.0 / nullif(c_total, 0))), 0) as se from b), p as (select key, stratum, round(case when se is null then 1 else {_P_SQL} end, 6) as p from t), r as (select *, row_number() over (partition by stratum order by p, key) as k, count(*) over (partition by stratum) as m from p)
        select key, stratum, p, round(least(1.0, min(p * m / k) over (partition by stratum order by p, key rows between current row and unbounded following)), 4) as q from r""",
    "crosstab_residuals": f"""with {REPORTS_SQL}, n as (select precision, craft, source, count(*) as n from reports where craft is not null group by all), r as (select precision, source, sum(n) as r from n group by all), c as (select precision, craft, sum(n) as c from n group by all), t as (select precision, sum(n) as t from n group by all),
        e as (select source, craft, sum(r * c / t) as expected, sum(r * c / t * (1 - r / t) * (1 - c / t)) as variance from r join c on r.precision is not distinct from c.precision join t on r.precision is not distinct from t.precision where r.precision is not null group by all), o as (select source, craft, sum(n) as observed from n group by all)
        select source, craft, round(expected, 4) as expected, round(variance, 4) as variance, coalesce(observed, 0) as observed, round(case when variance > 0 then (coalesce(observed, 0) - expected) / sqrt(variance) end, 4) as residual, round(case when observed > 0 and expected > 0 then log2(observed / expected) end, 4) as log2_ratio from e left join o using (source, craft)""",
    "top_categories_pooled": f"""with {REPORTS_SQL}, t as (select country from (select country, count(*) as n from reports where country is not null group by 1) order by n desc, country limit 6)
        select case when country in (select country from t) then country when country is not null then 'Other' end as country, count(*) as n from reports group by 1""",
    "cube_pairs_with_margins": f"""with {REPORTS_SQL}, k as (select coalesce(craft, 'Unknown') as craft, coalesce(cast(cast(floor(year(day) / 10) * 10 as bigint) as varchar), 'Unknown') as decade from reports)
        select case grouping_id(craft, decade) when 0 then 'cell' when 1 then 'row' when 2 then 'column' else 'all' end as level, craft, decade, count(*) as n from k group by cube (craft, decade)""",
    "cohort_ab_overlap": """with l as (select distinct o_custkey as k, 1 as l from orders where o_totalprice > 200000), r as (select distinct o_custkey as k, 1 as r from orders where o_orderpriority = '1-URGENT')
        select count(*) filter (l = 1 and r = 1) as overlap, count(*) filter (l = 1 and r is null) as only_left, count(*) filter (l is null and r = 1) as only_right, count(*) as either from l full join r using (k)""",
    "cohort_ab_domain": f"""with {REPORTS_SQL}, l as (select craft, count(*) as n from reports where source = 'skyledger' and craft is not null group by 1), r as (select craft, count(*) as n from reports where source = 'harbor_log' and craft is not null group by 1),
        b as (select craft, coalesce(l.n, 0) as left_n, coalesce(r.n, 0) as right_n, coalesce(l.n / (select sum(n) from l), 0) as ls, coalesce(r.n / (select sum(n) from r), 0) as rs from l full join r using (craft))
        select craft, left_n, right_n, round(ls, 5) as left_share, round(rs, 5) as right_share, round(ls - rs, 5) as difference from b""",
    "freq_quantile": "select quantile_disc(l_quantity, 0.9) as quantile from lineitem",
    "multilabel_mask_counts": "select 'b' || b as label, count(*) as n, (select count(*) from part where (p_size & 63) <> 0) as reports from part, range(6) t(b) where (p_size >> b::int) & 1 = 1 group by 1",
    "loo_source_range": f"""with {REPORTS_SQL}, g as (select source, count(*) as n, sum((craft = 'disk')::int) as s from reports where craft is not null group by 1)
        select source as excluded, (select sum(n) from g) - n as n, round(((select sum(s) from g) - s) / ((select sum(n) from g) - n), 5) as mean from g""",
    "strata_fallback": f"""with {REPORTS_SQL}, r as (select source as coarse, source || '|' || year(day) as fine from reports where day is not null and craft is not null), c as (select *, count(*) over (partition by fine) as f, count(*) over (partition by coarse) as c from r)
        select case when f >= 20 then 'fine:' || fine when c >= 20 then 'coarse:' || coarse end as stratum, count(*) as n from c group by 1""",
    "percentiles_by_type": f"with {EVENTS_SQL} select type, round(quantile_cont(value, 0.975), 6) as p975, round(quantile_cont(value, 0.5), 6) as median from ev group by 1",
}
