"""The analysis document against estimates from the rows themselves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nightloom.functions.stats import mantel_haenszel
from nightloom.operators.document import analysis_document, comparison_cells, without_each_source


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    out = []
    for i in range(4000):
        active, source, stratum = rng.random() < 0.4, f"s{rng.randrange(4)}", rng.choice(["n", "e", None])
        kind = "often" if rng.random() < (0.5 if active else 0.2) else rng.choice(["a", "b", None])
        lone = "lone" if source == "s1" and active and rng.random() < 0.5 else "other"
        out.append((i, active, not active, source if source != "s3" else None, stratum, kind, lone))
    return spark.createDataFrame(out, "id int, active boolean, reference boolean, source string, stratum string, kind string, lone string").cache()


def cells(rows):
    return comparison_cells(rows, {"kind": F.col("kind"), "lone": F.col("lone")}, F.col("stratum"), F.col("source"))


def estimate(rows, key):
    """The stratified estimate of a kind, from rows."""
    r = rows.withColumn("stratum", F.coalesce("stratum", F.lit("unknown")))
    s = r.groupBy("stratum").agg(F.count_if(F.col("active") & (F.col("kind") == key)).alias("a"), F.count_if("active").alias("a_total"), F.count_if(F.col("reference") & (F.col("kind") == key)).alias("c"), F.count_if("reference").alias("c_total"))
    return mantel_haenszel(s.withColumn("k", F.lit(1)), ["k"]).first()


def test_cells_hold_every_row_once(rows):
    c = cells(rows)
    n = c.groupBy("family").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).collect()
    assert {r["family"] for r in n} == {"kind", "lone"} and all(r["a"] + r["c"] == 4000 for r in n)
    assert c.count() == (4 + 2) * 3 * 4 and c.select("source").distinct().count() == 4


def test_leaving_a_source_out_is_filtering_it(rows):
    got = {(r["key"], r["source"]): r for r in without_each_source(cells(rows)).where("family = 'kind'").collect()}
    for source in ("s0", "unknown"):
        want = estimate(rows.where(F.coalesce("source", F.lit("unknown")) != source), "often")
        r = got["often", source]
        assert (r["odds_ratio"], r["or_lower"], r["z"]) == pytest.approx((want["odds_ratio"], want["or_lower"], want["z"]))


def test_document(rows):
    got = {(r["family"], r["key"]): r for r in analysis_document(cells(rows)).collect()}
    assert set(got) == {("kind", k) for k in ("often", "a", "b", "unknown")} | {("lone", "lone"), ("lone", "other")}
    often, lone = got["kind", "often"], got["lone", "lone"]
    want = estimate(rows, "often")
    assert (often["odds_ratio"], often["p"]) == pytest.approx((want["odds_ratio"], want["p"])) and often["q"] >= often["p"]
    assert often["status"] == "stable" and often["finding"] and often["difference"] == pytest.approx(0.3, abs=0.06) and often["support"] == 1.0
    assert often["lower"] < often["active_share"] - often["reference_share"] < often["upper"]
    assert lone["status"] == "single_source_only" and not lone["finding"]


def test_empty(rows):
    assert analysis_document(cells(rows.limit(0))).count() == 0
