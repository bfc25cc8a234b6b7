"""Sky positions, decisions, clipping and indexes."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.operators import calendar, review, sky


def unix(y, m, d):
    return np.array([(dt.date(y, m, d) - dt.date(1970, 1, 1)).days])


@pytest.mark.parametrize(
    ("day", "body", "expected", "within"),
    [
        # equinoxes and solstices
        ((2000, 3, 20), "sun", 0.0, 0.8), ((2010, 6, 21), "sun", 90.0, 0.8), ((2020, 12, 21), "sun", 270.0, 0.8),
        # the great conjunction of 2020-12-21 near 300.5 degrees
        ((2020, 12, 21), "jupiter", 300.5, 0.8), ((2020, 12, 21), "saturn", 300.5, 0.8),
        # the opposition of Mars on 2003-08-28
        ((2003, 8, 28), "mars", 335.0, 1.5),
    ],
)
def test_longitudes(day, body, expected, within):
    got = sky.longitudes(unix(*day))[body][0]
    assert abs((got - expected + 180) % 360 - 180) < within


def test_day_table_and_motion(spark):
    t = sky.day_table(spark, dt.date(2003, 7, 1), dt.date(2003, 10, 31))
    assert t.groupBy("body").count().agg(F.min("count"), F.max("count")).first()[:] == (123, 123)
    assert t.where("body = 'mars' and day = '2003-08-28'").first()["motion"] == "retrograde"
    assert t.where("body = 'sun' and motion <> 'direct'").count() == 0


def test_full_and_new_moon(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 6),), (dt.date(2018, 1, 31),), (dt.date(2017, 8, 21),)], "d date")
    assert [r[0] for r in df.select(calendar.moon_phase(F.col("d"))).collect()] == [0, 4, 0]


def test_exposure_sums_to_the_events(spark):
    t = sky.day_table(spark, dt.date(2000, 1, 1), dt.date(2000, 12, 31))
    folded = spark.createDataFrame([(dt.date(2000, 1 + i % 12, 1 + i % 28), i + 1) for i in range(40)], "day date, n int")
    got = sky.sky_exposure(folded, t, F.col("motion")).groupBy("body").agg(F.sum("observed").alias("o"), F.sum("expected").alias("e")).collect()
    assert {(r["o"], round(r["e"], 6)) for r in got} == {(820, 820.0)}


def test_decisions(spark):
    queue = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    said = spark.createDataFrame([("a", " Yes"), ("a", "yes"), ("b", "yes"), ("b", "no"), ("c", "perhaps"), ("x", "no"), ("d", None)], "id string, decision string")
    done, problems = review.apply_decisions(queue, said, "id", ["yes", "no"])
    assert dict(done.collect()) == {"a": "yes", "b": "pending", "c": "pending", "d": "pending"}
    assert dict(problems.collect()) == {"b": "contradiction", "c": "invalid_decision", "d": "invalid_decision", "x": "unknown_key"}


def test_clip(spark):
    df = spark.createDataFrame([("through", 0.0, -10.0, 0.0, 10.0), ("away", 60.0, 0.0, 70.0, 10.0), ("point", 0.0, 0.0, 0.0, 0.0), ("inside", 0.0, -1.0, 0.0, 1.0)], "trace_id string, from_lat double, from_lon double, to_lat double, to_lon double")
    got = {r["trace_id"]: (r["enter"], r["leave"]) for r in review.clip_segments(df, 0.0, 0.0, 111.19508 * 5).collect()}
    assert set(got) == {"through", "inside"} and got["inside"] == (0.0, 1.0) and got["through"] == pytest.approx((0.25, 0.75), abs=1e-4)


def test_grams_are_a_superset(spark):
    df = spark.createDataFrame([(1, "Grass lay flat"), (2, "lay the grass"), (3, "gr"), (4, None), (5, "")], "id int, t string")
    assert [r[0] for r in review.gram_candidates(review.build_grams(df, "id", "t"), "grass lay").collect()] == [1]


def test_stability(spark):
    rows = [("k", s, y, 40, 100, 20, 100) for s in "abc" for y in (1, 2)] + [("one", "a", 1, 40, 100, 20, 100)]
    df = spark.createDataFrame(rows, "key string, source string, stratum int, a long, a_total long, c long, c_total long")
    from nightloom.functions.stats import mantel_haenszel

    whole = mantel_haenszel(df.groupBy("key", "stratum").agg(*[F.sum(c).alias(c) for c in ("a", "a_total", "c", "c_total")]), ["key"])
    assert dict(review.stability(whole, review.source_exclusions(df, "key", "source"), "key").collect())["k"] == "stable"
