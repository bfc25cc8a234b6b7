"""Merge strategies, similarity, location candidates and dumps."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightloom.operators import merge_rules

COLS = "id string, source string, native_id string, day date, date_precision string, time_raw string, location string, lat double, lon double, coordinate_source string, type string, city string, state string, country string, description string"
D = dt.date(2001, 2, 3)


def row(i, **k):
    base = {"source": f"s{i}", "native_id": None, "day": D, "date_precision": "day", "time_raw": None, "location": None, "lat": None, "lon": None, "coordinate_source": None, "type": None, "city": None, "state": None, "country": None, "description": None}
    return (i, *(base | k).values())


@pytest.mark.parametrize(
    ("strategy", "left", "right", "merged"),
    [
        ("aggressive_v1", {"location": "Phoenix, AZ", "time_raw": "21:30"}, {"location": "phoenix az", "time_raw": "21:30"}, "medium"),
        ("aggressive_v1", {"location": "Phoenix, AZ"}, {"location": "phoenix az"}, None), ("maximal_v1", {"location": "Phoenix, AZ"}, {"location": "phoenix az"}, "low"),
        ("aggressive_v1", {"source": "x", "location": "Phoenix, AZ"}, {"source": "x", "location": "phoenix az"}, "high"),
        ("aggressive_v1", {"source": "x", "native_id": "A-17"}, {"source": "x", "native_id": "a-17", "day": None}, "high"), ("aggressive_v1", {"source": "x", "native_id": "none"}, {"source": "x", "native_id": "none"}, None),
        ("maximal_v1", {"lat": 10.01, "lon": -0.01, "coordinate_source": "source_coordinates"}, {"lat": 10.02, "lon": 0.01, "coordinate_source": "source_coordinates"}, "low"),
        ("maximal_v1", {"lat": 10.01, "lon": 0.01, "coordinate_source": "country_centroid"}, {"lat": 10.02, "lon": 0.02, "coordinate_source": "country_centroid"}, None),
        ("maximal_v1", {"coordinate_source": "source_coordinates"}, {"coordinate_source": "source_coordinates"}, None),
        ("maximal_v1", {"location": "Phoenix", "date_precision": "month"}, {"location": "phoenix", "date_precision": "month"}, None),
        ("maximal_v2", {"city": "Phoenix", "state": "AZ"}, {"city": "phoenix", "state": "az"}, "medium"), ("maximal_v2", {"city": "Phoenix", "country": "USA", "location": "by the river"}, {"city": "phoenix", "country": "usa", "location": "at the mill"}, None),
        ("maximal_v2", {"city": "Phoenix", "country": "USA"}, {"location": "Phoenix, United States of America"}, "low"), ("maximal_v2", {"city": "Phoenix", "country": "USA", "location": "a b", "type": "Light"}, {"city": "phoenix", "country": "us", "location": "c d", "type": "light"}, "medium"),
        ("maximal_v2", {"city": "Phoenix", "country": "USA", "location": "a b", "type": "Other"}, {"city": "phoenix", "country": "us", "location": "c d", "type": "other"}, None), ("maximal_v3", {"city": "Unknown", "country": "USA", "location": "a b"}, {"city": "unknown", "country": "usa", "location": "c d"}, None),
        ("maximal_v3", {"city": "Phoenix", "country": "USA"}, {"city": "phoenix", "country": "usa", "state": "AZ"}, "low"), ("maximal_v3", {"city": "Phoenix", "country": "USA", "state": "OR"}, {"city": "phoenix", "country": "usa", "state": "AZ"}, None),
    ],
)
def test_strategies(spark, strategy, left, right, merged):
    df = spark.createDataFrame([row("a", **left), row("b", **right), row("z", day=dt.date(1990, 1, 1))], COLS)
    got = {r["id"]: (r["root"], r["confidence"]) for r in merge_rules.merge_records(df, strategy).collect()}
    assert got == ({"a": ("a", merged), "b": ("a", merged)} if merged else {})


def test_chain_takes_the_best_confidence(spark):
    df = spark.createDataFrame([row("a", location="x y", time_raw="21:30"), row("b", source="q", location="x y", time_raw="21:30", native_id="n-1"), row("c", source="q", native_id="n-1", day=None)], COLS)
    assert {(r["id"], r["root"], r["confidence"]) for r in merge_rules.merge_records(df, "aggressive_v1").collect()} == {("a", "a", "high"), ("b", "a", "high"), ("c", "a", "high")}


def test_keys_of_times_and_report_words(spark):
    t = spark.createDataFrame([("about 21:30 pm or so",), ("0915 hrs",), ("8 p.m.",), ("shortly before noon",), ("evening",), (None,)], "t string")
    assert [r[0] for r in t.select(merge_rules.time_key(F.col("t"))).collect()] == ["21 30 pm", "0915", "8 p m", "noon", None, None]
    w = spark.createDataFrame([("Three lights hovering silently; the Triangular craft moved, A report of beams", None), (None, None)], "a string, b string")
    assert [r[0] for r in w.select(merge_rules.report_tokens(F.col("a"), F.col("b"))).collect()] == [["three", "light", "hover", "silent", "triangle", "craft", "mov", "beam"], []]


def test_similarity_and_score(spark):
    df = spark.createDataFrame([("red light seen", "red light seen"), ("red light", "blue moon"), ("", "x"), (None, "x"), ("a b c d", "a b c e")], "a string, b string")
    s = [round(r[0], 4) for r in df.select(merge_rules.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert s[0] == 1.0 and s[1] < 0.62 and s[2] == s[3] == 0.0 and s[4] >= 0.75
    k = spark.createDataFrame([(0.7, False), (0.3, False), (0.3, True), (0.62, False)], "s double, i boolean").select(merge_rules.near_duplicate_score(F.col("s"), F.col("i")))
    assert [r[0] for r in k.collect()] == [0.916, None, 0.922, 0.894]


def test_locations_and_times(spark):
    df = spark.createDataFrame([("near Phoenix (downtown), AZ, USA",)], "t string")
    assert df.select(merge_rules.location_candidates(F.col("t"))).first()[0] == ["near Phoenix (downtown), AZ, USA", "near Phoenix , AZ, USA", "Phoenix , AZ, USA", "Phoenix", "AZ, USA"]
    t = spark.createDataFrame([("18:15",), ("about 6 pm",), ("7",), ("8 p.m.",), ("dusk",), ("-",), ("0600 hrs",)], "t string")
    assert [r[0] for r in t.select(merge_rules.time_token_class(F.col("t"))).collect()] == ["exact", "fuzzy", "ambiguous", "exact", "fuzzy", "none", "exact"]


def test_dump(spark):
    lines = spark.createDataFrame([("INSERT INTO `location` VALUES (1,'O''Hare, IL',41.9,NULL),(2,'a (b)',NULL,'x\\'y');",), ("INSERT INTO `other` VALUES (9,'z');",), (None,)], "value string")
    assert [tuple(r) for r in merge_rules.read_dump(lines, "location", ["id", "name", "lat", "note", "more"]).collect()] == [("1", "O'Hare, IL", "41.9", None, None), ("2", "a (b)", None, "x'y", None)]
