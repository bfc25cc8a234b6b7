"""Rules that pair compact records of different catalogues."""

from __future__ import annotations

import pytest

from nightloom.llm.linkage import PRIOR_WEIGHT, RULES, features, link

COLS = ("input_id", "source_name", "date_iso", "date_precision", "time_key", "location_text", "location_country_key", "location_region_key", "text_normalized", "summary", "shape_key", "side", "place", "rule")
TYPES = ", ".join(f"{c} string" for c in COLS)
PLACES = [(1, "Quoldden", "AZ", "Arizona", "USA", []), (2, "Seaviwick", "CA", "California", "USA", [])]
REF = "place_id int, city string, state_code string, state_province string, country string, alt_names array<string>"
PAIR = "left_input_id string, right_input_id string, verdict string"


def row(i, date="2001-05-06", time="2130", place="Otter Creek, Quoldden, AZ", text="red disk seen by five people for 12 minutes", shape="disk", precision="day"):
    return (i, "s", date, precision, time, place, None, None, text, None, shape, "x", "x", "x")


RECORDS = [row("r1"), row("r2", date="2001-05-08", time="0400", place="Seaviwick", text=None, shape=None), row("r3", date="2003-01-02", text=None, place="Harrow Hill, Seaviwick, Calif."), row("r4", date="2003-08-21", text="blue oval seen by two people for 7 minutes", shape="oval")]


@pytest.mark.parametrize(
    ("partner", "expected", "rule"),
    [
        (row("p", text="Lasted 12 minutes; red in colour; witnesses: five.", time=None, shape="plate"), "r1", "date place facts"),
        (row("p", text=None, place="Oter Crk / quolden", shape=""), "r1", "date place time street"),
        (row("p", text=None, time="2145"), "r1", "date place near-time street"),
        (row("p", date="2001-05-07", time=None), "r1", "near-date place facts"),
        (row("p", date="2001-06-05"), "r1", "near-date place facts"),
        (row("p", date="2003-08-01", precision="month", text="two persons watched a blue egg for 7 minutes", shape="egg"), "r4", "month place facts"),
        (row("p", date=None), "r1", "place facts time"),
        (row("p", text=None, place="Harrow Hill, Quoldden, AZ"), None, None),
        (row("p", text="red disk seen by five people for 13 minutes", time="0300"), None, None),
        (row("p", date=None, time=None, place=None, text=None, shape=None, precision=None), None, None),
        (row("p", shape="cigar"), None, None),
    ],
)
def test_rules(spark, partner, expected, rule):
    labels = spark.createDataFrame([("r1", "r2", "same")], PAIR)
    got = link(spark.createDataFrame(RECORDS, TYPES), spark.createDataFrame([partner], TYPES), spark.createDataFrame(PLACES, REF), labels).collect()
    assert [(r["record_id"], r["partner_id"], r["rule"]) for r in got] == ([(expected, "p", rule)] if expected else [])


def test_confidence_from_labels(spark):
    records = [row("r1"), row("r2"), row("r3"), row("r4", date="1990-01-01")]
    labels = spark.createDataFrame([("R1 ", "r2", "same"), ("r2", "r1", "same"), ("r1", "r3", "different"), ("r2", "r3", "same"), ("r2", "r3", "different"), ("r1", "r4", "different"), (None, "r1", "same")], PAIR)
    got = link(spark.createDataFrame(records, TYPES), spark.createDataFrame([row("p"), row("p")], TYPES), spark.createDataFrame(PLACES, REF), labels).collect()
    assert {r["record_id"] for r in got} == {"r1", "r2", "r3"}
    assert [r["confidence"] for r in got] == [pytest.approx((1 + RULES[0].prior * PRIOR_WEIGHT) / (2 + PRIOR_WEIGHT))] * 3


def test_empty_and_texts(spark):
    one, none = spark.createDataFrame([row("r1")], TYPES), spark.createDataFrame([], TYPES)
    ref, labels = spark.createDataFrame(PLACES, REF), spark.createDataFrame([], PAIR)
    assert link(one, none, ref, labels).count() == 0 and link(none, one, ref, labels).count() == 0
    texts = [row("a", text="amber " * 50000), row("b", text="witnesses: three, lasted 45 minutes, pearl in colour"), (None, *row("c")[1:])]
    got = {r["input_id"]: r["facts"] for r in features(spark.createDataFrame(texts, TYPES), ref).collect()}
    assert got == {"a": None, "b": "45|3|pearl"}
