"""Typed places against a small reference list."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from nightloom.llm.places import deletions, edits, fold, map_places

PLACES = [
    (1, "Saint Duomere", "GA", "Georgia", "USA", []), (2, "Quoldden", "AZ", "Arizona", "USA", ["Kesterly"]), (3, "Quoldden", "QLD", "Queensland", "Australia", None), (4, "Quazushtoñ", "AN", "Andalucía", "Spain", []),
    (5, "North Godolmestead", "ENG", "England", "United Kingdom", []), (6, "Haxuford", "CA", "California", "USA", []), (7, "Haxuford", "ON", "Ontario", "Canada", []), (8, None, None, None, None, None),
]
REF = "place_id int, city string, state_code string, state_province string, country string, alt_names array<string>"
REC = "canonical_input_id string, location_raw string, state_province string, country string, text string, tokens string, word string"


@pytest.mark.parametrize(
    ("raw", "state", "country", "expected"),
    [
        ("St. Duomere, Ga.", None, None, "1"), ("snt duomeer georgia", None, None, "1"), ("SAINT DUOMERE (USA)", "", None, "1"), ("Saint-Duomere & vicinity", None, None, "1"), ("U.S.A.: GA / Saint Duomere", None, None, "1"),
        ("quoldden, Ariz.", None, None, "2"), ("12 mi NE of QUOLDEN", "Queensland", None, "3"), ("Quoldden", None, "Austrailia", "3"), ("Kesterly", "N/A", "us", "2"), ("Quoldden", None, None, "none"),
        ("QuazushtoÃ±", None, "España", "4"), ("Quazushto&#241;, And.", None, None, "4"), ("No. Godolmestead", None, "G.B.", "5"), ("Haxuford, ca", "CA", None, "6"), ("Haxuford", "Ont.", "CA.", "7"),
        ("USA", None, None, "none"), ("Georgia", "GA", "USA", "none"), ("Unheardof, Ga.", None, None, "none"), ("51.4N 1.1W", None, None, "none"), ("x" * 20000, None, None, "none"), ("Goldolden", "AZ", None, "none"), ("…", None, None, "none"),
    ],
)
def test_texts(places_found, raw, state, country, expected):
    assert places_found[(raw, state, country)] == expected


@pytest.fixture(scope="module")
def places_found(spark):
    cases = [m.args for m in test_texts.pytestmark if m.name == "parametrize"][0][1]
    rows = [(str(i), c[0], c[1], c[2], "clash", "clash", "clash") for i, c in enumerate(cases)]
    got = dict(map_places(spark.createDataFrame(rows, REC), spark.createDataFrame(PLACES, REF)).collect())
    return {(c[0], c[1], c[2]): got[str(i)] for i, c in enumerate(cases)}


def test_rows(spark):
    ref = spark.createDataFrame(PLACES, REF)
    rows = [("a", "Saint Duomere", None, None), ("a", "Saint Duomere", None, None), ("b", None, None, None), ("c", " unknown ", None, None), (None, "Saint Duomere", None, None)]
    df = spark.createDataFrame([(*r, "", "", "") for r in rows], REC)
    assert [tuple(r) for r in map_places(df, ref).collect()] == [("a", "1")]
    assert [tuple(r) for r in map_places(df, ref.limit(0)).collect()] == [("a", "none")]
    assert map_places(df.limit(0), ref).count() == 0


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
def test_deletion_neighbourhoods_meet(a, b):
    if edits(a, b, 2) <= 2:
        assert deletions(a, 2) & deletions(b, 2)


def test_edits():
    assert edits("abcd", "abdc", 2) == 1 and edits("abc", "abc", 2) == 0 and edits("abc", "xyzw", 2) == 3 and fold("Réndacourt") == "rendacourt"
