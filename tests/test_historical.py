"""Dates of old chronicles."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nightloom.functions.historical import historical_date, read, resolve


@pytest.mark.parametrize(
    ("text", "heading", "file", "first", "last", "precision"),
    [
        ("7/8/1947", "", "", "1947-07-08", "1947-07-08", "exact_day"), ("7/1947", "", "", "1947-07-01", "1947-07-31", "month"), ("1947", "", "", "1947-01-01", "1947-12-31", "year"), ("1980's?", "", "", "1980-01-01", "1989-12-31", "approximate"),
        ("Summer 1947", "", "", "1947-06-01", "1947-08-31", "approximate"), ("winter 1999", "", "", "1999-12-01", "2000-02-29", "approximate"), ("Fall", "1947", "", "1947-09-01", "1947-11-30", "approximate"), ("late autumn 1947", "", "", "1947-11-01", "1947-11-30", "approximate"),
        ("Early 5/1947", "", "", "1947-05-01", "1947-05-10", "approximate"), ("mid 5/1947", "", "", "1947-05-11", "1947-05-20", "approximate"), ("late 1947", "", "", "1947-09-02", "1947-12-31", "approximate"), ("early 7/8/1947", "", "", "1947-07-08", "1947-07-08", "approximate"),
        ("circa 1910", "", "", "1910-01-01", "1910-12-31", "approximate"), ("1/7/50", "1950", "", "1950-01-07", "1950-01-07", "exact_day"), ("1/7/50", "", "list_1950_1959.txt", "1950-01-07", "1950-01-07", "exact_day"), ("1/7/85", "", "1980 present.txt", "1985-01-07", "1985-01-07", "exact_day"),
        ("1/7/05", "", "1980_present.txt", "2005-01-07", "2005-01-07", "exact_day"), ("1/7/50", "", "", "0050-01-07", "0050-01-07", "exact_day"), ("0's", "0", "", "0000-01-01", "0009-12-31", "decade"), ("1/7/0", "0", "", "0000-01-07", "0000-01-07", "exact_day"), ("80s", "", "1980_present", "1980-01-01", "1989-12-31", "decade"),
        ("2/30/1947", "", "", "1947-02-28", "1947-02-28", "exact_day"), ("1/2/1947 - 1/5/1947", "", "", "1947-01-02", "1947-01-05", "range"), ("1/1947 to 3/1947", "", "", "1947-01-01", "1947-03-31", "range"), ("July 8, 1947", "", "", "1947-07-08", "1947-07-08", "exact_day"),
        ("Jul 1947~", "", "", "1947-07-01", "1947-07-31", "approximate"), ("mid", "1947", "", "1947-05-02", "1947-08-30", "approximate"),
    ],
)
def test_spans(text, heading, file, first, last, precision):
    got = resolve(text, None, None, heading, file)
    assert (got[0], got[1] or got[0], got[3]) == (first, last, precision)


@pytest.mark.parametrize("text", [None, "", " ", "13/1/1947", "1/0/1947", "soon", "spring", "mid", "Smarch 1947", "x" * 5000])
def test_no_span(text):
    assert read(text) is None


def test_alternate_and_end():
    assert resolve("Early 5/1947", "5/12/1947", None, None, None) == ("1947-05-01", "1947-05-12", "1947-05-06", "range")
    assert resolve("soon", None, "7/1947", None, None) == ("1947-07-01", "1947-07-31", "1947-07-16", "month")
    assert resolve(None, "7/8/1947", None, None, None) == ("1947-07-08", None, "1947-07-08", "range") and resolve("soon", "later", "never", None, None) is None


@given(st.text(max_size=30), st.text(max_size=6))
def test_never_raises(text, heading):
    read(text, heading)


def test_column(spark):
    df = spark.createDataFrame([("1/7/50", None, None, "1950", None), (None,) * 5, ("soon", None, None, None, None)], "a string, b string, c string, d string, e string")
    got = [r[0] for r in df.select(historical_date(*[F.col(c) for c in "abcde"])).collect()]
    assert tuple(got[0]) == ("1950-01-07", None, "1950-01-07", "exact_day") and got[1] is None and got[2] is None
