"""Clock texts as evidence, and the order of playback."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from nightloom.functions import chronology

CASES = {
    "18:15": ("exact", "high", None, 1095, 1095, 1095, None), "6:15 pm": ("exact", "high", None, 1095, 1095, 1095, None), "1815 hours": ("exact", "high", None, 1095, 1095, 1095, None), "915 hours": ("exact", "high", None, 555, 555, 555, None),
    "12 am": ("exact", "high", None, 0, 0, 0, None), "12 noon": ("bucketed", "low", "noon", 720, 705, 735, None), "1O15 hours EST": ("exact", "high", None, 615, 615, 615, -300), "18.30 utc": ("exact", "high", None, 1110, 1110, 1110, 0),
    "about 9 pm": ("approximate", "medium", None, 1260, 1230, 1290, None), "~ 0:10": ("approximate", "medium", None, 10, 0, 40, None), "23:50?": ("approximate", "medium", None, 1430, 1400, 1439, None),
    "between 8 and 9 pm": ("approximate", "medium", None, 1230, 1200, 1260, None), "from 11 pm to 1 am": ("approximate", "medium", None, 0, 1380, 60, None), "between 8 and later": ("unknown", "none", None, None, None, None, None),
    "early morning": ("bucketed", "low", "early_morning", 420, 360, 480, None), "shortly after sunset": ("bucketed", "low", "dusk", 1140, 1080, 1200, None), "around midnight": ("approximate", "medium", "midnight", 0, 1425, 15, None), "Night, CET": ("bucketed", "low", "night", 1350, 1260, 1439, 60),
    "25:00": ("unknown", "none", None, None, None, None, None), "13 pm": ("unknown", "none", None, None, None, None, None), "no idea": ("unknown", "none", None, None, None, None, None), "": ("unknown", "none", None, None, None, None, None), None: ("unknown", "none", None, None, None, None, None), "x" * 5000: ("unknown", "none", None, None, None, None, None),
}


def test_clock_texts(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string").select("t", chronology.clock_evidence(F.col("t")).alias("e"))
    assert {r["t"]: tuple(r["e"]) for r in df.collect()} == CASES


@pytest.fixture(scope="module")
def played(spark):
    d, n = dt.date(2001, 7, 4), dt.date(2001, 10, 28)
    rows = [
        ("7", d, True, "12:00 EST", None, "none"), ("8", d, True, "12:00", "America/New_York", "high"), ("9", d, True, "about 12:00", "America/New_York", "low"), ("10", d, True, "12:00", "America/New_York", "low"),
        ("x", d, False, "12:00 UTC", None, "none"), ("11", d, True, "from 11 pm to 1 am", "Europe/Paris", "medium"), ("12", n, True, "1:30 am", "America/New_York", "high"), ("13", None, True, "12:00 UTC", None, "none"), ("14", d, True, None, "Europe/Paris", "high"),
    ]
    df = spark.createDataFrame(rows, "id string, day date, exact boolean, t string, zone string, sure string")
    key = chronology.playback(F.col("day"), F.col("exact"), chronology.clock_evidence(F.col("t")), F.col("zone"), F.col("sure"), F.col("id"))
    return {r["id"]: r["k"] for r in df.select("id", key.alias("k")).collect()}


def test_playback_fields(played):
    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    assert tuple(played["7"])[:4] == (1, ms(2001, 7, 4, 17), 0, 0) and played["7"]["reason"] == "exact_time_with_explicit_timezone"
    assert tuple(played["8"])[:4] == (1, ms(2001, 7, 4, 16), 0, 0) and played["8"]["reason"] == "exact_time_with_inferred_timezone"
    assert tuple(played["9"])[:4] == (2, 720, 60, 1) and tuple(played["10"])[:4] == (2, 720, 0, 0) and played["10"]["reason"] == "local_time_only"
    assert tuple(played["11"])[:4] == (1, ms(2001, 7, 4, 22), 7_200_000, 1)
    # a local time that occurs twice fixes no instant
    assert tuple(played["12"])[:4] == (2, 90, 0, 0)
    for i in ("x", "13", "14"):
        assert (played[i]["group"], played[i]["value"], played[i]["rank"], played[i]["reason"]) == (3, None, 3, "stable_fallback")
    assert played["x"]["id_kind"] == 1 and played["7"]["id_kind"] == 0
