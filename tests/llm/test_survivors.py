"""Surviving values by weighted token consensus."""

from __future__ import annotations

import datetime as dt

from nightloom.llm import survivors as module
from nightloom.llm.survivors import BATCH, apart, consensus_survivors, elected, merged, profile, survivors

LINK = "event_id string, canonical_input_id string, trust int, late long"
REC = "canonical_input_id string, source_name string, ingested_at timestamp, time_raw string, shape string, value string, rank int"
SRC = "source_name string, time_trust int, shape_trust int, id string"
FIELDS = {"time_raw": "time_trust", "shape": "shape_trust"}
T = dt.datetime(2024, 1, 1)


def run(spark, links, records, sources=(("good", 1, 2, ""), ("bad", 5, 1, ""))):
    return {
        (r[0], r[1]): r[2]
        for r in survivors(spark.createDataFrame([(*x, 0, 0) for x in links], LINK), spark.createDataFrame([(*x, "", 0) for x in records], REC), spark.createDataFrame(list(sources), SRC), FIELDS).collect()
    }


def vote(values, weights):
    return elected(profile(values, weights), sum(weights))


def test_columns_are_voted_on():
    assert vote(["8 45 pm", "8 45 pm approx", "8 46 pm"], [1, 1, 1]) == ["8", "45", "pm"]
    assert vote(["a b c", "x b c", "a y c", "a b z"], [1, 1, 1, 1]) == ["a", "b", "c"]  # said by one only, whatever the others do
    assert vote(["a x c", "a b d", "e b c"], [1, 1, 1]) == ["a", "b", "c"]  # said by none
    assert vote(["top", "other", "other x"], [4, 2, 1]) == ["top"] and vote(["top", "other", "other x"], [2, 2, 1]) == ["other"]
    assert vote(["", "a"], [2, 1]) == [] and vote([], []) == []
    assert apart(["a", "b", "c"], ["a", "c", "d"]) == 2 and apart([], ["a"]) == 1


def test_profiles_of_parts_keep_all_votes():
    values, weights = ["red disk over hill", "red disk near hill", "green disk over hill", "red disk over the hill", "red cone over hill"], [3, 1, 2, 1, 1]
    parts = merged(profile(values[:2], weights[:2]), profile(values[2:], weights[2:]))
    assert elected(parts, 8) == vote(values, weights) == ["red", "disk", "over", "hill"]
    assert sum(w for c in parts for w in c.values()) == sum(w for c in profile(values, weights) for w in c.values())


def agreed(spark, links, records, **options):
    frames = (spark.createDataFrame([(*x, 0, 0) for x in links], LINK), spark.createDataFrame([(*x, "", 0) for x in records], REC), spark.createDataFrame([("good", 1, 2, ""), ("bad", 2, 1, "")], SRC))
    return {(r["event_id"], r["field_name"]): r for r in consensus_survivors(*frames, FIELDS, **options).collect()}


def test_the_group_overrules_its_best_rank(spark):
    links = [("e", x) for x in "abcd"] + [("one", "a"), (None, "a")]
    records = [("a", "good", T, "9:15 pm", "UNK"), ("b", "bad", T, "8:45 pm", "disk"), ("c", "bad", T, "8:45 pm approx", "disk"), ("d", "bad", T, "8:45 am", None), ("d", "bad", T, "8:45 am", None)]
    assert run(spark, links, records) == {("e", "time_raw"): "a", ("e", "shape"): "b"}
    got = agreed(spark, links, records)
    assert (got["e", "time_raw"]["canonical_input_id"], got["e", "time_raw"]["value"], got["e", "time_raw"]["built"], got["e", "time_raw"]["distance"]) == ("b", "8:45 pm", "8 : 45 pm", 0)
    assert set(got) == {("e", "time_raw"), ("e", "shape")}
    # with steep weights it is the rank again
    assert agreed(spark, links, records, trust_ratio=100.0)["e", "time_raw"]["canonical_input_id"] == "a"
    # old records weigh less
    old = [("a", "good", T, "9:15 pm", None), *[(i, "good", T - dt.timedelta(4000), "8:45 pm", None) for i in "bcd"]]
    assert agreed(spark, links, old)["e", "time_raw"]["canonical_input_id"] == "a" and agreed(spark, links, old, half_life_days=1e6)["e", "time_raw"]["canonical_input_id"] == "b"


def test_a_built_value_that_none_has(spark):
    links = [("e", x) for x in "abc"]
    got = agreed(spark, links, [("a", "good", T, "8 46 pm", None), ("b", "good", T, "8 45 am", None), ("c", "good", T, "9 45 pm", None)])["e", "time_raw"]
    assert got["built"] == "8 45 pm" and got["distance"] == 1 and got["canonical_input_id"] == "a"


def test_large_group_by_profiles(spark, monkeypatch):
    monkeypatch.setattr(module, "BATCH", 4)
    n = 90
    links = [("hot", f"r{i:03}") for i in range(n)]
    records = [(f"r{i:03}", "good", T, f"about {i} past nine pm" if i % 3 else f"about {i % 9} to nine am", "x" * 3000 if i == 3 else None) for i in range(n)]
    got = agreed(spark, links, records)
    assert got["hot", "time_raw"]["built"].split()[-2:] == ["nine", "pm"] and got["hot", "shape"]["canonical_input_id"] == "r003"


def test_trust_then_date_then_id(spark):
    links = [("e", "a"), ("e", "b"), ("e", "b"), (" e ", "c"), ("one", "a"), (None, "a"), ("", "b"), ("e", None), ("n", "x"), ("n", "y")]
    records = [("a", "good", T, "8:45", "UNK"), ("b", "good", T + dt.timedelta(1), "8:46", "disk"), ("c", "bad", T, "9:00", "oval"), ("x", "good", T, None, "none"), ("y", None, None, " - ", ""), ("b", "good", T + dt.timedelta(2), "8:46", "disk")]
    assert run(spark, links, records) == {("e", "time_raw"): "b", ("e", "shape"): "c"}
    tie = [("a", "good", T, "8:45", None), ("b", "good", T, "8:46", None)]
    assert run(spark, links[:2], tie) == {("e", "time_raw"): "a"}
    unlisted = [("a", "nobody", T, "8:45", None), ("b", "bad", T, "8:46", None)]
    assert run(spark, links[:2], unlisted) == {("e", "time_raw"): "b"}


def test_large_event(spark):
    n = BATCH * 30
    links = [("hot", f"r{i:05}") for i in range(n)]
    records = [(f"r{i:05}", "good" if i == 777 else "bad", T + dt.timedelta(minutes=i), f"{i} o'clock {i % 7}", "x" * 5000 if i == 3 else None) for i in range(n)]
    assert run(spark, links, records) == {("hot", "time_raw"): "r00777", ("hot", "shape"): "r00003"}


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [("e", "a"), ("e", "b")], []) == {}
    assert agreed(spark, [], []) == agreed(spark, [("e", "a"), ("e", "b")], []) == {}
