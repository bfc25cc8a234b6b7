"""Operators of the core on small fixtures."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.functions import dates, stats
from nightloom.functions.unknown import says_something
from nightloom.operators import atlas, dedupe, graph, predicates, proximity, resampling, search, sequence
from nightloom.sources import files


@pytest.mark.parametrize(
    ("query", "mode", "text", "expected"),
    [
        ("soil sample", "auto", "a SOIL sample taken", True), ("soil sample", "auto", "sample of soil", False), ("soil sample", "all", "sample of soil", True), ("soil moon", "any", "the moon", True),
        ("a AND b OR c", "auto", "c", True), ("(b OR c) AND a", "auto", "c", False), ('"x y" AND z', "auto", "z x y", True), ("red light OR blue", "auto", "a red light", True), ("and", "auto", "sand", True), ("", "auto", "anything", True),
    ],
)
def test_search(spark, query, mode, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.where(search.matches(search.compile_query(query, mode), F.lower("t"))).count() == int(expected)


@pytest.mark.parametrize(
    ("query", "code"),
    [('"open', "unclosed_quote"), ('a AND ""', "empty_phrase"), ('"a" "b"', "missing_operator"), ("a AND (b", "unclosed_group"), ("a AND b)", "unmatched_group"), ("a AND", "missing_term"), ("x" * 600, "too_long"), ("(" * 20 + "a AND b" + ")" * 20, "too_deep"), ('"a\\n" AND b', "invalid_escape"), (" OR ".join("ab" for _ in range(40)), "too_many_clauses")],
)
def test_search_errors(query, code):
    with pytest.raises(search.QueryError) as e:
        search.compile_query(query)
    assert e.value.code == code


def test_match_ranges_merge(spark):
    df = spark.createDataFrame([("aXbanana",), (None,)], "t string")
    tree = search.compile_query('"ana" OR "ban"')
    got = [r[0] for r in df.select(search.match_ranges(F.col("t"), tree)).collect()]
    assert [tuple(x) for x in got[0]] == [(2, 8)] and got[1] is None


def test_unknown_markers(spark):
    df = spark.createDataFrame([("UNK ",), ("  ",), (None,), ("N/A",), ("disk",), ("-",), ("Not_Provided",)], "v string")
    assert [r[0] for r in df.select(says_something(F.col("v"))).collect()] == [False, False, False, False, True, False, False]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("10/12/1951", ("1951-10-12", "1951-10-12", "exact_day")), ("1/7/50", ("1950-01-07", "1950-01-07", "exact_day")), ("Winter 1999", ("1999-12-01", "2000-02-29", "season")), ("Late 7/1947", ("1947-07-22", "1947-07-31", "month")),
        ("early May 1947", ("1947-05-01", "1947-05-10", "month")), ("1980's?", ("1980-01-01", "1989-12-31", "approximate")), ("c. 1977", ("1977-01-01", "1977-12-31", "approximate")), ("1/2/1990 - 1/4/1990", ("1990-01-02", "1990-01-04", "range")), ("2/30/1990", None), ("", None), ("lately", None),
    ],
)
def test_date_expressions(text, expected):
    got = dates.parse_expression(text)
    assert (got and (str(got[0]), str(got[1]), got[2])) == expected


def test_ambiguous_local_times(spark):
    df = spark.createDataFrame([(dt.datetime(2013, 11, 3, 1, 30),), (dt.datetime(2013, 3, 10, 2, 30),), (dt.datetime(2013, 7, 1, 12),)], "t timestamp")
    assert [r[0] for r in df.select(dates.local_to_utc(F.col("t"), F.lit("America/New_York"))["state"]).collect()] == ["ambiguous", "missing", "exact"]


def test_components_chain_and_star(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    star = [("z000", f"z{i:03}") for i in range(1, 200)]
    edges = spark.createDataFrame([*chain, *star, ("q", "q"), (None, "q"), ("n005", "n004")], "a string, b string")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert len(got) == 61 + 200 and {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] == "z"} == {"z000"}
    assert graph.components(edges.limit(0)).count() == 0


def test_global_segments_equal_one_window(spark):
    rows = [(i, dt.date(2000, 1, 1 + i % 9), float(i % 50), float(i % 170), "s", i * 7 % 13) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, day date, lat double, lon double, source string, k int")
    one = df.withColumn("all", F.lit(1))
    a = {r[0] for r in sequence.global_segments(df, "k").select("trace_id").collect()}
    b = {r[0] for r in sequence.segments(one, ["all"], ["day", "k"]).select("trace_id").collect()}
    assert a == b and len(a) == 199


def test_date_line_and_gap(spark):
    rows = [(1, dt.date(2000, 1, 1), 10.0, 170.0, "mufon"), (2, dt.date(2000, 1, 2), 10.0, -170.0, "ufocat")]
    s = sequence.segments(spark.createDataFrame(rows, "event_id int, day date, lat double, lon double, source string").withColumn("g", F.lit(0)), ["g"], ["day"]).first()
    assert (s["to_lon"], s["gap_days"], s["bucket"], s["pair"]) == (190.0, 1, "gap_le_1", "mufon->ufocat")


def test_spanning_forest(spark):
    rows = [(str(i), dt.date(2000, 1, 1), 0.0, float(i)) for i in range(6)] + [("far", dt.date(2000, 1, 1), 60.0, 100.0), ("other", dt.date(2000, 1, 2), 0.0, 0.5)]
    f = proximity.day_forest(spark.createDataFrame(rows, "id string, day date, lat double, lon double"), 500.0).collect()
    assert sorted((r["a"], r["b"]) for r in f) == [(str(i), str(i + 1)) for i in range(5)]


def _kruskal(rows, km):
    """The forest by trying all pairs of a day in order of (km, ids)."""
    def far(p, q):
        h = math.sin((math.radians(q[2]) - math.radians(p[2])) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))

    root, out = {r[0]: r[0] for r in rows}, []
    pairs = sorted((far(p, q), p[0], q[0], p[1]) for p in rows for q in rows if p[0] < q[0] and p[1] == q[1])
    for d, a, b, day in pairs:
        if 0 < d <= km and root[a] != root[b]:
            out.append((day, a, b, round(d, 6)))
            root = {k: root[a] if v == root[b] else v for k, v in root.items()}
    return sorted(out)


_POINTS = "id string, day date, lat double, lon double"


def _forest(spark, rows, km, **more):
    return sorted((r["day"], r["a"], r["b"], round(r["km"], 6)) for r in proximity.day_forest(spark.createDataFrame(rows, _POINTS), km, **more).collect())


def test_spanning_forest_of_many_rounds(spark):
    """Trees that only ever join in twos: the estimates of the former rounds of joins filled the driver."""
    at, rows = 0.0, []
    for i in range(1, 65):
        rows.append((f"{i:02d}", dt.date(2000, 1, 1), 0.0, round(at, 4)))
        at += 0.1 * (i & -i) + 0.001 * i
    assert _forest(spark, rows, 3000.0) == _kruskal(rows, 3000.0) and len(_kruskal(rows, 3000.0)) == 63
    assert _forest(spark, rows, 3000.0, block=16) == _kruskal(rows, 3000.0)


def test_spanning_forest_equals_kruskal(spark):
    rng = random.Random(7)
    rows = [(f"p{i}", dt.date(2000, 1, 1 + rng.randrange(6) * rng.randrange(2)), round(rng.uniform(-89, 89), 1), round(rng.uniform(-180, 180), 1)) for i in range(150)]
    rows += [(f"q{i}", r[1], r[2], r[3]) for i, r in enumerate(rows[:20])]  # positions that are shared
    rows += [("n", dt.date(2000, 1, 1), 90.0, 0.0), ("w", dt.date(2000, 1, 2), 0.0, -180.0), ("e", dt.date(2000, 1, 2), 0.0, 179.9), ("lone", dt.date(1990, 1, 1), 0.0, 0.0)]
    for km in (800.0, 3000.0):
        want = _kruskal(rows, km)
        assert _forest(spark, rows, km) == want and _forest(spark, rows, km, block=30) == want
    assert _forest(spark, [r for r in rows if r[0] == "lone"], 3000.0) == [] and _forest(spark, [], 3000.0) == []


def test_spanning_forest_goes_on_over_batches(spark):
    rows = [(f"{d:05d}-{i}", dt.date(1950, 1, 1) + dt.timedelta(d), 10.0, float(i * i)) for d in range(3400) for i in range(4)]
    one = spark.createDataFrame(rows, _POINTS)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        f = proximity.day_forest(one, 3000.0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert len(f) == 3 * 3400 and all(r["a"][:5] == r["b"][:5] for r in f)


def test_near_pairs_at_poles_and_date_line(spark):
    a = spark.createDataFrame([("x", 89.9, 0.0), ("y", 0.0, 179.9)], "id string, lat double, lon double")
    b = spark.createDataFrame([("p", 89.9, 180.0), ("q", 0.0, -179.9), ("r", 10.0, 0.0)], "id string, lat double, lon double")
    assert sorted((r[0], r[1]) for r in proximity.near_pairs(a, b, 50.0, 5.0).collect()) == [("x", "p"), ("y", "q")]


def test_partial_boundaries():
    assert predicates.boundary_date("1999-02", "end") == "1999-02-28" and predicates.boundary_date("1999", "start") == "1999-01-01" and predicates.boundary_date("1999-13", "end") is None


def test_oversized_blocks_are_told(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(5)] + [(9, "x"), (8, "x")], "id int, b string")
    assert dedupe.blocked_pairs(df, ["b"], cap=3).count() == 1 and dedupe.blocked_pairs(df, ["b"]).count() == 11
    assert [tuple(r) for r in dedupe.oversized_blocks(df, ["b"], 3).collect()] == [("hot", 5)]


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "a int, n int")
    low, high = stats.wilson(F.col("a"), F.col("n"))
    got = [(round(r[0], 4), round(r[1], 4)) for r in df.select(low, high).collect()]
    assert got == [(0.0, 1.0), (0.0, 0.2775), (0.7225, 1.0), (0.2366, 0.7634)]


def test_resampling_is_repeatable_and_sound(spark):
    rows = [("same", 50, 100, 100, 200), ("same", 20, 80, 40, 160), ("apart", 90, 100, 100, 200), ("apart", 70, 80, 40, 160)]
    df = spark.createDataFrame(rows, "key string, a long, a_total long, c long, c_total long")
    p = {r["key"]: r["p"] for r in resampling.permutation_test(df, "key").collect()}
    assert p["apart"] == pytest.approx(1 / 500) and p["same"] > 0.5
    one, two = (sorted(map(tuple, resampling.bootstrap_difference(df, "key").collect())) for _ in range(2))
    assert one == two and np.isclose(one[1][1], 0.0) and one[0][2] > 0.3


def test_import_delimited(spark, tmp_path):
    (tmp_path / "mufonpy.csv").write_text('No,Date Submitted,Date/Time of Event,Short Description,Location of Event,Long Description,Attachments\n7,2001-01-02,1999-05-06\\n21:30,short,"Phoenix\\, AZ","two\nlines",\n8,,,,,,\n')
    r = files.import_records(spark, str(tmp_path / "mufonpy.csv")).orderBy("_row").collect()
    assert (r[0]["date_raw"], r[0]["time_raw"], r[0]["location_raw"], r[0]["description"]) == ("1999-05-06", "21:30", "Phoenix, AZ", "two\nlines")
    assert r[0]["_row"] == 2 and r[1]["date_raw"] is None and r[0]["canonical_input_id"] != r[1]["canonical_input_id"]


def test_rows_are_numbered_in_every_file(spark, tmp_path):
    head = "No,Date Submitted,Date/Time of Event,Short Description,Location of Event,Long Description,Attachments\n"
    for name, ids in (("a.csv", (1, 2, 3)), ("b.csv", (4, 5))):
        (tmp_path / name).write_text(head + "".join(f"{i},2001-01-02,1999-05-06,s{i},x,y,z\n" for i in ids))
    for multi_line in (True, False):
        r = files.read_delimited(spark, str(tmp_path), multi_line).collect()
        assert {(x["_file"], x["No"], x["_row"]) for x in r} == {("a.csv", "1", 2), ("a.csv", "2", 3), ("a.csv", "3", 4), ("b.csv", "4", 2), ("b.csv", "5", 3)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        (tmp_path / "c.csv").write_text(head + "".join(f"{i},2001-01-02,1999-05-06,s{i},x,y,z\n" for i in range(200)))
        assert all(x["_row"] == int(x["No"]) + 2 for x in files.read_delimited(spark, str(tmp_path / "c.csv"), multi_line=False).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_import_of_ragged_rows(spark, tmp_path):
    head = "No,Date Submitted,Date/Time of Event,Short Description,Location of Event,Long Description,Attachments\n"
    (tmp_path / "mufonpy.csv").write_text(head + '1,2001-01-02,1999-05-06,s,"a, b",y,z,more,"and, more"\n2,2001-01-02,1999-05-06\n3,2001-01-02,1999-05-06,s,x,y,z\n')
    r = files.import_records(spark, str(tmp_path / "mufonpy.csv")).orderBy("_row").collect()
    assert [(x["anomaly"], x["extra"] or []) for x in r] == [("extra_columns", ["more", "and, more"]), ("missing_columns", []), (None, [])]
    assert [x["date_raw"] for x in r] == ["1999-05-06"] * 3 and r[0]["location_raw"] == "a, b"


def test_result_page(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(50)], "k int, v int")
    want = sorted(((i, i % 7) for i in range(50)), key=lambda x: (x[1], x[0]))
    at = want.index((23, 2)) // 6 * 6
    assert [tuple(r) for r in atlas.result_page(df, ["v", "k"], "k", 23, 6).collect()] == want[at : at + 6] and atlas.result_page(df, ["v"], "k", 99, 6).count() == 0


def test_ragged_rows(spark):
    df = spark.createDataFrame([("1,2",), ("1,2,3,4",), ("1",)], "line string").select(files.split_cells(F.col("line"), ["a", "b"]).alias("x")).select("x.*")
    assert [(r["cells"], r["extra"], r["anomaly"]) for r in df.collect()] == [({"a": "1", "b": "2"}, [], None), ({"a": "1", "b": "2"}, ["3", "4"], "extra_columns"), ({"a": "1"}, [], "missing_columns")]


def test_chronology_text(spark, tmp_path):
    text = "Year: 1947\n\nEvent 12 (0badc0de)\nDate: 7/1947\nLocation: Roswell, NM\nDescription: A long\n  story.\nReference: one\nReference: two\nColour: red\n\nYear: 1950\nEvent 13 (0badc0df)\nLocation: none\n"
    (tmp_path / "t.txt").write_text(text)
    r = files.read_chronology(spark, str(tmp_path / "t.txt")).orderBy("pos").collect()
    assert [(x["event_id"], x["year_heading"], x["date"], x["warnings"]) for x in r] == [("12", "1947", "7/1947", []), ("13", "1950", None, ["missing_date"])]
    assert r[0]["description"] == "A long story." and r[0]["references"] == ["one", "two"] and r[0]["other"] == {"Colour": "red"}
