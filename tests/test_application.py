"""The catalogue object, the batch build, streams and the atlas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from nightloom.operators import atlas, evidence
from nightloom.operators.predicates import Filters
from nightloom.plans.application import KEPT, Catalogue, build_catalogue
from nightloom.streaming import windows

ROWS = "event_id int, source string, type string, precision string, date_precision string, legend string, day date, description string"


def rows(spark):
    data = [(i, f"s{i % 3}", f"t{i % 2}", "exact" if i % 5 else "unknown", "day", f"l{i % 4}", dt.date(2000 + i % 10, 1, 1), "red light" if i % 7 == 0 else "nothing") for i in range(60)]
    return spark.createDataFrame(data, ROWS).withColumns({"date_start": F.col("day"), "date_end": F.col("day")})


def test_facets_see_other_selections(spark):
    c = Catalogue(rows(spark))
    got = {(r["facet"], r["value"]): r["n"] for r in c.facets(Filters(selected={"source": ("s0",), "type": ("t1",)})).collect()}
    data = c.rows.collect()
    assert got[("source", "s2")] == sum(r["source"] == "s2" and r["type"] == "t1" for r in data)
    assert got[("type", "t0")] == sum(r["source"] == "s0" and r["type"] == "t0" for r in data)
    assert got[("legend", "l3")] == sum(r["source"] == "s0" and r["type"] == "t1" and r["legend"] == "l3" for r in data)
    assert c.facets(Filters(reject=("source",))).count() == 0


def test_results_are_kept_until_rows_change(spark):
    c = Catalogue(rows(spark))
    f = Filters(selected={"type": ("t1",)})
    assert c.ids(f) is c.ids(f) and c.ids(f, "red light") is not c.ids(f)
    assert {r[0] for r in c.run(c.ids(f, "red light"), "a-tag")} == {i for i in range(60) if i % 7 == 0 and i % 2 == 1}
    first = c.ids(f)
    c.append(rows(spark).withColumn("event_id", F.col("event_id") + 100))
    assert c.ids(f) is not first and c.ids(f).count() == 2 * first.count()
    for i in range(2 * KEPT):
        c.ids(Filters(selected={"type": (str(i),)}))
    assert len(c._cache) == KEPT


def test_analysis_by_baseline(spark):
    c = Catalogue(rows(spark))
    got = c.analyse(Filters(), "2000-01-01", "2002-12-31", "previous_equal_duration").collect()
    assert all(r["c"] == 0 for r in got)
    assert all(r["q"] is None for r in c.analyse(Filters(), "2000-01-01", "2002-12-31", "full_catalog").collect())


def test_batch_build(spark, tmp_path):
    head = "No,Occurred,Location,Location details,Shape,Duration,Reported,Posted,Explanation,Characteristics,Color,Description,note\n"
    line = '{n},{at},"Phoenix, AZ",,Disk,5 min,,,,,,"{text}",\n'
    a, b = tmp_path / "a" / "nuforcpy.csv", tmp_path / "b" / "nuforcpy.csv"
    for p, body in ((a, [(1, "1999-05-06 21:30", "A red light."), (2, "1999-05-07 21:30", "Another light.")]), (b, [(9, "05/06/1999 21:30", "A RED light"), (8, "", "No date.")])):
        p.parent.mkdir()
        p.write_text(head + "".join(line.format(n=n, at=at, text=t) for n, at, t in body))
    got = build_catalogue(spark, {"nuforcpy.csv": str(tmp_path / "*" / "nuforcpy.csv")}, str(tmp_path / "out"), 2)
    assert got["provenance"].count() == 4 and got["events"].count() == 3
    assert got["manifest"].agg(F.sum("rows"), F.max("rows")).first()[:] == (3, 2)


def test_streams(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for part in range(3):
        data = [(part * 100 + i, base + dt.timedelta(hours=part * 30 + i), i % 2) for i in range(20)]
        spark.createDataFrame(data, "id int, ts timestamp, k int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.read.parquet(str(tmp_path / "in")).where("id < 5").write.mode("append").parquet(str(tmp_path / "in"))
    s = windows.read_stream(spark, str(tmp_path / "in"), "id int, ts timestamp, k int", 10)
    once = windows.run_available(windows.deduplicated(s, ["id"], "ts", "10 days"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert once.count() == 60
    again = windows.run_available(windows.deduplicated(s, ["id"], "ts", "10 days"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert again.count() == 60
    bursts = windows.run_available(windows.running_bursts(s, "k", "ts", "10 days", 5 * 3600, 3), str(tmp_path / "o2"), str(tmp_path / "c2")).collect()
    assert bursts and all(r["n"] >= 3 for r in bursts)


def test_atlas_states_and_bounds(spark):
    df = spark.createDataFrame([("r", "s1", "a", True, False), ("r", "s1", None, True, False), ("r", "s2", "b", True, False), ("r", "s2", "a", False, False), ("r", "s2", "a", True, True)], "row string, source string, v string, ready boolean, out boolean")
    t = atlas.atlas(df, "row", "source", {"x": (F.col("v"), F.col("ready"), F.col("out"))})
    assert {r["state"] for r in t.collect()} == {"supported", "unknown", "not_loaded", "excluded"}
    got = {r["column"]: tuple(round(r[c], 4) for c in ("row_share", "balanced_share", "low", "high")) for r in atlas.atlas_cells(t).collect()}
    assert got["a"] == (0.5, 0.5, 0.3333, 0.6667)


def test_tokens_and_polygons(spark):
    df = spark.createDataFrame([("a/b?ü", 1), (None, 2)], "x string, y int")
    token = evidence.encode_token(F.struct("x", "y"))
    back = df.select(token.alias("t")).select(evidence.decode_token(F.col("t"), "x string, y int").alias("b"), evidence.decode_token(F.lit("v2.zzz"), "x string").alias("no")).collect()
    assert [(r["b"]["x"], r["b"]["y"]) for r in back] == [("a/b?ü", 1), (None, 2)] and back[0]["no"] is None
    p = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 1.0)], "lat double, lon double")
    assert [r[0] for r in p.select(evidence.in_polygon(F.col("lat"), F.col("lon"), [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)])).collect()] == [True, False, False]


def test_duration_texts(spark):
    texts = {"10 sec": 10.0, "about an hour": 3600.0, "5-10 minutes": 450.0, "half an hour": 1800.0, "2 hrs": 7200.0, "soon": None, "": None, "1.5 min": 90.0}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: r[1] for r in df.select("t", atlas.duration_seconds(F.col("t"))).collect()} == texts
