"""Queries over records of all sources, on a dense copy of the tables."""

from __future__ import annotations

import shutil

import numpy as np
import pytest
from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from nightloom import queries
from nightloom.operators import cohort, evidence, proximity
from nightloom.session import table


@pytest.fixture(scope="module")
def dense(spark, sf_dir, tmp_path_factory):
    """The test tables' reports, all dated and close to each other."""
    d = tmp_path_factory.mktemp("dense")
    h = lambda n, seed: F.pmod(F.xxhash64("canonical_input_id", F.lit(seed)), F.lit(n))
    c = table(spark, sf_dir, "canonical_input").dropDuplicates(["canonical_input_id"])
    c = c.withColumns({"lat": 40 + h(900, 1) / 100, "lon": -100 + h(900, 2) / 100, "date_iso": F.date_add(F.lit("1990-01-01").cast("date"), h(900, 3).cast("int")).cast("string"), "shape_normalized": F.element_at(F.array(*map(F.lit, ["disk", "oval", "cigar", "light"])), (h(4, 4) + 1).cast("int"))})
    c.coalesce(1).write.parquet(f"{d}/all")
    next(d.glob("all/*.parquet")).rename(d / "canonical_input.parquet")
    shutil.copy(f"{sf_dir}/place_ref.parquet", d / "place_ref.parquet")
    return str(d)


def test_craft_exposure_has_all_sources(spark, dense):
    assert rows_of(queries.QUERIES["craft_exposure"](spark, dense)) == sql_rows(queries.SQL["craft_exposure"], dense)


def test_first_later_has_all_sources(spark, dense):
    assert rows_of(queries.QUERIES["first_later_day_nearest"](spark, dense)) == sql_rows(queries.SQL["first_later_day_nearest"], dense)


def test_craft_cooccurrence_has_499_draws(spark, dense):
    got = {(r["focal"], r["neighbour"]): r for r in queries.QUERIES["craft_cooccurrence"](spark, dense).collect()}
    seen = {(r["focal"], r["neighbour"]): r["n"] for r in queries.QUERIES["craft_exposure"](spark, dense).collect()}
    assert {k: r["observed"] for k, r in got.items() if r["observed"]} == seen
    assert all(abs(r["expected"] * 499 - round(r["expected"] * 499)) < 0.01 for r in got.values()) and any(abs(r["expected"] * 5 - round(r["expected"] * 5)) > 0.01 for r in got.values())


def test_expected_matrix_is_the_mean_of_its_draws(spark):
    n = 150
    rows = spark.createDataFrame([(f"r{i}", f"s{i % 2}", f"c{i % 70}") for i in range(n)], "id string, s string, l string")
    edges = spark.createDataFrame([(f"r{i}", f"r{(i * 7 + j) % n}") for i in range(n) for j in (1, 2, 3) if i < (i * 7 + j) % n], "a string, b string").distinct()
    want = {}
    for seed in range(3):
        for r in evidence.exposure_matrix(edges, evidence.shuffled_labels(rows, "s", "l", seed)).collect():
            want[r["focal"], r["neighbour"]] = want.get((r["focal"], r["neighbour"]), 0) + r["n"]
    got = {(r["focal"], r["neighbour"]): round(r["expected"] * 3) for r in evidence.expected_matrix(edges, rows, "s", "l", 3).collect()}
    assert got == want


def _random_segments(spark, n):
    r = np.random.default_rng(3)
    ends = [(f"t{i}", f"f{i}", f"g{i}", *map(float, (r.uniform(-80, 80), x := r.uniform(-180, 180), r.uniform(-80, 80), x + r.uniform(-179, 179)))) for i in range(n)]
    return ends, spark.createDataFrame(ends, "trace_id string, from_id string, to_id string, from_lat double, from_lon double, to_lat double, to_lon double")


def test_points_along_long_segments(spark):
    ends, segments = _random_segments(spark, 40)
    places = [(f"p{i}", float(a), float(b)) for i, (a, b) in enumerate(np.random.default_rng(4).uniform((-85, -180), (85, 180), (400, 2)))]
    want = {}
    for t, _, _, y1, x1, y2, x2 in ends:
        for p, lat, lon in places:
            for turn in (-360, 0, 360):
                k = np.cos(np.radians(lat)) * 111.195
                a, b = np.array([(x1 + turn - lon) * k, (y1 - lat) * 111.195]), np.array([(x2 + turn - lon) * k, (y2 - lat) * 111.195])
                f = np.clip(-a @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                if (d := np.linalg.norm(a + f * (b - a))) <= 40:
                    want[t, p] = min(want.get((t, p), 99), d)
    got = {(r["trace_id"], r["id"]): r["km"] for r in proximity.points_along(segments, spark.createDataFrame(places, "id string, lat double, lon double"), 40.0, 1.0).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 20


def test_crossings_over_the_date_line(spark):
    ends, segments = _random_segments(spark, 60)
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    want, plain = set(), set()
    for t, _, _, y1, x1, y2, x2 in ends:
        for u, _, _, v1, w1, v2, w2 in ends:
            for turn in (-360, 0, 360):
                a, b, c, d = (x1, y1), (x2, y2), (w1 + turn, v1), (w2 + turn, v2)
                if t < u and side(c, d, a) * side(c, d, b) < 0 and side(a, b, c) * side(a, b, d) < 0:
                    (want if turn else plain).add((t, u))
    got = [(r["a"], r["b"]) for r in proximity.crossings(segments).collect()]
    assert len(got) == len(set(got)) and set(got) == want | plain and want - plain


def test_crossings_keep_off_ends_and_flat_angles(spark):
    kind = "trace_id string, from_id string, to_id string, from_lat double, from_lon double, to_lat double, to_lon double"
    lines = [("a", "a1", "a2", 0.0, 170.0, 0.0, 190.0), ("b", "b1", "b2", -1.0, -175.0, 1.0, -175.0), ("c", "c1", "c2", -0.01, 180.0, 5.0, 180.0), ("d", "d1", "d2", -0.5, 171.0, 0.5, 189.0), ("e", "a1", "e2", -1.0, 175.0, 1.0, 175.0)]
    segments = spark.createDataFrame(lines, kind)
    pairs = lambda **k: {(r["a"], r["b"]) for r in proximity.crossings(segments, **k).collect()}
    assert pairs() == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "d"), ("d", "e"), ("c", "d")}
    assert pairs(buffer_km=2.0) == pairs() - {("a", "c"), ("c", "d")} and pairs(least_angle=15.0) == pairs() - {("a", "d")}
    at = {(r["a"], r["b"]): r for r in proximity.crossings(segments).collect()}
    assert at["a", "b"]["lon"] == pytest.approx(-175) and at["a", "b"]["angle"] == pytest.approx(90)


def test_opportunities_leave_out_pairs_that_share_an_end(spark):
    cells = spark.createDataFrame([("x", "1", "p", "q"), ("x", "2", "q", "r"), ("x", "3", "s", "t"), ("y", "1", "p", "q")], "cell string, connector string, from_id string, to_id string")
    assert {(r["cell"], r["opportunities"]) for r in evidence.cell_opportunities(cells).collect()} == {("x", 2), ("y", 0)}


@pytest.mark.parametrize("name", ["segment_crossings", "point_to_segment"])
def test_segment_queries_have_every_segment(spark, dense, name):
    assert rows_of(queries.QUERIES[name](spark, dense)) == sql_rows(queries.SQL[name], dense)


def test_bursts_finds_the_month_that_stands_out(spark):
    n = spark.createDataFrame([(m, 300 if m == 40 else 100 + m % 2) for m in range(60)], "month int, n long")
    assert [r["month"] for r in cohort.bursts(n, "month", "n", least=10, least_mean=5.0, ratio=2.0, sigmas=3.0).collect()] == [40]
