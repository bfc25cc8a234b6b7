"""Collisions, exchanges of roles, block bootstrap, citations and control windows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from nightloom.operators import evidence


def test_collisions(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, ["a"], ["c"]), (3, None, ["c"]), (4, [], [])], "id int, l array<string>, r array<string>")
    apart, why = evidence.without_collisions(df, "l", "r")
    assert sorted(r["id"] for r in apart.collect()) == [2, 3, 4] and [tuple(r) for r in why.collect()] == [("b", 1)]


def test_role_exchange_against_draws(spark):
    rng = np.random.default_rng(0)
    table = rng.poisson(2.0, (40, 5))
    table[:, 0] += 3
    rows = [(f"c{i}", "observed" if r == 0 else f"k{r}", "x", int(table[i, r])) for i in range(40) for r in range(5) if table[i, r]]
    got = evidence.role_exchange(spark.createDataFrame(rows, "cluster string, role string, cell string, n int"), 5).first()
    sums = np.array([table[np.arange(40), rng.integers(0, 5, 40)].sum() for _ in range(4000)])
    assert got["observed"] == table[:, 0].sum() and got["expected"] == pytest.approx(sums.mean(), rel=0.02)
    assert (got["observed"] - got["expected"]) / got["z"] == pytest.approx(sums.std(), rel=0.06)


def test_block_bootstrap(spark):
    blocks = spark.createDataFrame([(f"b{i}", "disk", "oval", 10) for i in range(100)], "block string, focal string, neighbour string, n int")
    expected = spark.createDataFrame([("disk", "oval", 500.0)], "focal string, neighbour string, expected double")
    r = evidence.block_bootstrap(blocks, expected).first()
    # the sum of 100 Poisson weights of mean 1 spreads by about 10
    assert r["lower"] == pytest.approx(np.log2(800 / 500), abs=0.08) and r["upper"] == pytest.approx(np.log2(1200 / 500), abs=0.08)
    assert evidence.block_bootstrap(blocks, expected).first() == r


def test_citations(spark):
    codes = spark.createDataFrame([("AB", "A book")], "code string, citation string")
    rows = spark.createDataFrame([(1, " ab", "zz"), (2, None, ""), (3, "", "AB")], "id int, s string, i string")
    assert sorted(map(tuple, evidence.citations(rows, codes, "id", "s", "i").collect())) == [(1, "direct", "AB", "A book"), (1, "indirect", "ZZ", None), (3, "indirect", "AB", "A book")]


def test_votes(spark):
    df = spark.createDataFrame([("e", "a"), ("e", "a"), ("e", "b"), ("t", "a"), ("t", "b"), ("s", "c"), ("n", None)], "g string, v string")
    assert {r["g"]: (r["v"], r["votes"], r["status"]) for r in evidence.majority_vote(df, "g", "v").collect()} == {"e": ("a", 2, "conflict"), "t": (None, 1, "blocked"), "s": ("c", 1, "agreed")}


def test_soiled_controls_are_left_out(spark):
    days = spark.createDataFrame([(dt.date(2000, 1, 1) + dt.timedelta(i), 1) for i in range(1500)], "day date, n int")
    anchors = spark.createDataFrame([("a", dt.date(2001, 6, 1)), ("b", dt.date(2002, 6, 3))], "id string, day date")
    got = {(r["anchor"], r["role"]): (r["windows"], r["n"]) for r in evidence.with_controls(days, anchors, 5, (-364, 364), "2000-01-01", "2004-01-01").collect()}
    assert got == {("a", "test"): (1, 11), ("a", "control"): (1, 11), ("b", "test"): (1, 11), ("b", "control"): (1, 11)}


def test_shuffled_labels_keep_strata(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", f"l{i % 5}") for i in range(90)], "id int, s string, l string")
    new = evidence.shuffled_labels(rows, "s", "l", 7).join(rows, "id")
    assert new.count() == 90 and new.where("label <> l").count() > 30
    a = sorted(map(tuple, new.groupBy("s", "label").count().collect()))
    assert a == sorted(map(tuple, rows.groupBy("s", "l").count().collect()))
