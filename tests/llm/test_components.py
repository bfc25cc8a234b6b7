"""Groups from pairwise verdicts, against union-find."""

from __future__ import annotations

import random

from nightloom.llm.components import connected_components, groups

REC, PAIR = "input_id string, event_id string, node string, u string", "left_input_id string, right_input_id string, verdict string, v string, root string"


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_random_graphs(spark):
    rng = random.Random(5)
    edges = [(f"{rng.randrange(400):04}", f"{rng.randrange(400):04}") for _ in range(300)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("hub", f"h{i}") for i in range(300)]
    expected = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    df = spark.createDataFrame([*edges, (None, "x"), ("x", None), ("y", "y")], "u string, v string")
    assert dict(connected_components(df).collect()) == expected
    assert connected_components(df.limit(0)).count() == 0


def test_groups(spark):
    rec = [("a", "e1", "", ""), ("b", " E1 ", "", ""), ("c", None, "", ""), ("D", "", "", ""), ("e", "e2", "", ""), ("f", None, "", ""), ("g", None, "", ""), ("h", None, "", ""), (None, "e1", "", ""), ("a", "e1", "", "")]
    pair = [(" B", "c", "same"), ("c", "B ", "same"), ("d", "E", "same"), ("f", "g", "different"), ("f", "g", "review"), ("g", "outside", "same"), ("outside", "h", "same"), ("f", None, "same"), ("", "f", "same"), ("f", "f", "same"), (None, None, None)]
    got = set(map(tuple, groups(spark.createDataFrame(rec, REC), spark.createDataFrame([(*p, "", "") for p in pair], PAIR)).collect()))
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("D", "D"), ("e", "D"), ("g", "g"), ("h", "g")}


def test_hot_event_and_empty(spark):
    rec = spark.createDataFrame([(f"r{i:05}", "hot", "", "") for i in range(3000)], REC)
    pairs = spark.createDataFrame([], PAIR)
    assert [tuple(r) for r in groups(rec, pairs).groupBy("group_id").count().collect()] == [("r00000", 3000)]
    assert groups(rec.limit(0), pairs).count() == 0
