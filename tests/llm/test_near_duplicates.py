"""Near-duplicate texts against all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from nightloom.llm import near_duplicates as module
from nightloom.llm.near_duplicates import Comparer, Signer, bands_for, near_duplicate_classes, near_duplicates, packed_type, rows_for, sketches, width_of

SCHEMA = "id string, text string, words string, copy string, key long, head string"


def brute(rows, t=0.7):
    bags = {}
    for i, text in rows:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        if i is not None and len(w) >= 20:
            bags.setdefault(i, []).append(Counter(w))
    out = set()
    for (a, xs), (b, ys) in combinations(sorted(bags.items()), 2):
        for x in xs:
            for y in ys:
                common = sum((x & y).values())
                if common >= t * (sum(x.values()) + sum(y.values()) - common) - 1e-9:
                    out.add((a, b))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(18, 70))]
        for k in range(5):
            words = [w for w in base if rng.random() > 0.04 * k] + [rng.choice(vocabulary) for _ in range(k)]
            rng.shuffle(words)
            rows.append((f"g{g:02}-{k}", " ".join(words).title() + "!"))
    rows += [(f"copy{i:02}", " ".join(["same", "old", "words"] * 8)) for i in range(30)]
    rows += [("null", None), ("empty", ""), ("blank", " \t"), ("short", "too short"), (None, rows[0][1]), ("g00-0", rows[0][1]), ("long", "lorem " * 100_000), ("signs", "ñ" * 500)]
    df = spark.createDataFrame([(*r, "", "", 0, "") for r in rows], SCHEMA)
    got = [tuple(r) for r in near_duplicates(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    # without a chance of a miss, by buckets of like lengths
    assert {tuple(r) for r in near_duplicates(df, miss=None).collect()} == brute(rows)
    links, members = near_duplicate_classes(df)
    assert members.groupBy("head").count().agg({"count": "max"}).first()[0] == 30 and links.count() < len(got) - 400


def test_texts_of_all_lengths(spark):
    rng = random.Random(5)
    rows = []
    for n in (280, 299, 300, 301, 420, 430, 590, 605, 1190, 1210, 2500):
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        rows += [(f"t{n}-{k}", " ".join(base[: int(n * (1 - 0.1 * k))] + [f"x{k}"] * k)) for k in range(4)]
    df = spark.createDataFrame([(*r, "", "", 0, "") for r in rows], SCHEMA)
    assert {tuple(r) for r in near_duplicates(df).collect()} == {tuple(r) for r in near_duplicates(df, miss=None).collect()} == brute(rows)


def test_an_id_with_two_texts_and_rows_told_often(spark):
    rng = random.Random(8)
    one, two = ([f"{p}{rng.randrange(500)}" for _ in range(60)] for p in "uv")
    rows = [("a", " ".join(one)), ("b", " ".join(one)), ("b", " ".join(two)), ("c", " ".join([*two[:-2], "other"])), ("d", " ".join([*one[:-2], "other"]))]
    df = spark.createDataFrame([(*r, "", "", 0, "") for r in rows * 40], SCHEMA)
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute(rows) == {("a", "b"), ("b", "c"), ("a", "d"), ("b", "d")}


def test_rows_of_a_band_follow_the_buckets(spark, monkeypatch):
    asked = []
    plain = module.candidate_pairs
    monkeypatch.setattr(module, "candidate_pairs", lambda reps, t, least, shape, hot: asked.append(shape) or plain(reps, t, least, shape, hot))
    rng = random.Random(3)
    rows = [(f"i{i:03}", " ".join(f"w{rng.randrange(60)}" for _ in range(60))) for i in range(120)]
    df = spark.createDataFrame([(*r, "", "", 0, "") for r in rows], SCHEMA)
    near_duplicates(df).count()
    monkeypatch.setattr(module, "BUCKET", 1)
    near_duplicates(df).count()
    assert asked[0] == (3, 17) and asked[1][0] > 3 and asked[1][1] == bands_for(asked[1][0], 0.7, 1e-3)


def test_hot_bucket_is_split(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    rows = [(f"n{i:03}", " ".join([*rng.sample(base, 38), f"own{i}"])) for i in range(150)] + [(f"m{i:03}", " ".join(rng.choice(base) + str(i) for _ in range(30))) for i in range(50)]
    df = spark.createDataFrame([(*r, "", "", 0, "") for r in rows], SCHEMA).coalesce(1)
    assert {tuple(r) for r in near_duplicates(df, hot_rows=4).collect()} == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_exceeds_difference():
    rng = random.Random(2)
    texts = [[f"w{rng.randrange(60)}" for _ in range(rng.randint(20, 200))] for _ in range(60)]
    _, count, bits = Signer(3, 5).sign(texts)
    for width in (4, 16):
        sketch = sketches(count, bits, width)
        for i, j in combinations(range(60), 2):
            far = int(np.bitwise_count(sketch[i] ^ sketch[j]).sum())
            a, b = Counter(texts[i]), Counter(texts[j])
            assert far <= sum(((a - b) + (b - a)).values())
    assert list(count) == [len(t) for t in texts]
    assert width_of(np.array([1, 300, 301, 600, 601, 10**7])).tolist() == [4, 4, 8, 8, 16, 256]


def test_tiles_equal_offsets():
    rng = np.random.default_rng(0)
    rows = np.zeros(1300, packed_type(4))
    rows["id"], rows["words"] = np.arange(1300), rng.integers(20, 120, 1300)
    base = rng.integers(0, 2**63, (50, 4), dtype=np.uint64) & rng.integers(0, 2**63, (50, 4), dtype=np.uint64) & rng.integers(0, 2**63, (50, 4), dtype=np.uint64)
    rows["sketch"] = base[rng.integers(0, 50, 1300)] ^ (np.uint64(1) << rng.integers(0, 63, (1300, 1), dtype=np.uint64))
    c = Comparer(0.7)
    by_tile = {tuple(sorted(p)) for part in c.by_tile(rows) for p in part.tolist()}
    by_offset = {tuple(sorted(p)) for part in c.by_offset(np.zeros(1300, np.int64), rows) for p in part.tolist()}
    assert by_tile == by_offset and by_tile


def test_bands_keep_their_promise():
    for rows in (3, 6, 9, rows_for(10_000_000_000)):
        assert (1 - 0.7**rows) ** bands_for(rows, 0.7, 1e-3) <= 1e-3
