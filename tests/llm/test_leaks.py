"""Leaked passages against a plain search for word runs."""

from __future__ import annotations

import random

import pytest

from nightloom.llm.leaks import ItemIndex, find_leaks, words

PASSAGE = "Although the magnet cooled for hours, no reviewer guessed how seven silvered lamps faded around a lens before the second bell."
W = PASSAGE.split()


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        (" ".join(W[:13]), True), (" ".join(W[:12]), False), (" ".join(W[2:15]).upper() + "!!", True), ("<b>" + "</b> <i>".join(W[:13]) + "</i>", True), ("<p>" + "</p><p>".join(W[:13]), True),
        (" ".join(W[3:17]), True), (" ".join(W[:6]) + " again " + " ".join(W[6:15]), False), ("mag​net ".join(["Although the ", " ".join(W[3:16])]), True), ("x " * 3000 + " ".join(W[4:18]) + " y" * 3000, True),
        ("<p>" + " ".join(W[:6]) + f' <img alt="" src="data:{"A" * 5000}"> ' + " ".join(W[6:14]), True), (" ".join(W[:6]) + "<!-- " + "x <b> " * 300 + "-->" + " ".join(W[6:14]), True), (" ".join(W[:6]) + " <!-- " * 3000 + " ".join(W[6:15]), True),
        (" ".join(reversed(W)), False), ("&#65;lthough the magnet cooled for hours no reviewer guessed how seven silvered lamps", True), (None, False), ("", False), ("𝐀lthough the magnet cooled for hours, no reviewer guessed how seven silvered lamps", True),
    ],
)
def test_texts(text, leaks):
    assert bool(text and ItemIndex([("i", PASSAGE), ("other", "one two three " * 9)]).leaked(text)) == leaks


def test_search_loses_nothing():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(f"i{k:03}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(13, 60)))) for k in range(120)]
    index = ItemIndex(items)
    grams = {k: {tuple(words(p)[i : i + 13]) for i in range(len(words(p)) - 12)} for k, p in items}
    for _ in range(150):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 160))]
        for _ in range(rng.randint(0, 3)):
            p = words(rng.choice(items)[1])
            n = rng.randint(10, 20)
            a, b = rng.randint(0, max(0, len(p) - n)), rng.randint(0, len(text))
            text[b:b] = p[a : a + n]
        mine = {tuple(text[i : i + 13]) for i in range(len(text) - 12)}
        assert set(index.leaked(" ".join(text))) == {k for k, g in grams.items() if g & mine}


def test_blocks_are_skipped():
    rng = random.Random(9)
    items = [(f"i{k:04}", " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(13, 60)))) for k in range(1000)]
    index = ItemIndex(items, block=8)
    query = sorted({index.number[w] for w in words(items[500][1])})
    assert 500 in index.search(query) and index.skipped > 100 and index.scored < 600
    # as many as a full count finds
    scores = {}
    for t in query:
        for d, v in zip(*index.postings[t], strict=True):
            scores[d] = scores.get(d, 0) + v
    assert index.search(query) == sorted(d for d, v in scores.items() if v >= 1 - 1e-9)


def test_many_items_make_many_indexes(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE.replace("magnet", "kettle"))], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{k}", PASSAGE.replace("magnet", "kettle") if k % 2 else PASSAGE) for k in range(9)], "item_id string, passage string")
    one, many = (sorted(map(tuple, find_leaks(docs, items, most=m).collect())) for m in (100, 2))
    assert one == many and len(one) == 18


def test_table(spark):
    docs = spark.createDataFrame([(1, PASSAGE, "c"), (1, PASSAGE, "c"), (2, None, "c"), (3, "", "c"), (None, PASSAGE, "c"), (4, PASSAGE * 2, "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("i", PASSAGE, "q"), ("i", PASSAGE, "q"), ("short", "one two", "q"), (None, PASSAGE, "q"), ("null", None, "q")], "item_id string, passage string, text string")
    assert sorted(map(tuple, find_leaks(docs, items).collect())) == [(1, "i"), (4, "i")]
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0
