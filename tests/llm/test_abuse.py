"""The classifier on held-out documents and its disguises."""

from __future__ import annotations

import random

import numpy as np
import pytest

from nightloom.llm.abuse import calibrate, fit_cleaned, instances, rates, score_documents, sentences, tokens

FOUL = ["nobody asked you, {0}", "such a {0} should rot in a ditch", "keep typing {0} it only proves you are a {0}", "the moderator is a {0}"]
WORDS = ["scumbag", "idiot", "halfwit", "bastard", "moron"]
CLEAN = ["a copper beam swept the {0}", "the {0} was closed and nobody asked for the key", "the moderator is away until {0}", "the map of the {0} was redrawn", "keep typing the {0} report"]
THINGS = ["rail yard", "orchard", "harbour", "toll bridge", "monday", "tannery", "paper mill"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bad = rng.random() < 0.25
        s = [rng.choice(CLEAN).format(rng.choice(THINGS)) for _ in range(rng.randint(1, 8))]
        if bad:
            s.insert(rng.randrange(len(s) + 1), rng.choice(FOUL).format(rng.choice(WORDS)))
        out.append((i, ". ".join(s) + ".", bad))
    return out


def test_held_out():
    train, test = corpus(600, 1), corpus(400, 2)
    y = np.array([b for _, _, b in train])
    noisy = y.copy()
    noisy[::40] ^= True
    model, scores, kept = fit_cleaned([instances(t) for _, t, _ in train], noisy, least=50)
    cut = calibrate(scores[kept], noisy[kept], ["en"] * int(kept.sum()))["all"]
    got = np.array([max(model.scores(instances(t))) >= cut for _, t, _ in test])
    assert (got == np.array([b for _, _, b in test])).mean() > 0.97


@pytest.mark.parametrize("text", ["s c u m b a g", "scum​bag", "ѕсumbаg", "SCUMBAG", "sssscumbag", "5cumb4g", "$cumbag"])
def test_disguises(text):
    assert "scumbag" in [t for s in sentences("you " + text) for t in tokens(s)]


def test_tokens():
    assert tokens("i******e at 12:30") == ["*masked*", "i*e", "at", "0", "0"] and tokens("") == [] and tokens("日本語") == ["日本", "本語"]


def test_table(spark):
    rows = [(i, t, "en", f"s{i % 3}", "c") for i, t, _ in corpus(300, 3)] + [(1000, None, None, None, "c"), (1001, "", "de", "s0", "c"), (1002, "you scumbag idiot " * 20000, "xx", "s1", "c"), (1003, " \n ", "en", "s0", "c"), (0, "again", "en", "s0", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([(i, "abusive" if b else "clean", "r") for i, _, b in corpus(300, 3)] + [(5, "clean", "r"), (5, "sexual", "r"), (None, "clean", "r"), (7, None, "r"), (99999, "hateful", "r")], "doc_id long, label string, flagged string")
    got = score_documents(docs, labels).cache()
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] >= 1000}
    assert got.count() == len(rows) and by[1002]["flagged"] and not any(by[i]["flagged"] for i in (1000, 1001, 1003)) and by[1000]["score"] == 0
    r = rates(got)
    assert r.agg({"documents": "sum"}).first()[0] == len(rows) and r.where("source is null").count() == 1
    assert score_documents(docs.limit(0), labels).count() == 0
    assert score_documents(docs, labels.limit(0)).where("flagged").count() == 0
