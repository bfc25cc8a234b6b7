"""Abusive, hateful and sexual language, by a convolutional text classifier.

Hashed word embeddings, filters of several widths and max pooling, trained in
numpy on a bounded sample of rated documents. Ratings are of documents while
abuse is a matter of sentences, so training is by multiple instances: of a
document rated so, its worst sentence counts; of a clean one, every sentence.
A document's score is its worst sentence's, and thresholds are calibrated by
language on ratings held out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.llm.markup import plain

#: Rated documents the classifier is fitted on, at most; half of them may be rated abusive. The bound of the training sample.
SAMPLE = 6000
#: Rows of the embedding table and its width, filter widths, filters of each.
BUCKETS, WIDTH = 1 << 15, 20
FILTERS, COUNT = (1, 2, 3, 4), 24
#: Words of an instance; longer sentences are cut into overlapping ones.
WORDS, OVERLAP = 48, 8

# Letters of other scripts that look Latin, and signs that stand for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏьвкмнтαορνικτυεηАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbbkmhtaopviktuenABEKMHOPCTYXIJSABEZHIKMNOPTYX")
LEET = str.maketrans("013457$@!|€8", "oieastsaileb")

_SENTENCE = re.compile(r"[.!?。！？؟…][\"'»”’)]*\s+|[。！？]|[\r\n]+|\s[•|]\s")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_PIECE = re.compile(r"[^\W_][\w$@!|€*']*[\w$@|€*]|[^\W_]|\$[\w$@]+")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
_CJK = re.compile("[぀-ヿ㐀-鿿가-힯]")


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text without markup and hidden characters."""
    text = plain(text, "\n")
    return [s for s in _SENTENCE.split(text if text.isascii() else unicodedata.normalize("NFKC", text)) if s and not s.isspace()]


@lru_cache(maxsize=1 << 17)
def _tokens(w: str) -> tuple[str, ...]:
    """Tokens of one lower-cased piece of a sentence."""
    if w.isdigit():
        return ("0",)
    if not w.isascii() and _CJK.search(w):
        return tuple(w[i : i + 2] for i in range(max(1, len(w) - 1)))
    if "*" in w.strip("*"):
        w = w.strip("*")
        return "*masked*", f"{w[0]}*{w[-1]}"
    if not w.isalpha():
        letters = sum(c.isalpha() for c in w)
        if letters * 2 > len(w) and w.strip("'").replace("'", "").isalpha() is False:
            w = w.translate(LEET)
        w = "".join(c for c in w if c.isalnum())
    return (_REPEAT.sub(r"\1", w),) if w else ()


@lru_cache(maxsize=1 << 17)
def _hashes(w: str) -> tuple[int, ...]:
    return tuple(1 + zlib.crc32(t.encode("utf-8", "replace")) % (BUCKETS - 1) for t in _tokens(w))


@lru_cache(maxsize=1 << 17)
def _chunk(w: str) -> tuple[tuple[int, ...], int]:
    """Hashed words of a run without white space, and how many letters it has that stand alone or may."""
    pieces = _PIECE.findall(w)
    return tuple(h for p in pieces for h in _hashes(p)), sum(len(p) == 1 for p in pieces) if "*" not in w and "_" not in w else 4


def _latin(sentence: str) -> str:
    """A lower-cased sentence without accents, letters that look Latin made so where most are."""
    if not sentence.isascii():
        latin = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in sentence)
        if latin * 2 > sum(c.isalpha() for c in sentence):
            sentence = sentence.translate(LOOKALIKES)
        sentence = "".join(c for c in unicodedata.normalize("NFKD", sentence) if not unicodedata.combining(c))
    return sentence.lower()


def _closed(sentence: str) -> str:
    return _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), sentence)


def tokens(sentence: str) -> list[str]:
    """Words of a sentence with disguises undone."""
    return [t for w in _PIECE.findall(_closed(_latin(sentence))) for t in _tokens(w)]


def parts(sentence: str) -> list[tuple[int, ...]]:
    """Hashed ``tokens`` of a sentence, overlapping parts of a longer one."""
    sentence = _latin(sentence)
    chunks = [_chunk(w) for w in sentence.split()]
    if sum(n for _, n in chunks) >= 4:  # else no word can be spelled letter by letter
        chunks = [_chunk(w) for w in _closed(sentence).split()]
    ids = [h for hashes, _ in chunks for h in hashes]
    return [tuple(part) for k in range(0, max(1, len(ids) - OVERLAP), WORDS - OVERLAP) if (part := ids[k : k + WORDS])]


def instances(text: str) -> list[tuple[int, ...]]:
    """Parts of all sentences of a text."""
    return [part for s in sentences(text) for part in parts(s)]


def _row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.add.reduceat(values[order], starts, axis=0)


class TextCNN:
    """Embeddings, convolutions of several widths, max over time, one logistic output."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32)
        self.e[0] = 0
        self.w = [rng.normal(0, (2 / (k * WIDTH)) ** 0.5, (k * WIDTH, COUNT)).astype(np.float32) for k in FILTERS]
        self.b = [np.zeros(COUNT, np.float32) for _ in FILTERS]
        self.out = rng.normal(0, 0.1, COUNT * len(FILTERS)).astype(np.float32)
        # not trained: a sentence of which no filter knows anything scores 0.02, whatever the share of bad ones in training
        self.bias = np.float32(-4)

    @staticmethod
    def pad(batch: list[tuple[int, ...]]) -> np.ndarray:
        length = max(max(map(len, batch)), max(FILTERS))
        x = np.zeros((len(batch), length), np.int64)
        for i, ids in enumerate(batch):
            x[i, : len(ids)] = ids
        return x

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Scores before the logistic, pooled features, where each maximum lies, and what the filters saw."""
        seen = self.e[x]
        pooled, where, wides = [], [], []
        for k, w, b in zip(FILTERS, self.w, self.b, strict=True):
            steps = x.shape[1] - k + 1
            wide = np.concatenate([seen[:, i : i + steps] for i in range(k)], axis=2)
            act = wide @ w + b
            at = act.argmax(axis=1)
            where.append(at)
            wides.append(wide)
            pooled.append(np.maximum(np.take_along_axis(act, at[:, None], axis=1)[:, 0], 0))
        features = np.concatenate(pooled, axis=1)
        return features @ self.out + self.bias, features, where, wides

    def scores(self, batch: list[tuple[int, ...]]) -> np.ndarray:
        """Probabilities, computed in batches of similar length from the words' projections, so that no product is taken twice for a word."""
        out = np.zeros(len(batch), np.float32)
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            x = self.pad([batch[i] for i in part])
            known, x = np.unique(x, return_inverse=True)
            x = x.reshape(len(part), -1)
            seen, z = self.e[known], np.full(len(part), self.bias, np.float32)
            for n, (size, w, b) in enumerate(zip(FILTERS, self.w, self.b, strict=True)):
                steps = x.shape[1] - size + 1
                act = (seen @ w[:WIDTH])[x[:, :steps]]
                for i in range(1, size):
                    act += (seen @ w[i * WIDTH : (i + 1) * WIDTH])[x[:, i : i + steps]]
                z += np.maximum(act.max(axis=1) + b, 0) @ self.out[n * COUNT : (n + 1) * COUNT]
            out[part] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out

    def step(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One Adagrad step on the weighted logistic loss; gradients run through the maxima only."""
        z, features, where, wides = self.forward(x)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        d_features = d[:, None] * self.out[None] * (features > 0)
        self._apply("out", self.out, features.T @ d + 1e-4 * self.out, rate)
        d_words = np.zeros((*x.shape, WIDTH), np.float32)
        for n, (k, w) in enumerate(zip(FILTERS, self.w, strict=True)):
            steps = x.shape[1] - k + 1
            g = d_features[:, n * COUNT : (n + 1) * COUNT]
            d_act = np.zeros((len(x), steps, COUNT), np.float32)
            np.put_along_axis(d_act, where[n][:, None], g[:, None], axis=1)
            back = d_act @ w.T
            for i in range(k):
                d_words[:, i : i + steps] += back[:, :, i * WIDTH : (i + 1) * WIDTH]
            gw = wides[n].reshape(-1, k * WIDTH).T @ d_act.reshape(-1, COUNT)
            self._apply(f"w{n}", w, gw + 1e-4 * w, rate)
            self._apply(f"b{n}", self.b[n], g.sum(axis=0), rate)
        rows, grad = _row_sums(x.ravel(), d_words.reshape(-1, WIDTH))
        state = self.__dict__.setdefault("_e2", np.full((BUCKETS, 1), 1e-8, np.float32))
        state[rows] += (grad**2).mean(axis=1, keepdims=True)
        self.e[rows] -= rate * grad / np.sqrt(state[rows])
        self.e[0] = 0

    def _apply(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float) -> None:
        state = self.__dict__.setdefault(f"_s_{name}", np.full_like(value, 1e-8))
        state += grad**2
        value -= rate * grad / np.sqrt(state)

    def slim(self) -> TextCNN:
        """Without the optimiser's state."""
        for k in [k for k in self.__dict__ if k.startswith("_")]:
            delattr(self, k)
        return self


def fit(bags: list[list[tuple[int, ...]]], rated: np.ndarray, rounds: int = 14, seed: int = 7) -> TextCNN:
    """A classifier from bags of instances and whether each bag was rated abusive."""
    model, rng = TextCNN(seed), np.random.default_rng(seed)
    known: dict[tuple[int, ...], int] = {}
    members = [[known.setdefault(i, len(known)) for i in bag] for bag in bags]
    every = list(known)
    bad = [np.array(m) for m, y in zip(members, rated, strict=True) if y and m]
    clean = np.zeros(len(every), np.int64)
    foul = np.zeros(len(every), np.int64)
    for m, y in zip(members, rated, strict=True):
        (foul if y else clean)[list(set(m))] += 1
    innocent = (clean > 0) & (foul <= 2 * clean)
    negative = np.flatnonzero(innocent)
    if not len(every) or not bad:
        return model.slim()
    # before any training, an instance that clean documents hold as well is an unlikely culprit
    likely = np.where(clean > 0, 0.05, 0.5) * (foul / (foul + 5.0 * clean + 1))
    for r in range(rounds):
        if r >= 2:
            likely = model.scores(every) * np.where(innocent, 0.1, 1.0)
        # worst instance of every bad bag; a bag in which nothing stands out is a doubtful rating and weighs less or nothing
        worst = np.array([m[np.argmax(likely[m])] for m in bad])
        trust = np.clip((likely[worst] - 0.1) * 2, 0, 1) if r >= 4 else np.ones(len(worst))
        trust[innocent[worst]] = 0  # nothing else in the bag: what clean documents hold as often is no case
        hard = negative[np.argsort(-likely[negative])[: 2 * len(bad)]] if r >= 2 else negative[:0]
        easy = rng.choice(negative, min(len(negative), 6 * len(bad) + 500), replace=False) if len(negative) else negative
        index = np.concatenate([worst, hard, easy])
        y = np.concatenate([np.ones(len(worst)), np.zeros(len(hard) + len(easy))])
        weight = np.concatenate([trust * 3, 1 + np.log1p(clean[np.concatenate([hard, easy])])])
        order = rng.permutation(len(index))
        order = np.concatenate([b[np.argsort([len(every[index[i]]) for i in b], kind="stable")] for b in np.array_split(order, max(1, len(order) // 2048))])
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            model.step(model.pad([every[index[i]] for i in part]), y[part], weight[part], 0.05 if r < rounds // 2 else 0.02)
    return model.slim()


def language(lang: str | None) -> str:
    """Two-letter code of a language label; '' for anything else."""
    code = re.split(r"[-_]", (lang or "").strip().lower())[0]
    return code if len(code) == 2 and code.isalpha() else ""


def calibrate(scores: np.ndarray, rated: np.ndarray, langs: list[str], cases: int = 10, within: tuple[float, float] = (0.2, 0.65)) -> dict[str, float]:
    """The threshold of best F1 overall ('all') and, where a language has ``cases`` cases or more, for it.

    Between the scores next to the best cut the middle is taken, kept ``within`` bounds,
    since few cases leave it open.
    """

    def best(s: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-s)
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
        k = int(np.argmax(f1))
        after = s[order[k + 1]] if k + 1 < len(s) else 0.0
        return float(np.clip((s[order[k]] + after) / 2, *within))

    whole = best(scores, rated) if rated.any() else 0.5
    out = {"all": whole}
    for code in sorted(set(langs)):
        own = np.array([x == code for x in langs])
        if code and rated[own].sum() >= cases:
            out[code] = best(scores[own], rated[own])
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[TextCNN, dict[str, float]]:
    """Classifier and thresholds from a sample of at most ``sample`` rated documents, taken by hash of doc_id.

    Documents rated both clean and otherwise are left out; thresholds come from
    the scores that each half gets from a model of the other.
    """
    rating = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min(F.lower("label") != "clean").alias("least"), F.max(F.lower("label") != "clean").alias("bad")).where("least = bad")
    rated = docs.where("text is not null").select("doc_id", "text", "lang").join(rating.select("doc_id", "bad"), "doc_id")
    ordered = rated.withColumn("at", F.xxhash64("doc_id"))
    rows = [r for bad in (True, False) for r in ordered.where(F.col("bad") == bad).orderBy("at", "doc_id", "text").limit(sample // 2 if bad else sample).collect()]
    rows = rows[:sample]
    rows.sort(key=lambda r: (r["at"], r["doc_id"], r["text"]))
    bags = [instances(r["text"]) for r in rows]
    y = np.array([r["bad"] for r in rows], bool)
    if y.sum() < 2 or y.all():
        return TextCNN().slim(), {"all": 1.1}
    model, scores, kept = fit_cleaned(bags, y)
    return model, calibrate(scores[kept], y[kept], [language(r["lang"]) for r, k in zip(rows, kept, strict=True) if k])


def fit_cleaned(bags: list[list[tuple[int, ...]]], rated: np.ndarray, doubtful: float = 0.04, least: int = 200) -> tuple[TextCNN, np.ndarray, np.ndarray]:
    """The classifier, every bag's score by a model fitted without it, and which bags were kept.

    Each half of the bags is scored by a model of the other half. Bags rated
    abusive that score under ``doubtful`` there are wrong ratings more likely than
    not and left out of the last fit, once ``least`` of them are there to learn from.
    """
    even = np.arange(len(bags)) % 2 == 0
    scores = np.zeros(len(bags), np.float32)
    for side in (even, ~even):
        half = fit([b for b, s in zip(bags, side, strict=True) if s], rated[side])
        known = {i: 0.0 for b, s in zip(bags, side, strict=True) if not s for i in b}
        keys = list(known)
        known.update(zip(keys, half.scores(keys).tolist(), strict=True))
        for k in np.flatnonzero(~side):
            scores[k] = max((known[i] for i in bags[k]), default=0.0)
    kept = ~(rated & (scores < doubtful)) if rated.sum() >= least else np.ones(len(bags), bool)
    return fit([b for b, k in zip(bags, kept, strict=True) if k], rated[kept]), scores, kept


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, source, score, flagged: the worst sentence's score of every document.

    ``docs``: doc_id, text, lang, source; ``labels``: doc_id, label. Null, empty
    and blank texts score 0; every sentence of a text counts, however long it is;
    repeated rows come out repeated, empty tables empty. Without ratings of both
    kinds nothing is flagged. The model goes to every worker; nothing is shuffled.
    """
    model, cuts = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast((model, cuts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cuts = shared.value
        memo: dict[str, float] = {}
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                bags = [sentences(t) if t else [] for t in part["text"]]
                if len(memo) > 200_000:
                    memo.clear()
                fresh = {s: parts(s) for bag in bags for s in bag if s not in memo}
                pieces = list({p for ps in fresh.values() for p in ps})
                known = dict(zip(pieces, model.scores(pieces).tolist(), strict=True))
                memo.update((s, max((known[p] for p in ps), default=0.0)) for s, ps in fresh.items())
                score = np.array([max((memo[s] for s in bag), default=0.0) for bag in bags])
                limit = np.array([cuts.get(language(x), cuts["all"]) for x in part["lang"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), "score": score, "flagged": score >= limit})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang", "source").mapInPandas(run, f"doc_id {kind}, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """source, documents, flagged, rate, mean_score: null sources count as one of their own."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))
