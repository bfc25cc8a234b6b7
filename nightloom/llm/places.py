"""Freely typed places mapped to a reference list.

Each distinct token is repaired against the reference vocabulary by edit
distance (a join on deletion neighbourhoods, verified exactly), and soft TF-IDF
over the repaired tokens ranks complete entries. Every distinct text is worked
once, however many records carry it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions.unknown import says_something
from nightloom.session import BROADCAST_ROWS, bounded_rows, cut, small

#: Entries the reference list may have; it goes to every worker.
REFERENCE_ROWS = 50_000
#: Share of an entry name's weight that repaired tokens must cover.
NAME_SHARE = 0.85

# Abbreviations of name words.
SHORT = {
    "st": "saint", "snt": "saint", "ste": "saint", "pt": "port", "prt": "port", "ft": "fort", "frt": "fort", "mt": "mount", "mnt": "mount", "mtn": "mount",
    "lk": "lake", "no": "north", "nth": "north", "n": "north", "so": "south", "sth": "south", "s": "south", "e": "east", "w": "west",
}

# Further names of countries and states.
ALIASES = {
    "usa": "us usa america unitedstates unitedstatesofamerica estadosunidos etatsunis",
    "canada": "ca can",
    "united kingdom": "uk gb gbr greatbritain britain unitedkingdom",
    "australia": "au aus",
    "new zealand": "nz nzl aotearoa",
    "norway": "no nor norge",
    "germany": "de deu ger deutschland brd",
    "spain": "es esp espana e",
    "france": "fr fra",
    "japan": "jp jpn nippon nihon 日本",
    "india": "in ind bharat",
    "colombia": "co col columbia",
    "fiji": "fj fji fijiislands viti",
    "pennsylvania": "penna penn",
    "niedersachsen": "nds lowersaxony",
    "bayern": "bavaria",
    "bretagne": "brittany",
    "andalucia": "andalusia",
    "quebec": "pq",
    "alberta": "alta",
}

_MOJIBAKE = re.compile("[Ãã]([\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])|Â(?=[\u0080-¿])")
_TOKEN = re.compile(r"[^\W_]+")
#: Words about a position beside the place, which name no region.
_BESIDE = re.compile(r"^\W*in/around\b|\b\d+(?:\.\d+)?\s*(?:mi|miles?|km|kilomet(?:re|er)s?)\.?\s+(?:[a-z]+\s+)?of\b|-\s*(?:north|south|east|west)\s+side\b|&\s*vicinity\b")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}")


def _unmangle(m: re.Match) -> str:
    try:
        return (b"\xc3" + m[1].encode("cp1252" if ord(m[1]) > 255 else "latin-1")).decode("utf-8") if m[1] else ""
    except UnicodeError:
        return m[0]


def fold(text: str) -> str:
    """Entities and mangled bytes undone, accents and case dropped."""
    if text.isascii() and "&" not in text:
        return text.lower()
    text = _MOJIBAKE.sub(_unmangle, html.unescape(text))
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c) and c != "­").lower()


def name_tokens(text: str) -> list[str]:
    """Tokens of a folded text, name words written out."""
    return [SHORT.get(t, t) for t in _TOKEN.findall(text.replace("'", ""))]


def edits(a: str, b: str, most: int) -> int:
    """Edits between two tokens, a swap of neighbours counting once; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, older[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        older, last = last, row
    return last[-1]


def reach(token: str) -> int:
    """Edits a token may differ by."""
    return 0 if len(token) < 4 else 1 if len(token) < 6 else 2


def deletions(token: str, most: int) -> set[str]:
    """The token with up to ``most`` letters left out."""
    n = len(token)
    return {"".join(c for i, c in enumerate(token) if i not in gone) for k in range(most + 1) for gone in combinations(range(n), k)}


class Reference:
    """The reference list with its token weights and region names."""

    def __init__(self, rows: list) -> None:
        self.entries: list[tuple[str, list[list[str]], str, str]] = []
        for r in rows:
            names = [name_tokens(fold(n)) for n in [r["city"], *(r["alt_names"] or [])] if n and n.strip()]
            names = [n for n in names if n]
            country, state = fold(r["country"] or "").strip(), fold(r["state_province"] or "").strip()
            if names and r["place_id"] is not None:
                self.entries.append((str(r["place_id"]), names, f"{state}|{country}", country))
        n = len(self.entries) or 1
        df = Counter(t for _, names, _, _ in self.entries for t in {t for name in names for t in name})
        df_state, df_country = Counter(e[2] for e in self.entries), Counter(e[3] for e in self.entries)
        self.idf = {t: math.log(1 + n / k) for t, k in df.items()}
        self.idf_region = {f"s:{s}": math.log(1 + n / k) for s, k in df_state.items()} | {f"c:{c}": math.log(1 + n / k) for c, k in df_country.items()}
        #: token that stands for a name: its weightiest
        self.by_key: dict[str, list[tuple[int, list[str]]]] = {}
        for i, (_, names, _, _) in enumerate(self.entries):
            for name in names:
                key = max(name, key=lambda t: (self.idf[t], len(t), t))
                self.by_key.setdefault(key, []).append((i, name))
        self.regions: dict[str, set[str]] = {}
        #: words of state names by their first letter
        self.spelled: dict[str, list[tuple[list[str], str]]] = {}
        for country in {e[3] for e in self.entries if e[3]}:
            for alias in [country.replace(" ", ""), *ALIASES.get(country, "").split()]:
                self.regions.setdefault(alias, set()).add(f"c:{country}")
        for r in rows:
            country, state = fold(r["country"] or "").strip(), fold(r["state_province"] or "").strip()
            if not state:
                continue
            label = f"s:{state}|{country}"
            for alias in [state.replace(" ", ""), fold(r["state_code"] or "").strip(), *ALIASES.get(state, "").split()]:
                if alias:
                    self.regions.setdefault(alias, set()).add(label)
            known = self.spelled.setdefault(state[0], [])
            if (state.split(), label) not in known:
                known.append((state.split(), label))
        #: words of region names, to which typed ones are repaired
        self.region_words = {w for e in self.entries for w in (*e[2].split("|")[0].split(), *e[3].split())}
        self._seen: dict[str, frozenset[str]] = {}

    def region(self, text: str) -> frozenset[str]:
        """Regions that a squeezed text names or abbreviates."""
        got = self._seen.get(text)
        if got is None:
            found = set(self.regions.get(text, ()))
            if not found and len(text) >= 2:
                for words, label in self.spelled.get(text[0], ()):
                    if len(text) <= sum(map(len, words)) and _abbreviates(text, words):
                        found.add(label)
            if len(self._seen) > 200_000:
                self._seen.clear()
            got = self._seen[text] = frozenset(found)
        return got

    def regions_in(self, texts: list[str], repaired: dict[str, str]) -> set[str]:
        """Regions named in folded texts, longest runs of tokens first; a token that stands for none is read as its repaired word."""
        out: set[str] = set()
        for text in texts:
            tokens = _TOKEN.findall(_DOTTED.sub(lambda m: m[0].replace(".", "") + " ", text))
            tokens = [t if t not in repaired or self.region(t) else repaired[t] for t in tokens]
            i = 0
            while i < len(tokens):
                for k in range(min(4, len(tokens) - i), 0, -1):
                    run = "".join(tokens[i : i + k])
                    found = self.region(run) if k > 1 or len(run) > 1 or run in self.regions else frozenset()
                    if found:
                        out |= found
                        i += k - 1
                        break
                i += 1
        return out

    def hints(self, location: str, state: str, country: str, repaired: dict[str, str]) -> Counter:
        """How many of the three folded texts name each region; a column's own kind of region goes before the other."""
        out = Counter(self.regions_in([_BESIDE.sub(" ", location)], repaired))
        for text, kind in ((state, "s:"), (country, "c:")):
            found = self.regions_in([text], repaired)
            out.update([x for x in found if x.startswith(kind)] or found)
        return out

    def rank(self, tokens: list[str], repaired: dict[str, tuple[str, float]], regions: Counter) -> tuple[str | None, float]:
        """The best entry by soft TF-IDF, None where no name is covered or two stay level."""
        have: dict[str, float] = {}
        for t in tokens:
            word, like = (t, 1.0) if t in self.idf else repaired.get(t, ("", 0.0))
            if like:
                have[word] = max(have.get(word, 0.0), like)
        best: dict[int, float] = {}
        for key in have:
            for i, name in self.by_key.get(key, ()):
                whole = sum(self.idf[t] ** 2 for t in name)
                score = sum(self.idf[t] ** 2 * have.get(t, 0.0) for t in name) / whole
                if score >= NAME_SHARE * min(1.0, max(have[key], 0.8)):
                    _, _, state, country = self.entries[i]
                    near = self.idf_region[f"s:{state}"] * regions[f"s:{state}"] + self.idf_region[f"c:{country}"] * regions[f"c:{country}"]
                    best[i] = max(best.get(i, 0.0), score * whole + near)
        if not best:
            return None, 0.0
        top = max(best.values())
        first = [i for i, v in best.items() if v >= top - 1e-9]
        return (self.entries[first[0]][0], top) if len(first) == 1 else (None, top)


def _abbreviates(text: str, words: list[str]) -> bool:
    """Whether ``text`` is made of a beginning of every word, two letters or more of a single one."""
    if not words:
        return not text
    if len(words) == 1:
        return len(text) >= 2 and words[0].startswith(text)
    return any(text.startswith(words[0][:k]) and _abbreviates(text[k:], words[1:]) for k in range(1, min(len(words[0]), len(text)) + 1))


def repair_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, kind, word, likeness: the nearest vocabulary word (``vocabulary``: word, kind) of each token, of every kind.

    An equi-join on deletion neighbourhoods proposes the pairs, the exact edit
    distance decides; ties go to the alphabetically first. Tokens under four letters
    have no edits to give, and tokens beyond 40 are no typed names; both stay as
    they are. Tokens are dealt to all tasks before their neighbourhoods are made.
    """

    @F.pandas_udf("array<string>")
    def gone(col: pd.Series) -> pd.Series:
        return col.map(lambda t: sorted(deletions(t, reach(t))))

    @F.pandas_udf("int")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="int32")

    fit = "length(token) between 4 and 40"
    tasks = max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), tokens.sparkSession.sparkContext.defaultParallelism)
    left = tokens.where(fit).repartition(tasks, "token").select("token", F.explode(gone("token")).alias("gap"))
    right = vocabulary.where("length(word) between 4 and 40").select("word", "kind", F.explode(gone("word")).alias("gap"))
    pairs = left.join(small(right, 10 * BROADCAST_ROWS), "gap").select("token", "word", "kind").distinct()
    # a filter on what Python tells would else be moved before the tokens are dealt out, to where they may lie in one task
    near = pairs.repartition(tasks, "token").withColumn("far", apart.asNondeterministic()("token", "word")).where(F.col("far") <= F.when(F.least(F.length("token"), F.length("word")) < 6, 1).otherwise(2))
    return near.groupBy("token", "kind").agg(F.min(F.struct("far", "word")).alias("best")).select("token", "kind", "best.word", (1.0 - F.col("best.far") / F.length("token")).alias("likeness"))


def map_places(records: DataFrame, places: DataFrame) -> DataFrame:
    """canonical_input_id, place_id: one row per distinct record whose location_raw says something.

    ``records``: canonical_input_id, location_raw, state_province, country;
    ``places``: place_id, city, state_code, state_province, country, alt_names.
    place_id is a string, 'none' where no entry is named (or two stay level, as a
    city of two states without either). Repeated deliveries count once (least
    values where they differ), null ids are left out, extra columns are ignored;
    an empty reference maps everything to 'none', an empty record table to nothing.

    Records are reduced to their distinct (location, state, country) texts before
    any work; a hot place is one text.
    """
    spark = records.sparkSession
    listed = bounded_rows(places.select("place_id", "city", "state_code", "state_province", "country", "alt_names"), REFERENCE_ROWS)
    reference = Reference(listed)
    shared = spark.sparkContext.broadcast(reference)

    blank = F.lit("")
    sep = "\u0001"
    text = F.concat_ws(sep, F.col("location_raw"), F.coalesce("state_province", blank), F.coalesce("country", blank)).alias("text")
    rec = records.where(F.col("canonical_input_id").isNotNull() & says_something(F.col("location_raw"))).select("canonical_input_id", text)
    rec = rec.groupBy("canonical_input_id").agg(F.min("text").alias("text"))
    texts = rec.select("text").distinct()

    @F.pandas_udf("array<string>")
    def tokenise(col: pd.Series) -> pd.Series:
        return col.map(lambda t: sorted({x for k, part in enumerate(t.split(sep)) for x in (name_tokens if k == 0 else _TOKEN.findall)(fold(part))}))

    # both are read more than once: the texts' tokens by repair and ranking, the repairs by their count and the join
    tokens = cut(texts.select("text", tokenise("text").alias("tokens")))
    vocabulary = spark.createDataFrame([(w, "name") for w in sorted(reference.idf)] + [(w, "region") for w in sorted(reference.region_words)], "word string, kind string")
    repaired = cut(repair_tokens(tokens.select(F.explode("tokens").alias("token")).distinct(), vocabulary))
    fixes = (
        tokens.select("text", F.explode("tokens").alias("token"))
        .join(small(repaired, BROADCAST_ROWS), "token")
        .groupBy("text")
        .agg(F.collect_list(F.struct("token", "kind", "word", "likeness")).alias("fixes"))
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = shared.value
        for b in batches:
            out = []
            for t, fixed in zip(b["text"], b["fixes"], strict=True):
                parts = [fold(p) for p in t.split(sep)]
                words = {v["token"]: (v["word"], v["likeness"]) for v in (fixed if fixed is not None else ()) if v["kind"] == "name"}
                regions = {v["token"]: v["word"] for v in (fixed if fixed is not None else ()) if v["kind"] == "region"}
                place, _ = ref.rank(name_tokens(parts[0]), words, ref.hints(*parts, regions))
                out.append(place or "none")
            yield pd.DataFrame({"text": b["text"].to_numpy(), "place_id": pd.Series(out, dtype=object)})

    found = tokens.select("text").join(fixes, "text", "left").mapInPandas(decide, "text string, place_id string")
    return rec.join(found, "text").select("canonical_input_id", "place_id")
