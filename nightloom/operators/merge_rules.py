"""Merge-key families by strategy, text similarity and location candidates."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.text import normalize_key
from nightloom.operators.dedupe import HIGH, LOW, MEDIUM, fingerprint, group_confidence, key_groups
from nightloom.operators.evidence import group_keys

# Families by strategy with their confidence, and the parts of each key. "ss" is the source; date is the
# strong date, coord the position to three decimals, cell the 0.05 degree cell, both of trusted positions only.
AGGRESSIVE = {
    "exact_canonical_fingerprint": (HIGH, "fingerprint"), "same_source_native_id_any_date": (HIGH, "ss native"), "same_source_native_id_strong_date": (HIGH, "ss native date"),
    "strong_date_location_specific_time": (MEDIUM, "date place time"), "same_source_strong_date_location_specific_time": (HIGH, "ss date place time"), "strong_date_coordinate_specific_time": (MEDIUM, "date coord time"),
    "same_source_strong_date_coordinate_cell_specific_time": (HIGH, "ss date cell time"), "same_source_strong_date_location_type": (MEDIUM, "ss date place type"), "same_source_strong_date_location": (HIGH, "ss date place"),
    "same_source_strong_date_coordinate_type": (MEDIUM, "ss date coord type"), "same_source_strong_date_coordinate_cell": (HIGH, "ss date cell"),
}
MAXIMAL_1 = AGGRESSIVE | {
    "strong_date_location_type": (MEDIUM, "date place type"), "strong_date_coordinate_type": (MEDIUM, "date coord type"), "strong_date_location": (LOW, "date place"), "strong_date_coordinate_cell": (LOW, "date cell"),
}
_STRUCTURED = {
    "same_source_strong_date_structured_city_state_country": (HIGH, "ss date city state country"), "same_source_strong_date_structured_city_state": (HIGH, "ss date city state"),
    "strong_date_structured_city_state_country": (MEDIUM, "date city state country"), "strong_date_structured_city_state": (MEDIUM, "date city state"),
}
MAXIMAL_2 = MAXIMAL_1 | _STRUCTURED | {"same_source_strong_date_structured_city_country_type": (MEDIUM, "ss date city country kind"), "strong_date_structured_city_country_type": (MEDIUM, "date city country kind")}
MAXIMAL_3 = MAXIMAL_1 | _STRUCTURED
NO_CONFLICT = "strong_date_structured_city_country_no_state_conflict"
STRATEGIES = {"aggressive_v1": AGGRESSIVE, "maximal_v1": MAXIMAL_1, "maximal_v2": MAXIMAL_2, "maximal_v3": MAXIMAL_3}
# Fixed values, all as keys: positions that are trusted, native ids and types that name nothing, places that are none, and what stands for a token of a place.
TRUSTED = ("raw latlong", "source coordinates", "location coordinates")
GENERIC_IDS = ("none", "null", "unknown", "n a", "na", "000", "999")
GENERIC_TYPES = ("unknown", "other", "sighting", "ufo", "nuforc", "ufodna", "nicap", "brazilgov")
GENERIC_PLACES = ("unknown", "unresolved", "undisclosed", "undisclosed location")
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts",
    "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico",
    "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina",
    "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "us": "usa",
}
# Words of a report that tell nothing, and words that stand for others.
STOP_WORDS = "a about above after again all an and are as at be by for from had has have in into is it near of on or over reported report saw see seen sighting the to ufo was were with witness witnesses".split()
WORD_ALIASES = {"cylindrical": "cylinder", "cylinders": "cylinder", "hovered": "hover", "hovering": "hover", "lights": "light", "silently": "silent", "triangular": "triangle", "triangles": "triangle"}

_CLOCK = r"\b(?:(?:[01]?\d|2[0-3])(?::[0-5]\d){1,2}|(?:[01]?\d|2[0-3])[0-5]\d)\s*(?:[ap]\.?m\.?)?\b"
_HOUR = r"\b(?:[1-9]|1[0-2])\s*[ap]\.?m\b\.?"


def _mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def place_key(value: Column) -> Column:
    """Key of a place text with states and the United States written out alike; null for a text without letters and digits."""
    key = F.regexp_replace(normalize_key(value), r"\bunited states(?: of america)?\b", "usa")
    names = _mapped(STATES)
    return F.nullif(F.array_join(F.transform(F.split(key, " "), lambda t: F.coalesce(names[t], t)), " "), F.lit(""))


def time_key(value: Column) -> Column:
    """Key of a specific time of day in a text: noon, midnight, the first clock or hour with am or pm; null without one."""
    low = F.lower(F.coalesce(value, F.lit("")))
    clock, hour = F.regexp_extract(low, _CLOCK, 0), F.regexp_extract(low, _HOUR, 0)
    return F.when(F.contains(low, F.lit("noon")), "noon").when(F.contains(low, F.lit("midnight")), "midnight").otherwise(F.nullif(normalize_key(F.when(clock != "", clock).otherwise(hour)), F.lit("")))


def report_tokens(*texts: Column) -> Column:
    """Telling words of a report's texts in order: aliases and word ends undone, stop words and single letters left out."""
    aliases, fixed = _mapped(WORD_ALIASES), sorted(set(WORD_ALIASES.values()))

    def stem(word: Column) -> Column:
        w = F.coalesce(aliases[word], word)
        n = F.length(w)
        cut_by = F.when(w.isin(*fixed), 0).when((n > 5) & F.endswith(w, F.lit("ing")), 3).when((n > 4) & (F.endswith(w, F.lit("ed")) | F.endswith(w, F.lit("ly"))), 2).when((n > 3) & F.endswith(w, F.lit("s")), 1).otherwise(0)
        return F.substring(w, F.lit(1), n - cut_by)

    words = F.split(normalize_key(F.concat_ws(" ", *texts)), " ")
    return F.filter(F.transform(words, stem), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def key_parts(records: DataFrame) -> DataFrame:
    """id and the parts of merge keys, null where a record has none.

    ``records``: id, source, native_id, day, date_precision, time_raw, location, lat,
    lon, coordinate_source, type, city, state, country, description. ``kind`` is the
    type unless it is a generic one. Generic cities and countries stand in the
    per-record keys; only the keys over whole blocks leave them out.
    """
    some = lambda c: F.nullif(normalize_key(c), F.lit(""))
    native, kind = normalize_key(F.col("native_id")), some(F.col("type"))
    trusted = normalize_key(F.col("coordinate_source")).isin(*TRUSTED) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    whole = F.concat_ws(", ", *[F.when(F.trim(c) != "", F.trim(c)) for c in ("city", "state", "country")])
    return records.select(
        "id", some(F.col("source")).alias("ss"), F.when((F.length(native) >= 3) & ~native.isin(*GENERIC_IDS), native).alias("native"),
        F.when(F.lower("date_precision").isin("day", "exact_day"), F.col("day").cast("string")).alias("date"), time_key(F.col("time_raw")).alias("time"),
        place_key(F.coalesce(F.when(F.trim("location") != "", F.col("location")), whole)).alias("place"),
        F.when(trusted, F.concat_ws(",", F.bround("lat", 3).cast("string"), F.bround("lon", 3).cast("string"))).alias("coord"),
        # truncation towards zero, not floor
        F.when(trusted, F.concat_ws(",", (F.col("lat") / 0.05).cast("int").cast("string"), (F.col("lon") / 0.05).cast("int").cast("string"))).alias("cell"),
        kind.alias("type"), F.when(~kind.isin(*GENERIC_TYPES), kind).alias("kind"), *[place_key(F.col(c)).alias(c) for c in ("city", "state", "country")],
        fingerprint(F.col("day").cast("string"), F.col("time_raw"), F.col("location"), F.col("description")).alias("fingerprint"),
    )


def family_keys(strategy: str) -> dict[str, Column]:
    """Key of each family over the columns of ``key_parts``; null where a part is missing."""
    def key(parts: str) -> Column:
        names = parts.split()
        whole = F.lit(True)
        for n in names:
            whole = whole & F.col(n).isNotNull()
        return F.when(whole, F.concat_ws("|", *names))

    return {name: key(parts) for name, (_, parts) in STRATEGIES[strategy].items()}


def merge_records(records: DataFrame, strategy: str) -> DataFrame:
    """id, root, families, confidence of records merged by any key of a strategy, directly or through others."""
    parts = key_parts(records)
    keys, of = family_keys(strategy), {n: c for n, (c, _) in STRATEGIES[strategy].items()}
    if strategy == "maximal_v3":
        known = lambda c: ~F.coalesce(F.col(c), F.lit("unknown")).isin(*GENERIC_PLACES)
        block = parts.where(F.col("date").isNotNull() & known("city") & known("country")).withColumn("state", F.when(known("state"), F.col("state")))
        fine = group_keys(block, ["date", "city", "country"], "state", F.concat_ws("|", "date", "city", "country"))
        parts = parts.join(fine.withColumnRenamed("key", "_free"), "id", "left")
        keys, of = keys | {NO_CONFLICT: F.col("_free")}, of | {NO_CONFLICT: LOW}
    found = key_groups(parts, keys)
    everyone = found.groupBy("root").agg(F.array_distinct(F.flatten(F.collect_set("families"))).alias("_all"))
    return found.join(everyone, "root").select("id", "root", "families", group_confidence(F.col("_all"), of).alias("confidence"))


def text_similarity(a: Column, b: Column) -> Column:
    """The greater of the cosine of token sets and the ratio of matching blocks, 0 for an empty side."""
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str | None, q: str | None) -> float:
            s, t = set((p or "").split()), set((q or "").split())
            if not s or not t:
                return 0.0
            cosine = len(s & t) / (len(s) * len(t)) ** 0.5
            return max(cosine, difflib.SequenceMatcher(None, p, q, autojunk=False).ratio())

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)])

    return score(a, b)


def near_duplicate_score(similarity: Column, shared_id: Column) -> Column:
    """0.72 + 0.28 signal; kept from 0.82 on, with a text of 0.62 or a shared id."""
    signal = F.greatest(similarity, F.when(shared_id, 0.72).otherwise(0.0))
    score = F.round(0.72 + 0.28 * signal, 3)
    return F.when(((similarity >= 0.62) | shared_id) & (score >= 0.82), score)


def location_candidates(text: Column) -> Column:
    """Queries to try for a typed location, most specific first: as it stands, without brackets, without its street, its last parts."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\(\[].*?[\)\]]", " "), r"\s+", " "))
    no_lead = F.regexp_replace(bare, r"(?i)^(?:near|just outside|outskirts of|in/around|approx\.?\s*\d+\s*km \w+ of|\d+ mi \w+ of)\s+", "")
    parts = F.split(no_lead, r"\s*[,;/]\s*")
    tail = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 10), ", "))
    return F.array_distinct(F.filter(F.array(text, bare, no_lead, F.element_at(parts, 1), tail), lambda x: F.length(F.trim(x)) > 0))


def text_precision(text: Column, multiple: Column) -> Column:
    """Precision that a location text can have: multi_location, approximate, city, region, country or unknown."""
    low = F.lower(F.trim(text))
    return (
        F.when(multiple, "multi_location").when(low.rlike(r"\b(?:near|outside|outskirts|around|vicinity|approx|mi [nsew]|km (?:north|south|east|west))"), "approximate")
        .when(F.size(F.split(low, r"[,;/]")) >= 2, "city").when(F.length(low) <= 3, "region").when(low != "", "place").otherwise("unknown")
    )


def time_token_class(text: Column) -> Column:
    """exact, fuzzy (about a time or a part of the day), ambiguous (an hour that needs am or pm) or none of a clock text."""
    low = F.lower(F.trim(text))
    return (
        F.when(low.rlike(r"^(?:at )?(?:[01]?\d|2[0-3])[:h.][0-5]\d(?:[:.]\d+)*\s*(?:[ap]\.?m\.?)?$|^(?:[01]\d|2[0-3])[0-5]\d(?: hrs)?$|^\d{1,2}\s*[ap]\.?m\.?$"), "exact")
        .when(low.rlike(r"^(?:approx|about|around|circa|~)|dawn|dusk|night|evening|morning|noon|afternoon"), "fuzzy").when(low.rlike(r"^\d{1,2}(?:\s*o'?clock)?$"), "ambiguous").otherwise("none")
    )


def read_dump(lines: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows of one table's INSERT statements in an SQL dump (column ``value``), as texts."""
    name = re.escape(table)
    rows = lines.where(F.col("value").rlike(rf"(?i)^insert into `?{name}`?")).select(F.explode(F.regexp_extract_all("value", F.lit(r"\(((?:'(?:[^'\\]|\\.|'')*'|[^'()])*)\)\s*[,;]"), 1)).alias("row"))
    cells = rows.select(F.regexp_extract_all("row", F.lit(r"(?:^|,)\s*('(?:[^'\\]|\\.|'')*'|[^,]*)"), 1).alias("c"))
    plain = lambda x: F.when(F.lower(x) != "null", F.regexp_replace(F.regexp_replace(x, r"^'|'$", ""), r"''|\\'", "'"))
    return cells.select(*[plain(F.try_element_at("c", F.lit(i + 1))).alias(c) for i, c in enumerate(columns)])


def column_accounting(records: DataFrame, file: str, columns: list[str]) -> DataFrame:
    """file, column, rows, filled: non-blank values by file and column, in one pass."""
    long = records.select(file, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias("there")) for c in columns])).alias("x")).select(file, "x.*")
    return long.groupBy(file, "column").agg(F.count("*").alias("rows"), F.count_if("there").alias("filled"))


def qualified_cells(cells: DataFrame, row: str, column: str, effect: str, most: int = 12) -> DataFrame:
    """Cells of the ``most`` rows and columns of the greatest effect; ties in label order."""
    def top(by: str) -> DataFrame:
        return cells.groupBy(by).agg(F.max(F.abs(effect)).alias("_e")).orderBy(F.desc("_e"), by).limit(most).select(by)

    return cells.join(F.broadcast(top(row)), row, "left_semi").join(F.broadcast(top(column)), column, "left_semi")
