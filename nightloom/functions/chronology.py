"""Clock texts as evidence, and the order in which a catalogue is played back."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nightloom.functions.dates import local_to_utc

# Parts of the day in minutes (start, end, middle).
PARTS = {
    "before_dawn": (210, 300, 255), "dawn": (300, 360, 330), "sunrise": (330, 390, 360), "early_morning": (360, 480, 420), "morning": (480, 660, 570), "late_morning": (630, 720, 675), "noon": (705, 735, 720),
    "early_afternoon": (720, 870, 795), "afternoon": (780, 1020, 900), "late_afternoon": (960, 1080, 1020), "sunset": (1050, 1110, 1080), "dusk": (1080, 1200, 1140), "evening": (1110, 1290, 1200),
    "late_evening": (1230, 1350, 1290), "night": (1260, 1439, 1350), "midnight": (1425, 15, 0), "after_midnight": (0, 180, 90),
}
# Words that name a part of the day; the first of the list that a text has wins.
PART_WORDS = (
    ("before dawn", "before_dawn"), ("shortly after midnight", "after_midnight"), ("after midnight", "after_midnight"), ("around noon", "noon"), ("early morning", "early_morning"), ("early am", "early_morning"), ("late morning", "late_morning"),
    ("early afternoon", "early_afternoon"), ("late afternoon", "late_afternoon"), ("late evening", "late_evening"), ("shortly after sunset", "dusk"), ("nightfall", "dusk"), ("twilight", "dusk"), ("sunrise", "sunrise"), ("sunset", "sunset"),
    ("dawn", "dawn"), ("dusk", "dusk"), ("morning", "morning"), ("afternoon", "afternoon"), ("daytime", "afternoon"), ("daylight", "afternoon"), ("evening", "evening"), ("night", "night"), ("noon", "noon"), ("midnight", "midnight"),
)
# Zone abbreviations in a clock text and their minutes from UTC.
OFFSETS = {
    "UTC": 0, "GMT": 0, "Z": 0, "ZULU": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "BST": 60, "JST": 540, "AEST": 600, "AEDT": 660,
}
# Rank of a confidence in the order of playback.
CONFIDENCE_RANK = {"high": 0, "medium": 1, "low": 2, "none": 3}

_ZONE = re.compile(rf"(?<![A-Z])(?:{'|'.join(sorted(OFFSETS, key=len, reverse=True))})(?![A-Z])", re.I)
_PARTS = [(re.compile(rf"\b{word}\b", re.I), part) for word, part in PART_WORDS]
_ABOUT = re.compile(r"^(?:~|about|around|approx(?:\.|imately)?|ca\.?|circa)\s+", re.I)
_RANGE = re.compile(r"(?:between|from)\s+(.+?)\s+(?:and|to)\s+(.+)", re.I)
_CLOCK = re.compile(r"\s*(\d{1,2})(?::(\d{2}))?\s*(?:([ap])\.?m\.?)?\s*", re.I | re.A)
_HOURS = re.compile(r"\s*(\d{1,2})(\d{2})\s*hours?\s*", re.I | re.A)
_SLIPS = ((re.compile(r"(?<=\d)[oO](?=\d)"), "0"), (re.compile(r"(?<=\d)[lI](?=\d)"), "1"), (re.compile(r"(?<=\d)\.(?=\d)"), ":"), (re.compile(r"\s+"), " "))

#: kind, confidence, part, minutes, start, end, offset
Evidence = tuple[str, str, str | None, int | None, int | None, int | None, int | None]


def clock(token: str, inherited: str | None = None) -> int | None:
    """Minutes of one clock (6, 6:15, 6:15 pm, 1815 hours, noon, 12 midnight), None for anything else; ``inherited``: a or p of the other end of a range."""
    if word := re.fullmatch(r"(?:12 +)?(noon|midnight)", token.strip(), re.I):
        return 720 if word[1].lower() == "noon" else 0
    if m := _CLOCK.fullmatch(token):
        hour, minute, half = int(m[1]), int(m[2] or 0), (m[3] or inherited or "").lower()
        if half:
            return (hour % 12 + 12 * (half == "p")) * 60 + minute if 1 <= hour <= 12 and minute < 60 else None
        return hour * 60 + minute if hour < 24 and minute < 60 else None
    if (m := _HOURS.fullmatch(token)) and int(m[1]) < 24 and int(m[2]) < 60:
        return int(m[1]) * 60 + int(m[2])
    return None


@lru_cache(maxsize=65536)
def read_clock(text: str | None) -> Evidence:
    """What a clock text tells; see ``clock_evidence``."""
    t = text or ""
    for slip, by in _SLIPS:
        t = slip.sub(by, t)
    t, offset = t.strip(), None
    if zone := _ZONE.search(t):
        offset = OFFSETS[zone[0].upper()]
        t = re.sub(r"\s+", " ", f"{t[: zone.start()]} {t[zone.end() :]}").strip()
    for pattern, part in _PARTS:
        if pattern.search(t):
            start, end, middle = PARTS[part]
            return (*(("approximate", "medium") if t.lower() == "around midnight" else ("bucketed", "low")), part, middle, start, end, offset)
    if m := _RANGE.fullmatch(t):
        half = re.search(r"\b([ap])\.?m\b", m[2], re.I) or re.search(r"(?<=\d)([ap])\.?m\b", m[2], re.I)
        first, last = clock(m[1], half and half[1]), clock(m[2])
        if first is not None and last is not None:
            return "approximate", "medium", None, (first + last + 1440 * (last < first)) // 2 % 1440, first, last, offset
    bare = re.sub(r"\?$", "", _ABOUT.sub("", t, count=1)).strip()
    at = clock(bare)
    if at is None:
        return "unknown", "none", None, None, None, None, offset
    if bare != t:
        return "approximate", "medium", None, at, max(0, at - 30), min(1439, at + 30), offset
    return "exact", "high", None, at, at, at, offset


def clock_evidence(text: Column) -> Column:
    """kind, confidence, part, minutes, start, end, offset that a clock text tells.

    kind: exact, approximate (about a clock, or between two), bucketed (a part of
    the day) or unknown; confidence high, medium, low, none in that order. minutes
    is the time or the middle, start and end its bounds; a range may run past
    midnight, and its first clock takes am or pm from the second. offset: minutes
    from UTC of a zone abbreviation. A null or empty text is unknown. In Python, a
    text once a worker: as an expression the grammar grows beyond what can be planned.
    """

    @F.pandas_udf("struct<kind:string,confidence:string,part:string,minutes:int,start:int,end:int,offset:int>")
    def run(col: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([read_clock(t) for t in col], columns=["kind", "confidence", "part", "minutes", "start", "end", "offset"])
        return rows.astype({c: "Int32" for c in ("minutes", "start", "end", "offset")})

    return run(text)


def utc_bounds(day: Column, start: Column, end: Column, zone: Column, offset: Column) -> Column:
    """start, end, mid in milliseconds UTC of a local span; an end before the start is of the next day. Null where a zone's clock does not fix both ends."""
    last = F.when(end < start, end + 1440).otherwise(end)
    local = lambda m: F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + m * 60)
    fixed = lambda m: F.unix_millis(local(m)) - offset * 60_000
    a, b = local_to_utc(local(start), zone), local_to_utc(local(last), zone)
    sure = (a["state"] == "exact") & (b["state"] == "exact")
    lo = F.when(offset.isNotNull(), fixed(start)).when(sure, F.unix_millis(a["utc"]))
    hi = F.when(offset.isNotNull(), fixed(last)).when(sure, F.unix_millis(b["utc"]))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("start"), hi.alias("end"), F.floor((lo + hi) / 2).alias("mid")))


def playback(day: Column, exact_day: Column, evidence: Column, zone: Column, zone_confidence: Column, event_id: Column) -> Column:
    """group, value, width, rank, id_kind, id_text, confidence, reason: the fields of the order of playback, to be compared in this order.

    group 1: an instant in UTC, by a written offset or a zone that is known well
    enough (high, medium); 2: local minutes only; 3: nothing but the id. A day that
    is not exact tells no time.
    """
    knows = F.coalesce(exact_day, F.lit(False)) & day.isNotNull() & evidence["minutes"].isNotNull()
    sure = evidence["offset"].isNotNull()
    at = F.when(knows & (sure | zone_confidence.isin("high", "medium")), utc_bounds(day, evidence["start"], evidence["end"], F.coalesce(zone, F.lit("UTC")), evidence["offset"]))
    kind = evidence["kind"]
    in_utc = F.when(kind == "exact", F.when(sure | (zone_confidence == "high"), "high").otherwise("medium")).when((kind == "approximate") & (sure | (zone_confidence != "low")), "medium").otherwise("low")
    confidence = F.when(at.isNotNull(), in_utc).when(knows, evidence["confidence"]).otherwise("none")
    reason = F.when(at.isNotNull(), F.concat(kind, F.lit("_time_with_"), F.when(sure, "explicit").otherwise("inferred"), F.lit("_timezone"))).when(knows, "local_time_only").otherwise("stable_fallback")
    around = evidence["end"] - evidence["start"]
    text = event_id.cast("string")
    return F.struct(
        F.when(at.isNotNull(), 1).when(knows, 2).otherwise(3).alias("group"), F.when(at.isNotNull(), at["mid"]).when(knows, evidence["minutes"].cast("long")).alias("value"),
        F.when(at.isNotNull(), at["end"] - at["start"]).when(knows, F.when(around < 0, around + 1440).otherwise(around).cast("long")).alias("width"),
        F.create_map(*[F.lit(x) for kv in CONFIDENCE_RANK.items() for x in kv])[confidence].alias("rank"), F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), 0).otherwise(1).alias("id_kind"), text.alias("id_text"), confidence.alias("confidence"), reason.alias("reason"),
    )
