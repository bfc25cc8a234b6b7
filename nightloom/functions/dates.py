"""Historical date expressions and clock texts."""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nightloom.operators.instants import MONTHS

# Months of a season; winter begins in December and ends in February of the next year.
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}

_APPROX = re.compile(r"^(?:about|approx(?:\.|imately)?|around|circa|ca?\.|~)\s*|[?~]+$")
_PART = re.compile(r"^(early|mid|middle|late)[\s-]+(?:in\s+|of\s+)?")


def _month_end(year: int, month: int) -> dt.date:
    return dt.date(year, month, calendar.monthrange(year, month)[1])


def _thirds(start: dt.date, end: dt.date, part: str) -> tuple[dt.date, dt.date]:
    """The early, middle or late third of an interval by its days."""
    days = (end - start).days + 1
    third = days // 3
    a = {"early": 0, "mid": third, "middle": third, "late": days - third}[part]
    b = {"early": third, "mid": days - third, "middle": days - third, "late": days}[part]
    return start + dt.timedelta(a), start + dt.timedelta(max(a, b - 1))


def parse_expression(text: str | None, century: int = 1900) -> tuple[dt.date, dt.date, str] | None:
    """(first day, last day, precision) of a date expression, month before day; None if it is none.

    Precisions: exact_day, month, year, decade, season, range, approximate. Tried in
    this order: range, approximate mark, part of an interval, season, month name,
    m/d/y, m/y, decade, year.
    """
    t = re.sub(r"\s+", " ", (text or "").strip().lower())
    if not t:
        return None
    try:
        if m := re.fullmatch(r"(\d{1,2}/\d{1,2}/\d{2,4})\s*-\s*(\d{1,2}/\d{1,2}/\d{2,4})", t):
            a, b = parse_expression(m[1], century), parse_expression(m[2], century)
            return (a[0], b[1], "range") if a and b and a[0] <= b[1] else None
        bare = _APPROX.sub("", t).strip()
        if bare != t:
            inner = parse_expression(bare, century)
            return (inner[0], inner[1], "approximate") if inner else None
        if m := _PART.match(t):
            inner = parse_expression(t[m.end() :], century)
            return (*_thirds(inner[0], inner[1], m[1]), inner[2]) if inner and inner[2] != "exact_day" else None
        if (m := re.fullmatch(r"(?:in )?(?:the )?(spring|summer|autumn|fall|winter)(?: of)?,? (\d{4})", t)) and int(m[2]) < 9999:
            year, first = int(m[2]), SEASONS[m[1]]
            last = _month_end(year + (first == 12), 2 if first == 12 else first + 2)
            return dt.date(year, first, 1), last, "season"
        if m := re.fullmatch(r"([^\W\d_]{3,12})\.?,? (\d{4})", t):
            month = MONTHS.get(m[1][:4]) or MONTHS.get(m[1][:3])
            return (dt.date(int(m[2]), month, 1), _month_end(int(m[2]), month), "month") if month else None
        if m := re.fullmatch(r"(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})", t):
            day = dt.date(int(m[3]) + (century if len(m[3]) == 2 else 0), int(m[1]), int(m[2]))
            return day, day, "exact_day"
        if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", t):
            day = dt.date(int(m[1]), int(m[2]), int(m[3]))
            return day, day, "exact_day"
        if m := re.fullmatch(r"(\d{1,2})/(\d{4})", t) or re.fullmatch(r"(?P<y>\d{4})-(\d{2})", t):
            year, month = (int(m["y"]), int(m[2])) if "y" in m.groupdict() else (int(m[2]), int(m[1]))
            return dt.date(year, month, 1), _month_end(year, month), "month"
        if m := re.fullmatch(r"(\d{3})0'?s", t):
            year = int(m[1]) * 10
            return dt.date(year, 1, 1), dt.date(year + 9, 12, 31), "decade"
        if m := re.fullmatch(r"\d{4}", t):
            return dt.date(int(t), 1, 1), dt.date(int(t), 12, 31), "year"
    except ValueError:
        return None
    return None


_DATE_TYPE = "struct<start:date,end:date,sort:date,precision:string>"


def date_expression(value: Column) -> Column:
    """start, end, sort (the middle day, rounded down) and precision of date texts; null where none is read."""

    @F.pandas_udf(_DATE_TYPE)
    def parse(col: pd.Series) -> pd.DataFrame:
        known = {t: parse_expression(t) for t in col.dropna().unique()}
        rows = [known.get(t) for t in col]
        return pd.DataFrame(
            {
                "start": [r and r[0] for r in rows], "end": [r and r[1] for r in rows],
                "sort": [r and r[0] + dt.timedelta((r[1] - r[0]).days // 2) for r in rows], "precision": [r and r[2] for r in rows],
            }
        )

    out = parse(value)
    return F.when(out["start"].isNotNull(), out)


# Minutes of the day (start, end, middle) of words for parts of the day; the first that occurs wins.
BUCKETS = {
    "before dawn": (210, 300, 255), "after midnight": (0, 180, 90), "early morning": (360, 480, 420), "late morning": (630, 720, 675), "early afternoon": (720, 870, 795),
    "late afternoon": (960, 1080, 1020), "late evening": (1230, 1350, 1290), "dawn": (300, 360, 330), "sunrise": (330, 390, 360), "morning": (480, 660, 570), "noon": (705, 735, 720),
    "afternoon": (780, 1020, 900), "sunset": (1050, 1110, 1080), "dusk": (1080, 1200, 1140), "evening": (1110, 1290, 1200), "midnight": (1425, 15, 0), "night": (1260, 1439, 1350),
}


def clock_bucket(value: Column) -> Column:
    """(start, end, mid) minutes of the first part of the day that a text names, else null."""
    low = F.lower(value)
    out = F.lit(None).cast("struct<start:int,end:int,mid:int>")
    for word, (start, end, mid) in reversed(BUCKETS.items()):
        out = F.when(F.contains(low, F.lit(word)), F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(mid).alias("mid"))).otherwise(out)
    return out


def clock_minutes(value: Column) -> Column:
    """Minutes of the day of a plain clock text (18:15, 1815, 6:15 pm, 18h15), null for anything else."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"^(?:at|approx\.?|about)\s+|\s*(?:hrs|hours)$", "")
    at = lambda p, i: F.regexp_extract(low, p, i)
    colon, plain, half = r"^(\d{1,2})[:h](\d{2})(?::\d{2}(?:\.\d+)?)?$", r"^(\d{2})(\d{2})$", r"^(\d{1,2})(?:[:.](\d{2}))?\s*([ap])\.?m\.?$"
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    h, m = F.coalesce(number(at(colon, 1)), number(at(plain, 1))), F.coalesce(number(at(colon, 2)), number(at(plain, 2)))
    h12, m12 = number(at(half, 1)), F.coalesce(number(at(half, 2)), F.lit(0))
    day = F.when((h <= 23) & (m <= 59), h * 60 + m)
    return F.coalesce(day, F.when(h12.between(1, 12) & (m12 <= 59), (h12 % 12 + F.when(at(half, 3) == "p", 12).otherwise(0)) * 60 + m12))


def local_to_utc(ts: Column, zone: Column) -> Column:
    """(utc, state) of a local time: state is exact, or ambiguous or missing where clocks change, found by converting there and back."""
    utc = F.to_utc_timestamp(ts, zone)
    back = F.from_utc_timestamp(utc, zone)
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, zone) == ts) | (F.from_utc_timestamp(utc - hour, zone) == ts)
    return F.struct(utc.alias("utc"), F.when(back != ts, "missing").when(twice, "ambiguous").otherwise("exact").alias("state"))


def python_ordinal(day: Column) -> Column:
    """Days counted from 0001-01-01 as 1."""
    return F.unix_date(day) + 719163


def decimal_coordinates(value: Column) -> Column:
    """(lat, lon) of the first decimal pair in a text, or of degrees with hemispheres; null if there is none in range."""
    pair = r"(-?\d{1,2}\.\d+)\s*[,; ]\s*(-?\d{1,3}\.\d+)"
    hemi = r"(\d{1,2}(?:\.\d+)?)\s*°?\s*([NS])[,;\s]+(\d{1,3}(?:\.\d+)?)\s*°?\s*([EW])"
    number = lambda p, i: F.nullif(F.regexp_extract(value, p, i), F.lit("")).cast("double")
    sign = lambda i, minus: F.when(F.regexp_extract(value, hemi, i) == minus, -1.0).otherwise(1.0)
    lat = F.coalesce(number(hemi, 1) * sign(2, "S"), number(pair, 1))
    lon = F.coalesce(number(hemi, 3) * sign(4, "W"), number(pair, 2))
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))
