"""Dates of old chronicles: intervals from vague texts, years cut short, a year 0, alternate and end dates."""

from __future__ import annotations

import datetime as dt
import re
from calendar import monthrange
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nightloom.functions.dates import SEASONS

#: Years by which dates are shifted to be counted, so that a year 0 has days; the calendar repeats after so many.
SHIFT = 400
# English month names, full or by three letters.
NAMES = "january february march april may june july august september october november december".split()
# Words that make a date approximate without moving it.
ABOUT = ("around", "circa", "ca.", "c.", "approx.", "approx", "approximately")


class Span(NamedTuple):
    """First and last day by number, and the precision."""

    first: int
    last: int
    precision: str


def number(year: int, month: int, day: int) -> int:
    """A day's number; a day beyond its month is the month's last."""
    return dt.date(year + SHIFT, month, min(day, monthrange(year + SHIFT, month)[1])).toordinal()


def iso(day: int) -> str:
    d = dt.date.fromordinal(day)
    return f"{d.year - SHIFT:04d}-{d.month:02d}-{d.day:02d}"


def whole_year(token: str, heading: str, file: str) -> int:
    """The year of a token: of one or two digits by the heading it stands under, else by the years in its file's name."""
    year = int(token)
    if len(token) > 2:
        return year
    digits = re.sub(r"\D", "", heading)
    if digits and (len(digits) == len(token) or int(digits) % 10 ** len(token) == year):
        return int(digits)
    name = file.lower().replace(" ", "_")
    if any(f"19{d}0_19{d}9" in name for d in (5, 6, 7)) or ("1980_present" in name and year >= 80):
        return 1900 + year
    return 2000 + year if "1980_present" in name else year


def _months(year: int, first: int, last: int, precision: str) -> Span:
    """From a month's first day to a month's last, counted on over the year's end."""
    end_year, end_month = year + (last - 1) // 12, (last - 1) % 12 + 1
    return Span(number(year, first, 1), number(end_year, end_month, 31), precision)


def _third(span: Span, which: str) -> Span:
    """The early, mid or late third of a span; spans of two days or less stay whole."""
    days = span.last - span.first + 1
    if which in ABOUT or days <= 2:
        return span._replace(precision="approximate")
    third = max(days // 3, 1)
    first = {"early": span.first, "mid": span.first + third, "late": span.last - third + 1}[which]
    return Span(first, first + third - 1, "approximate")


@lru_cache(maxsize=65536)
def read(text: str | None, heading: str = "", file: str = "") -> Span | None:
    """The span that a text means, None if it means none."""
    marked = re.sub(r"\s+", " ", (text or "").strip())
    t = re.sub("[?~]", "", marked).strip().lower()
    vague = t != marked.lower()
    of = lambda token: whole_year(token, heading, file)
    plain = lambda span: span._replace(precision="approximate") if vague else span
    try:
        if "/" in t and (m := re.fullmatch(r"(.+?)\s*(?:-|to)\s*(.+)", t)):
            a, b = read(m[1], heading, file), read(m[2], heading, file)
            if a and b:
                return Span(a.first, b.last, "range")
        if m := re.fullmatch(r"(?:(early|mid|late) )?(spring|summer|autumn|fall|winter)(?: (\d{1,4}))?", t):
            part, season, year = m[1], m[2], m[3] or heading
            if not year:
                return None
            span = _months(of(year), SEASONS[season], SEASONS[season] + 2, "approximate")
            return _third(span, part) if part else span
        if m := re.fullmatch(rf"(early|mid|late|{'|'.join(map(re.escape, ABOUT))}) (.+)", t):
            inner = read(m[2], heading, file)
            return inner and _third(inner, m[1])
        if (m := re.fullmatch(r"([a-z]+) (?:(\d{1,2}), ?)?(\d{1,4})", t)) and (at := [i for i, n in enumerate(NAMES, 1) if m[1] in (n, n[:3])]):
            year = of(m[3])
            return plain(Span(day := number(year, at[0], int(m[2])), day, "exact_day") if m[2] else _months(year, at[0], at[0], "month"))
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{1,4})", t):
            day = number(of(m[3]), int(m[1]), int(m[2]))
            return plain(Span(day, day, "exact_day"))
        if m := re.fullmatch(r"(\d{1,2})/(\d{1,4})", t):
            return plain(_months(of(m[2]), int(m[1]), int(m[1]), "month"))
        if m := re.fullmatch(r"(\d{1,4}0)s|(\d{1,4})'s", t):
            year = of(m[1] or m[2])
            return plain(_months(year - year % 10, 1, 120, "decade"))
        if m := re.fullmatch(r"\d{1,4}", t):
            return plain(_months(of(t), 1, 12, "year"))
        if t in ("early", "mid", "late") and heading:
            return _third(_months(of(heading), 1, 12, "year"), t)
    except ValueError:  # no such month or day, or a year out of range
        return None
    return None


def resolve(date: str | None, end: str | None, alternate: str | None, heading: str | None, file: str | None) -> tuple[str, str | None, str, str] | None:
    """(date, end date if another, middle day, precision) in ISO form of an event's date texts.

    The alternate stands in for a date that cannot be read; an end makes a range of
    what there is, or stands alone.
    """
    around = (heading or "", file or "")
    span = read(date, *around) or read(alternate, *around)
    if last := read(end, *around):
        span = Span(span.first if span else last.first, last.last, "range")
    if not span:
        return None
    return iso(span.first), iso(span.last) if span.last != span.first else None, iso(span.first + (span.last - span.first) // 2), span.precision


_KIND = "struct<date_iso:string,end_date_iso:string,sort_date_iso:string,date_precision:string>"


def historical_date(date: Column, end: Column, alternate: Column, heading: Column, file: Column) -> Column:
    """``resolve`` of five text columns; null where nothing is read. Years outside 0 to 9999 are texts all the same."""

    @F.pandas_udf(_KIND)
    def run(*texts: pd.Series) -> pd.DataFrame:
        rows = [resolve(*(None if x is None or x != x else x for x in row)) or (None,) * 4 for row in zip(*texts, strict=True)]
        return pd.DataFrame(rows, columns=["date_iso", "end_date_iso", "sort_date_iso", "date_precision"])

    out = run(date, end, alternate, heading, file)
    return F.when(out["date_iso"].isNotNull(), out)
