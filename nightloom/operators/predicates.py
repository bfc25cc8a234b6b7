"""Filters of the catalogue as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.geo import haversine_km

# Precisions that count as low.
LOW_PRECISION = ("country", "state", "province", "state_province", "region", "county", "approximate", "multi_location", "unknown")

FACETS = ("source", "type", "precision")


def every(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def some(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


@dataclass(frozen=True)
class Filters:
    """A request: selections by facet (empty: all), facets that reject all, and the rest."""

    selected: dict[str, tuple[str, ...]] = field(default_factory=dict)
    reject: tuple[str, ...] = ()
    hide_low_precision: bool = False
    exact_day_only: bool = False
    legend: tuple[str, ...] = ()
    start: str | None = None
    end: str | None = None
    include_undated: bool = False

    def selection(self, facet: str) -> Column:
        """The facet's own condition."""
        if facet in self.reject:
            return F.lit(False)
        chosen = self.selected.get(facet, ())
        return F.coalesce(F.col(facet).isin(*chosen), F.lit(False)) if chosen else F.lit(True)

    def base(self) -> Column:
        """What holds for every facet: rejections, precision and dates, without selections and legend."""
        tests = [F.lit(False)] if self.reject else []
        if self.hide_low_precision:
            tests.append(~F.coalesce(F.lower("precision").isin(*LOW_PRECISION), F.lit(False)))
        if self.exact_day_only:
            tests.append(F.coalesce(F.col("date_precision").isin("day", "exact_day"), F.lit(False)))
        if self.start and self.end:
            tests.append(overlaps(self.start, self.end, include_undated=self.include_undated))
        return every(tests)

    def whole(self) -> Column:
        return every([self.base(), *[self.selection(f) for f in FACETS]]) & self.in_legend()

    def in_legend(self) -> Column:
        return F.col("legend").isin(*self.legend) if self.legend else F.lit(True)


def overlaps(start: str, end: str, first: str = "date_start", last: str = "date_end", sort: str = "day", include_undated: bool = False) -> Column:
    """Closed-interval overlap; a missing end falls back to the sort date, undated rows fail unless asked for."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    test = (F.coalesce(F.col(last), F.col(sort)) >= low) & (F.coalesce(F.col(first), F.col(sort)) <= high)
    return F.coalesce(test, F.lit(include_undated))


def in_rectangle(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box, which may reach over the date line (west beyond east)."""
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce(lat.between(south, north) & across, F.lit(False))


def in_circle(lat: Column, lon: Column, at: tuple[float, float], km: float) -> Column:
    """Within a great-circle distance."""
    return F.coalesce(haversine_km(lat, lon, F.lit(at[0]), F.lit(at[1])) <= km, F.lit(False))


def in_any(shapes: list[Column] | None) -> Column:
    """Inside any shape: no list accepts all, an empty one nothing."""
    return F.lit(True) if shapes is None else some(shapes)


def has_any_bit(mask: Column, bits: int) -> Column:
    """Whether a mask has any of the bits; null masks fail."""
    return F.coalesce(mask.bitwiseAND(F.lit(bits)) != 0, F.lit(False))


def evidence_state(ready: Column, excluded: Column, value: Column) -> Column:
    """supported, unknown, not_loaded or excluded; missing evidence is a state of its own."""
    return F.when(~F.coalesce(ready, F.lit(False)), "not_loaded").when(F.coalesce(excluded, F.lit(False)), "excluded").when(value.isNull(), "unknown").otherwise("supported")


def first_failing(**reasons: Column) -> Column:
    """The first reason, in the order given, whose condition does not hold; 'eligible' where all hold."""
    out = F.lit("eligible")
    for name, holds in reversed(list(reasons.items())):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def boundary_date(text: str, side: str) -> str | None:
    """First or last day of a partial date (YYYY, YYYY-MM, YYYY-MM-DD); None if it is none."""
    import calendar
    import re

    m = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", text.strip())
    if not m or (m[2] and not 1 <= int(m[2]) <= 12):
        return None
    year, month = int(m[1]), int(m[2] or (1 if side == "start" else 12))
    last = calendar.monthrange(year, month)[1]
    day = int(m[3] or (1 if side == "start" else last))
    return f"{year:04d}-{month:02d}-{day:02d}" if 1 <= day <= last else None


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows with the total count beside each; at most 100 rows, as the feature asks."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(min(limit, 100)).crossJoin(F.broadcast(total))
