"""Mixed timestamp formats and zones to one UTC instant.

Every value gets all its valid interpretations: both orders of a numeric date,
both instants of a local time that occurs twice. A Viterbi pass over each source
file's record order keeps one per record, penalising a contradiction of the
source's registered order, format switches and backward time jumps. Long files
are worked in blocks; a block is summed up by the least cost between its ends, so
that the choice is the same wherever a border falls.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.functions.unknown import UNKNOWN_MARKERS
from nightloom.session import cut, small

# Month names of the four languages, by their first letters.
MONTHS = {
    "jan": 1, "ene": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "abr": 4,
    "may": 5, "mai": 5, "jun": 6, "juin": 6, "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "ago": 8,
    "sep": 9, "set": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "déc": 12, "dez": 12, "dic": 12,
}

# Zone abbreviations and their offsets from UTC in minutes.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "zulu": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "ist": 330, "cet": 60, "cest": 120, "met": 60, "mest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "cot": -300, "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "fjt": 720,
}

_MONTH = r"(?P<mon>[^\W\d_]{3,12})\.?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_YEAR = r"(?P<y>\d{4})"
#: Date forms: name, pattern. Numeric day-month forms are read by both orders.
_DATES = [
    ("ymd", re.compile(r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})")),
    ("ymd/", re.compile(r"(?P<y>\d{4})([/.])(?P<m>\d{1,2})\2(?P<d>\d{1,2})")),
    ("ymd8", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})")),
    ("num", re.compile(r"(?P<a>\d{1,2})([/.-])(?P<b>\d{1,2})\2(?P<y>\d{4}|\d{2})")),
    ("dMy", re.compile(_WEEKDAY + r"(?P<d>\d{1,2})(?:st|nd|rd|th)?\.?(?:\s+|-)(?:of\s+|de\s+)?" + _MONTH + r"(?:\s+|-|,\s*)(?:de[l]?\s+)?" + _YEAR)),
    ("Mdy", re.compile(_WEEKDAY + _MONTH + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+" + _YEAR)),
]
_ABOUT = re.compile(r"^(?:at|about|approx(?:\.|imately)?|around|circa|ca?\.?|roughly|nearly|near|just after|just before|~)\s*(?=\d|noon)")
_ZONE = r"\s*\(?(?P<zone>(?:utc|gmt)\s*[+-]\s*\d{1,2}(?::?\d{2})?|[+-]\d{2}(?::?\d{2})?|[a-z]{1,5})?\)?"
_TIME = re.compile(
    r"(?:(?P<h>\d{1,2})(?::(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,]\d+)?)?|h(?P<mh>\d{2})|\.(?P<md>\d{2})(?=\s*[ap]\.?m))|(?P<h4>\d{2})(?P<m4>\d{2})(?P<s4>\d{2})?|(?P<ho>\d{1,2})(?=\s*[ap]\.?m)|(?P<noon>noon|midday))"
    r"(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?(?:\s*(?:hrs|hours|hr|h|uhr)\b\.?)?" + _ZONE + r"\s*(?:local(?: time)?|approx\.?|or so)?"
)
_EPOCH = re.compile(r"-?\d{9,10}|-?\d{11,13}")
_SPLIT = re.compile(r"(?<=\d)t(?=\d)|\s*\\n\s*|\s*,?\s+at\s+|\s*,\s+|\s+")
_OFFSET = re.compile(r"(?:utc|gmt)?\s*([+-])\s*(\d{1,2}):?(\d{2})?")


def offset_minutes(token: str) -> int | None:
    """Minutes east of UTC of a zone token, None if unknown."""
    if token in ZONES:
        return ZONES[token]
    m = _OFFSET.fullmatch(token)
    if not m or int(m[2]) > 14 or int(m[3] or 0) > 59:
        return None
    return (-1 if m[1] == "-" else 1) * (int(m[2]) * 60 + int(m[3] or 0))


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name.strip()) if name and "/" in name or name == "UTC" else None
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


@lru_cache(maxsize=65536)
def parse_time(text: str) -> tuple[int, str | None] | None:
    """Seconds of the day and zone token of a lower-cased time of day; None if it states none."""
    t = _ABOUT.sub("", text.strip(), count=1)
    m = _TIME.fullmatch(t)
    if not m:
        return None
    if m["noon"]:
        return 43200, m["zone"]
    hour = int(m["h"] or m["h4"] or m["ho"])
    minute = int(m["mi"] or m["mh"] or m["md"] or m["m4"] or 0)
    second = int(m["s"] or m["s4"] or 0)
    if m["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if m["ap"] == "p" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    return hour * 3600 + minute * 60 + second, m["zone"]


def _dates(text: str, two_digit_from: int) -> list[tuple[str, dt.date]]:
    """All valid readings of a lower-cased date, as (format, date)."""
    out = []
    for name, pattern in _DATES:
        m = pattern.fullmatch(text)
        if not m:
            continue
        g = m.groupdict()
        year = int(g["y"])
        if len(g["y"]) == 2:
            year += two_digit_from // 100 * 100
            year += 100 * (year < two_digit_from)
        if "a" in g:
            tries = [("mdy", int(g["a"]), int(g["b"])), ("dmy", int(g["b"]), int(g["a"]))]
        elif "mon" in g:
            month = MONTHS.get(g["mon"][:4]) or MONTHS.get(g["mon"][:3])
            tries = [(name, month, int(g["d"]))] if month else []
        else:
            tries = [(name, int(g["m"]), int(g["d"]))]
        for label, month, day in tries:
            try:
                out.append((label, dt.date(year, month, day)))
            except ValueError:
                pass
    return out


def _instants(day: dt.date, second: int, minutes: int | None, zone: zoneinfo.ZoneInfo | None) -> list[int]:
    """The instants a local time may be, the first of two first; a skipped time is moved on by the gap."""
    local = (day.toordinal() - 719163) * 86400 + second
    if minutes is not None:
        return [local - minutes * 60]
    if zone is None:
        return []
    naive = dt.datetime(day.year, day.month, day.day, second // 3600, second // 60 % 60, second % 60, tzinfo=zone)
    first, later = (local - int(naive.replace(fold=k).utcoffset().total_seconds()) for k in (0, 1))
    # in a gap the later offset gives the lesser instant: there is only the one moved on
    return [first, later] if later > first else [first]


class Reading(NamedTuple):
    """order: mdy or dmy of a numeric date, '' of any other; fold: 1 for the second of two equal local times."""

    order: str
    form: str
    fold: int
    at: int


def interpretations(date_raw: str | None, time_raw: str | None, zone_name: str | None, two_digit_from: int | None) -> list[Reading]:
    """All valid readings of a record's date and time.

    A reading needs a full, possible date and time of day and a zone: one written
    with either goes before ``zone_name``; an unknown written zone gives none. Ten
    digits or fewer are epoch seconds, more are milliseconds.
    """
    text = (date_raw or "").strip().lower()
    if text in UNKNOWN_MARKERS:
        return []
    if _EPOCH.fullmatch(text):
        return [Reading("", "epoch", 0, int(text) if len(text.lstrip("-")) <= 10 else int(text) // 1000)]
    clock = (time_raw or "").strip().lower()
    clock = "" if clock in UNKNOWN_MARKERS else clock
    zone, found, base = _zone(zone_name), [], two_digit_from if two_digit_from is not None else 1950
    parts = [("", text, clock)] if clock else []
    for m in _SPLIT.finditer(text):
        parts.append(("+", text[: m.start()].rstrip(","), text[m.end() :]))
    for mark, date_text, time_text in parts:
        read = parse_time(time_text)
        if read is None:
            continue
        for label, day in _dates(date_text, base):
            minutes = None
            if read[1]:
                minutes = offset_minutes(read[1])
                if minutes is None:
                    continue
            order = label if label in ("mdy", "dmy") else ""
            found += [Reading(order, label + mark, fold, at) for fold, at in enumerate(_instants(day, read[0], minutes, zone))]
    # a date that reads the same either way is one reading
    one: dict[tuple[int, int], Reading] = {}
    for r in sorted(set(found)):
        if r.order and (r.fold, r.at) in one:
            r = r._replace(order="")
        one[r.fold, r.at] = r
    return sorted(one.values())


@dataclass(frozen=True)
class Costs:
    """What a choice costs, in whole numbers, so that sums are exact. The first two outweigh all that a record's neighbours can add, so that a registered order and the first of two equal local times hold."""

    #: a numeric date read against the source's registered order, and leaving a record out because every reading is
    contradiction: int = 80
    none: int = 60
    #: the second of two equal local times
    second: int = 40
    #: another day-month order than the record before
    switch: int = 10
    #: an instant before that of the record before
    backward: int = 3


class State(NamedTuple):
    """A reading (None: none holds) with the day-month order in force after it, and what it costs by itself."""

    order: str
    at: int | None
    cost: int
    reading: Reading | None


def states(readings: list[Reading], registered: str | None, costs: Costs) -> list[State]:
    """The states of a record; readings without an order of their own keep either in force."""
    known = registered if registered in ("mdy", "dmy") else ""
    out = []
    for r in readings:
        cost = costs.second * r.fold + (costs.contradiction if known and r.order and r.order != known else 0)
        out += [State(o, r.at, cost, r) for o in ([r.order] if r.order else ["dmy", "mdy"])]
    if readings and known and all(r.order and r.order != known for r in readings):
        out += [State(o, None, costs.none, None) for o in ("dmy", "mdy")]
    return out


def _step(a: State, b: State, costs: Costs) -> int:
    """Cost of going from one record's state to the next one's, without what they cost by themselves."""
    return (costs.switch if a.order != b.order else 0) + (costs.backward if a.at is not None and b.at is not None and b.at < a.at else 0)


def _steps(before: list[State], now: list[State], costs: Costs) -> np.ndarray:
    """Costs of every transition, own costs of the later states included."""
    return np.array([[_step(a, b, costs) + b.cost for b in now] for a in before], float)


class Chain:
    """Viterbi over the records of one chain as they come, kept no longer than paths differ.

    ``entry`` and ``leave`` fix the state of the first and the last record. Ties keep the earlier state.
    """

    #: records after which what all paths have in common is settled
    SETTLE = 512

    def __init__(self, costs: Costs, entry: int | None = None, leave: int | None = None) -> None:
        self.costs, self.entry, self.leave = costs, entry, leave
        self.held: list[tuple[str | None, list[State]]] = []
        self.back: list[list[int]] = []
        self.cost: list[float] | None = None

    def add(self, key: str, options: list[State]) -> list[tuple[str, State]]:
        """Takes the next record; returns the records that are settled by it."""
        if self.cost is None:
            self.cost = [s.cost if self.entry is None or k == self.entry else float("inf") for k, s in enumerate(options)]
        else:
            before, cost, back = self.held[-1][1], [], []
            for b in options:
                steps = [c + _step(a, b, self.costs) for a, c in zip(before, self.cost, strict=True)]
                least = min(steps)
                back.append(steps.index(least))
                cost.append(least + b.cost)
            self.back.append(back)
            self.cost = cost
        self.held.append((key, options))
        if len(options) == 1:
            return self._settle(len(self.held) - 1, 0, keep=True)
        if len(self.held) % self.SETTLE == 0:
            alive = set(range(len(options)))
            for k in range(len(self.back) - 1, -1, -1):
                alive = {self.back[k][i] for i in alive}
                if len(alive) == 1:
                    return self._settle(k, alive.pop(), keep=True)
        return []

    def _settle(self, last: int, state: int, keep: bool) -> list[tuple[str, State]]:
        """The records up to ``last`` on the path into ``state``; with ``keep`` that record stays as the foot of what follows."""
        path = [state]
        for k in range(last - 1, -1, -1):
            path.append(self.back[k][path[-1]])
        path.reverse()
        out = [(key, options[i]) for (key, options), i in zip(self.held[: last + 1], path, strict=True)]
        if keep:
            options = self.held[last][1]
            self.held = [(None, [options[state]]), *self.held[last + 1 :]]
            self.back = self.back[last:]
            if self.back:
                self.back[0] = [0] * len(self.back[0])
            else:
                self.cost = [self.cost[state]]
        if out and out[0][0] is None:
            out = out[1:]
        return out

    def finish(self) -> list[tuple[str, State]]:
        """The rest, along the cheapest path."""
        if not self.held:
            return []
        best = self.cost.index(min(self.cost)) if self.leave is None or len(self.held[-1][1]) == 1 else self.leave
        return self._settle(len(self.held) - 1, best, keep=False)


def viterbi(options: list[list[State]], costs: Costs) -> list[State]:
    """The cheapest state of each record of a chain."""
    chain, out = Chain(costs), []
    for i, o in enumerate(options, 1):
        out += chain.add(str(i), o)
    return [s for _, s in out + chain.finish()]


def _product(nodes: list[tuple[list[State], list[State], np.ndarray]], costs: Costs) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Least costs from every state of the first node's first record to every state of each node's last, and the entry and exit before."""
    total, back = [nodes[0][2]], [np.zeros((0, 0), np.int64)]
    for (_, last, _), (first, _, inner) in zip(nodes, nodes[1:], strict=False):
        # a state's own cost stands in the matrix of its node
        free = [s._replace(cost=0) for s in first]
        into = total[-1][:, :, None] + _steps(last, free, costs)[None]
        back.append(into.argmin(axis=1))
        total.append((into.min(axis=1)[:, :, None] + inner[None]).min(axis=1))
    return total, back


def _pack(states_: list[State]) -> str:
    return " ".join(f"{s.order}:{'' if s.at is None else s.at}" for s in states_)


def _unpack(text: str) -> list[State]:
    return [State(o, int(at) if at else None, 0, None) for o, at in (x.split(":") for x in text.split(" "))]


def _nodes(b: pd.DataFrame) -> list[tuple[list[State], list[State], np.ndarray]]:
    out = []
    for first, last, matrix in zip(b["first"], b["last"], b["matrix"], strict=True):
        f, e = _unpack(first), _unpack(last)
        out.append((f, e, np.asarray(matrix, float).reshape(len(f), len(e))))
    return out


_NODE = "source_name string, source_file string, part long, first string, last string, matrix array<double>"
_PICK = "source_name string, source_file string, part long, entry int, leave int"


def block_ends(summaries: DataFrame, highest: int, costs: Costs, fan: int = 512) -> DataFrame:
    """source_name, source_file, part, entry, leave: the states of the first and last record of every block on its file's cheapest path.

    ``summaries``: blocks with the states of their ends and the least cost between
    them; part counts from 0 to ``highest``. Blocks are summed up ``fan`` at a time,
    level by level, until one node is left of every file, and the choice runs back
    down, so no task holds more than ``fan`` of them.
    """

    def fold(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("part")
        total, _ = _product(_nodes(b), costs)
        return pd.DataFrame({"source_name": [key[0]], "source_file": [key[1]], "part": [key[2]], "first": [b["first"].iloc[0]], "last": [b["last"].iloc[-1]], "matrix": [total[-1].ravel().tolist()]})

    def unfold(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("part")
        nodes = _nodes(b)
        total, back = _product(nodes, costs)
        entry, leave = b["entry"].iloc[0], b["leave"].iloc[0]
        if entry != entry:  # the top: nothing is fixed
            entry, leave = np.unravel_index(int(total[-1].argmin()), total[-1].shape)
        entry, leave = int(entry), int(leave)
        picks = []
        for k in range(len(nodes) - 1, 0, -1):
            before = total[k - 1][entry]
            first, last = nodes[k][0], nodes[k - 1][1]
            into = before[:, None] + _steps(last, first, costs)
            at = int((into.min(axis=0) + nodes[k][2][:, leave]).argmin())
            picks.append((at, leave))
            leave = int(into[:, at].argmin())
        picks.append((entry, leave))
        picks.reverse()
        return pd.DataFrame({"source_name": b["source_name"], "source_file": b["source_file"], "part": b["part"], "entry": [p[0] for p in picks], "leave": [p[1] for p in picks]})

    levels = [cut(summaries)]
    while highest >= fan:
        highest //= fan
        up = levels[-1].withColumn("parent", F.floor(F.col("part") / fan))
        levels.append(cut(up.groupBy("source_name", "source_file", "parent").applyInPandas(fold, _NODE)))
    nothing = F.lit(None).cast("int")
    picks = levels[-1].withColumns({"entry": nothing, "leave": nothing}).groupBy("source_name", "source_file").applyInPandas(unfold, _PICK)
    for level in reversed(levels[:-1]):
        above = cut(picks).withColumnRenamed("part", "parent")
        fixed = level.withColumn("parent", F.floor(F.col("part") / fan)).join(above, ["source_name", "source_file", "parent"])
        picks = fixed.groupBy("source_name", "source_file", "parent").applyInPandas(unfold, _PICK)
    return cut(picks)


def normalise_instants(records: DataFrame, sources: DataFrame, block: int = 4000, costs: Costs | None = None) -> DataFrame:
    """One UTC instant per record that fixes one.

    ``records``: canonical_input_id, source_name, source_file, source_row_number,
    date_raw, time_raw, date_precision, raw_fields; ``sources``: source_name,
    date_order, two_digit_from. Returns canonical_input_id, utc_seconds, format and
    readings, the number of readings there were.
    Repeated deliveries count once (the least instant where they differ); null ids
    and records of precision 'approximate' give no row; a numeric date that is
    impossible in its source's registered order gives none, a source without a
    registered order is read in both, and its neighbours decide. A record without a
    row number has no neighbours. Empty tables give an empty result.

    A file of more than ``block`` rows is cut into parts of as many row numbers, so
    that no task holds a whole hot file; ``block_ends`` carries the choice over
    their borders.
    """
    costs = costs or Costs()
    columns = ("source_name", "source_file", "lone", "part", "id", "date_raw", "time_raw", "zone", "date_order", "two_digit_from")

    def walk(batches: Iterator[pd.DataFrame], extra: tuple[str, ...] = ()) -> Iterator[tuple]:
        """(new chain?, key, id, states, readings, extra values) of every readable record, repeated ids in a row once."""
        memo: dict = {}
        key = seen = None
        for b in batches:
            for source, file, lone, part, i, d, t, z, order, base, *more in zip(*[b[c].tolist() for c in (*columns, *extra)], strict=True):
                if (source, file, lone, part, i) == seen:
                    continue
                seen = (source, file, lone, part, i)
                known = memo.get(k := (d, t, z, order, base))
                if known is None:
                    if len(memo) > 100_000:
                        memo.clear()
                    readings = interpretations(d, t, z, None if base is None or base != base else int(base))
                    known = memo[k] = (states(readings, order, costs), len(readings))
                if known[0]:
                    # a chain starts at its first readable record, where its entry counts
                    yield lone or (source, file, part) != key, (source, file, part), i, *known, more
                    key = None if lone else (source, file, part)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = Chain(costs)
        count: dict[str, int] = {}
        done: list[tuple[str, State]] = []

        def out() -> pd.DataFrame:
            told = [(i, s, count.pop(i, 1)) for i, s in done]
            kept = [(i, s.at, s.reading.form, n) for i, s, n in told if s.reading is not None]
            done.clear()
            return pd.DataFrame(kept, columns=["canonical_input_id", "utc_seconds", "format", "readings"]).astype({"utc_seconds": "int64", "readings": "int32"})

        for fresh, _, i, options, n, (entry, leave) in walk(batches, ("entry", "leave")):
            if fresh:
                done += chain.finish()
                chain = Chain(costs, *(None if x is None or x != x else int(x) for x in (entry, leave)))
            count[i] = n
            done += chain.add(i, options)
            if len(done) >= 10_000:
                yield out()
        done += chain.finish()
        yield out()

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, first, last = None, [], []
        # costs from each state of the first record; all that follows a record of one state is the same for all of them
        vectors: list[list[float]] = []
        before: list[float] | None = None

        def out() -> pd.DataFrame:
            rows = vectors if before is None else [[b + c for c in vectors[0]] for b in before]
            return pd.DataFrame({"source_name": [now[0]], "source_file": [now[1]], "part": [now[2]], "first": [_pack(first)], "last": [_pack(last)], "matrix": [[float(c) for row in rows for c in row]]})

        for fresh, key, _, options, _, _ in walk(batches):
            if fresh:
                if now is not None:
                    yield out()
                now, first, before = key, options, None
                vectors = [[s.cost if j == i else float("inf") for j, s in enumerate(options)] for i in range(len(options))]
            else:
                vectors = [[min(c + _step(a, b, costs) for a, c in zip(last, row, strict=True)) + b.cost for b in options] for row in vectors]
            last = options
            if len(options) == 1 and before is None:
                before, vectors = [row[0] for row in vectors], [[0.0]]
        if now is not None:
            yield out()

    registry = small(sources.where(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.min("date_order").alias("date_order"), F.min("two_digit_from").alias("two_digit_from")))
    number = F.coalesce(F.col("source_row_number"), F.lit(0)).cast("long")
    keys = ["source_name", "source_file"]
    rows = (
        records.where(F.col("canonical_input_id").isNotNull() & ~F.coalesce(F.lower(F.trim("date_precision")) == "approximate", F.lit(False)) & F.col("date_raw").isNotNull())
        .select(
            F.coalesce("source_name", F.lit("")).alias("source_name"), F.coalesce("source_file", F.lit("")).alias("source_file"), F.col("source_row_number").isNull().alias("lone"), number.alias("number"),
            F.col("canonical_input_id").alias("id"), "date_raw", "time_raw", F.col("raw_fields")["local_zone"].alias("zone"),
        )
    )
    size = rows.where("not lone").groupBy(*keys).agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high")).where(F.col("n") > block)
    parts = F.least(F.ceil(F.col("n") / block), F.col("high") - F.col("low") + 1)
    long_files = cut(size.select(*keys, "low", parts.alias("parts"), F.ceil((F.col("high") - F.col("low") + 1) / parts).alias("width")))
    # records without a row number have no order; they are spread, and each is a chain by itself
    part = F.when(F.col("lone"), F.pmod(F.xxhash64("id"), F.lit(1024))).otherwise(F.coalesce(F.floor((F.col("number") - F.col("low")) / F.col("width")), F.lit(0))).cast("long")
    named = rows.join(registry, "source_name", "left").join(small(long_files), keys, "left").withColumn("part", part)

    def ordered(df: DataFrame) -> DataFrame:
        return df.repartition(*keys, "lone", "part").sortWithinPartitions(*keys, "lone", "part", "number", "id")

    if long_files.isEmpty():
        nothing = F.lit(None).cast("int")
        ended = named.withColumns({"entry": nothing, "leave": nothing})
    else:
        summed = ordered(named.where("not lone and width is not null")).mapInPandas(summarise, _NODE)
        ends = block_ends(summed, long_files.agg(F.max("parts")).first()[0] - 1, costs)
        ended = named.join(small(ends.withColumn("lone", F.lit(False))), [*keys, "lone", "part"], "left")
    chosen = ordered(ended).mapInPandas(choose, "canonical_input_id string, utc_seconds long, format string, readings int")
    return chosen.groupBy("canonical_input_id").agg(F.min(F.struct("utc_seconds", "format", "readings")).alias("x")).select("canonical_input_id", "x.*")
