"""Timestamps in many formats and zones."""

from __future__ import annotations

import datetime as dt
import zoneinfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from nightloom.operators import instants
from nightloom.operators.instants import Chain, Costs, State, interpretations, normalise_instants, parse_time, states, viterbi
from nightloom.session import table


def at(*args, tz="UTC"):
    return int(dt.datetime(*args, tzinfo=zoneinfo.ZoneInfo(tz)).timestamp())


@pytest.mark.parametrize(
    ("date", "time", "zone", "order", "expected"),
    [
        ("2005-01-10", "18:15", "America/New_York", "mdy", at(2005, 1, 10, 18, 15, tz="America/New_York")),
        ("03/04/2011", "6.30 p.m.", "Europe/London", "dmy", at(2011, 4, 3, 18, 30, tz="Europe/London")),
        ("03/04/2011", "6.30 p.m.", "Europe/London", "mdy", at(2011, 3, 4, 18, 30, tz="Europe/London")),
        ("27 de septiembre de 2012", "19h15", "Europe/Madrid", "mdy", at(2012, 9, 27, 19, 15, tz="Europe/Madrid")),
        ("15. Januar 2020", "0600 hrs", "Europe/Berlin", "mdy", at(2020, 1, 15, 6, 0, tz="Europe/Berlin")),
        ("Sun Oct. 28, 2007", "8 PM", "America/Chicago", "mdy", at(2007, 10, 28, 20, 0, tz="America/Chicago")),
        ("2001-11-08T01:32:00.5-03:30", None, None, "mdy", at(2001, 11, 8, 5, 2)),
        ("Sun, 06 Nov 2011 01:43:00 -0400", None, "Asia/Tokyo", "mdy", at(2011, 11, 6, 5, 43)),
        ("20000715T011500Z", "none", None, "mdy", at(2000, 7, 15, 1, 15)),
        ("20081107 18:49", "", "UTC", "mdy", at(2008, 11, 7, 18, 49)),
        ("2009-09-22, 10:10PM", None, "America/Denver", "mdy", at(2009, 9, 22, 22, 10, tz="America/Denver")),
        ("2004-05-05\\n00:00", None, "UTC", "mdy", at(2004, 5, 5)),
        ("1103626800", None, None, "mdy", 1103626800),
        ("1453268700089", None, None, "mdy", 1453268700),
        ("18-07-88", "approx 1:00am", "UTC", "dmy", at(1988, 7, 18, 1)),
        ("07.03.07", "22:30 (CEST)", "UTC", "mdy", at(2007, 7, 3, 20, 30)),
        ("2013-11-03", "1:30 AM", "America/New_York", "mdy", at(2013, 11, 3, 5, 30)),
        ("2013-03-10", "2:30 AM", "America/New_York", "mdy", at(2013, 3, 10, 7, 30)),
    ],
)
def test_values(date, time, zone, order, expected):
    assert [s.at for s in viterbi([states(interpretations(date, time, zone, 1950), order, Costs())], Costs())] == [expected]


@pytest.mark.parametrize(
    ("date", "time", "zone"),
    [
        ("02/31/1991", "18:15", "UTC"), ("2000-09-27", "25:71", "UTC"), ("September 2010", "18:15", "UTC"), ("2000-09-27", "dusk", "UTC"), ("2000-09-27", None, "UTC"), (None, "18:15", "UTC"),
        ("2000-09-27", "18:15", None), ("2000-09-27", "18:15", "Mars/Base"), ("2000-09-27", "18:15 QQT", "UTC"), ("unknown", "18:15", "UTC"), ("x" * 10000, "1:1", "UTC"), ("13/40/2001", "18:15", "UTC"),
    ],
)
def test_no_case(date, time, zone):
    assert interpretations(date, time, zone, 1950) == []


def test_two_digit_years():
    assert [dt.datetime.fromtimestamp(interpretations(f"01/01/{y}", "00:00", "UTC", 1940)[0].at, dt.UTC).year for y in ("39", "40", "99")] == [2039, 1940, 1999]


@given(st.text(max_size=40), st.text(max_size=20))
def test_never_raises(date, time):
    interpretations(date, time, "Europe/Paris", None)
    parse_time(time)


def test_all_readings():
    # both orders of a numeric date, both instants of a time that occurs twice, one of a skipped time
    assert [(r.order, r.fold) for r in interpretations("05/06/2001", "10:00", "UTC", 1950)] == [("dmy", 0), ("mdy", 0)]
    assert [(r.fold, r.at) for r in interpretations("2021-11-07", "01:30", "America/New_York", 1950)] == [(0, at(2021, 11, 7, 5, 30)), (1, at(2021, 11, 7, 6, 30))]
    assert [r.at for r in interpretations("2013-03-10", "2:30 AM", "America/New_York", 1950)] == [at(2013, 3, 10, 7, 30)]
    assert len(interpretations("11/07/2021", "01:30", "America/New_York", 1950)) == 3


def read(dates, order=None, costs=None):
    """Dates as year-month-day of a chain of numeric dates at noon."""
    costs = costs or Costs()
    chosen = viterbi([states(interpretations(d, "12:00", "UTC", 1950), order, costs) for d in dates], costs)
    return [s.at and dt.datetime.fromtimestamp(s.at, dt.UTC).strftime("%y%m%d") for s in chosen]


def test_neighbours_decide_without_a_registered_order():
    assert read(["25/12/2001", "05/06/2002", "26/07/2002"]) == ["011225", "020605", "020726"]
    assert read(["12/25/2001", "05/06/2002", "07/26/2002"]) == ["011225", "020506", "020726"]
    # the order in force holds over dates that have none
    assert read(["12/25/2001", "2002-01-01", "05/06/2002", "2002-07-01", "05/07/2002"])[2::2] == ["020506", "020507"]
    # equal else: the one that does not run back
    assert read(["2002-05-20", "05/06/2002", "2002-06-07"]) == ["020520", "020605", "020607"]


def test_a_registered_order_holds_whatever_the_neighbours_are():
    assert read(["25/12/2001", "05/06/2002", "26/07/2002"], "mdy") == [None, "020506", None]
    assert read(["05/06/2002"] * 3, "dmy") == ["020605"] * 3
    # with another price it is the neighbours that decide
    assert read(["25/12/2001", "05/06/2002", "26/07/2002"], "mdy", Costs(contradiction=1)) == ["011225", "020605", "020726"]


chains = st.lists(st.lists(st.tuples(st.sampled_from(["dmy", "mdy"]), st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=3), min_size=1, max_size=12)


@given(chains, st.integers(1, 5))
def test_chain_and_its_blocks_cost_the_least(chain, width):
    costs = Costs()
    options = [[State(o, a, 7 * c, None) for o, a, c in record] for record in chain]
    price = lambda path: sum(s.cost for s in path) + sum(instants._step(a, b, costs) for a, b in zip(path, path[1:], strict=False))
    best = {s: s.cost for s in options[0]}
    for record in options[1:]:
        best = {b: min(c + instants._step(a, b, costs) for a, c in best.items()) + b.cost for b in record}
    Chain.SETTLE, kept = 3, Chain.SETTLE
    try:
        assert price(viterbi(options, costs)) == min(best.values())
    finally:
        Chain.SETTLE = kept
    # the same from blocks that know only their ends' states and the least cost between them
    blocks = [options[i : i + width] for i in range(0, len(options), width)]
    nodes = []
    for block in blocks:
        matrix = instants.np.where(instants.np.eye(len(block[0]), dtype=bool), [s.cost for s in block[0]], instants.np.inf)
        for before, now in zip(block, block[1:], strict=False):
            matrix = (matrix[:, :, None] + instants._steps(before, now, costs)[None]).min(axis=1)
        nodes.append((instants._unpack(instants._pack(block[0])), instants._unpack(instants._pack(block[-1])), matrix))
    assert instants._product(nodes, costs)[0][-1].min() == min(best.values())


SCHEMA = "canonical_input_id string, source_name string, source_file string, source_row_number int, date_raw string, time_raw string, date_precision string, raw_fields map<string,string>, zone string, part string, number string"


def test_table(spark):
    rows = [
        ("a", "s", "f", 1, "2001-02-03", "04:05", "day", {"local_zone": "UTC"}, "x", "y", "z"),
        ("a", "s", "f", 1, "2001-02-03", "04:05", "day", {"local_zone": "UTC"}, "x", "y", "z"),
        ("b", "s", "f", 2, "2001-02-03", "04:05", "Approximate", {"local_zone": "UTC"}, None, None, None),
        ("c", "s", None, None, "2001-02-03", "04:05", None, {"local_zone": "UTC"}, None, None, None),
        ("d", None, "f", 3, "2001-02-03", "04:05", "month", None, None, None, None),
        (None, "s", "f", 4, "2001-02-03", "04:05", "day", {"local_zone": "UTC"}, None, None, None),
        ("e", "other", "g", 1, "25/12/2001", "04:05", "day", {"local_zone": "UTC"}, None, None, None),
        ("f", "other", "g", 2, "01/02/2002", "04:05", "day", {"local_zone": "UTC"}, None, None, None),
    ]
    sources = spark.createDataFrame([("s", "mdy", 1950)], "source_name string, date_order string, two_digit_from int")
    got = {r[0]: r[1] for r in normalise_instants(spark.createDataFrame(rows, SCHEMA), sources).select("canonical_input_id", "utc_seconds").collect()}
    assert got == {"a": at(2001, 2, 3, 4, 5), "c": at(2001, 2, 3, 4, 5), "e": at(2001, 12, 25, 4, 5), "f": at(2002, 2, 1, 4, 5)}
    assert normalise_instants(spark.createDataFrame([], SCHEMA), sources).count() == 0
    assert normalise_instants(spark.createDataFrame(rows, SCHEMA), sources.limit(0)).count() == 4


SOURCES = "source_name string, date_order string, two_digit_from int"


def test_borders_change_nothing(spark):
    # month first throughout, which only few records show; whatever the width of a block, and over deliveries many times repeated
    dates = ["05/06/2001", "05/07/2001", "06/08/2001", "06/20/2001", "2001-06-21", "07/01/2001", "07/02/2001", "08/01/2001", "08/05/2001", "08/06/2001", "09/01/2001", "09/25/2001", "10/01/2001"]
    rows = [(f"i{k:03}", "new", "f", k, d, "12:00", "day", {"local_zone": "UTC"}, None, None, None) for k, d in enumerate(dates * 3)]
    df = spark.createDataFrame([r for r in rows for _ in range(1 + 20 * (r[0] == "i002"))], SCHEMA)
    sources = spark.createDataFrame([], SOURCES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = [sorted(normalise_instants(df, sources, block=b).collect()) for b in (2, 4, 7, 4000)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got[0]) == len(rows) and got[0] == got[1] == got[2] == got[3]
    assert {dt.datetime.fromtimestamp(r["utc_seconds"], dt.UTC).month for r in got[0]} == {5, 6, 7, 8, 9, 10}


def test_levels_of_blocks(spark):
    rows = [(f"i{k:03}", "new", "f", k, "12/25/2001" if k == 59 else "05/06/2001", "12:00", "day", {"local_zone": "UTC"}, None, None, None) for k in range(60)]
    whole = instants.block_ends
    instants.block_ends = lambda s, highest, costs: whole(s, highest, costs, fan=3)
    try:
        got = normalise_instants(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SOURCES), block=2).collect()
    finally:
        instants.block_ends = whole
    assert len(got) == 60 and {r["utc_seconds"] for r in got} == {at(2001, 5, 6, 12), at(2001, 12, 25, 12)}


def test_records_without_a_row_number_have_no_neighbours(spark):
    rows = [("a", "new", "f", None, "12/25/2001", "12:00", "day", {"local_zone": "UTC"}, None, None, None)] + [(f"b{k}", "new", "f", None, "05/06/2001", "12:00", "day", {"local_zone": "UTC"}, None, None, None) for k in range(50)]
    got = {r[0]: r[1] for r in normalise_instants(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SOURCES)).collect()}
    assert got == {"a": at(2001, 12, 25, 12)} | {f"b{k}": at(2001, 6, 5, 12) for k in range(50)}


def test_registered_and_inferred_orders(spark, sf_dir):
    from nightloom.queries import p6_inferred

    got = p6_inferred(spark, sf_dir).collect()
    records, alike = sum(r["records"] for r in got), sum(r["alike"] for r in got)
    assert records and alike >= 0.9 * records
    assert records == normalise_instants(table(spark, sf_dir, "canonical_input"), table(spark, sf_dir, "source_registry")).count()


def test_hot_file_in_blocks(spark):
    rows = [(f"i{k:04}", "s", "hot", k, "2001-02-03", f"{k % 24:02}:05", "day", {"local_zone": "UTC"}, None, None, None) for k in range(900)]
    sources = spark.createDataFrame([("s", "mdy", 1950)], "source_name string, date_order string, two_digit_from int")
    assert normalise_instants(spark.createDataFrame(rows, SCHEMA), sources, block=50).count() == 900
