"""Best representative of each duplicate group.

``survivors`` keeps a strict order of trust, date and id, field by field: there a
vote has nothing to decide, and the best rank is an aggregate. ``consensus_survivors``
lets the group decide by token-level consensus: its values are aligned
progressively into columns, every record votes for its tokens with a weight of
trust and age, and the existing value closest to the outcome survives.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.unknown import says_something
from nightloom.session import cut, small

#: Values or profiles aligned in one go; larger groups are aligned in rounds of so many.
BATCH = 48
_TOKEN = re.compile(r"\w+|[^\w\s]")

Profile = list[dict[str, float]]


#: What a column adds to an alignment: with a token in common, with none (less than two gaps cost), and left alone.
FIT, MISFIT, GAP = 1.0, -0.25, -0.2


def _align(a: Profile, b: Profile) -> list[tuple[int, int]]:
    """Pairs of columns (-1: none) of the best global alignment of two profiles."""
    n, m = len(a), len(b)
    fits = [[FIT if not x.keys().isdisjoint(y) else MISFIT for y in b] for x in a]
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    # which way the best goes on: 0 both, 1 a alone, 2 b alone
    way = [[2] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n and j == m:
                continue
            ways = (score[i + 1][j + 1] + fits[i][j] if i < n and j < m else -1e9, score[i + 1][j] + GAP if i < n else -1e9, score[i][j + 1] + GAP if j < m else -1e9)
            score[i][j] = max(ways)
            way[i][j] = ways.index(score[i][j])
    out, i, j = [], 0, 0
    while i < n or j < m:
        k = way[i][j]
        out.append((i if k != 2 else -1, j if k != 1 else -1))
        i, j = i + (k != 2), j + (k != 1)
    return out


def merged(a: Profile, b: Profile) -> Profile:
    """Two profiles aligned and their votes added."""
    out = []
    for i, j in _align(a, b):
        column = dict(a[i]) if i >= 0 else {}
        for t, w in (b[j] if j >= 0 else {}).items():
            column[t] = column.get(t, 0.0) + w
        out.append(column)
    return out


def profile(values: list[str], weights: list[float]) -> Profile:
    """Weighted tokens by column, values aligned one after the other, the heaviest first."""
    out: Profile = []
    for w, v in sorted(zip(weights, values, strict=True), key=lambda x: (-x[0], x[1])):
        out = merged(out, [{t: w} for t in _TOKEN.findall(v.lower())])
    return out


def elected(columns: Profile, total: float) -> list[str]:
    """The token of every column that outweighs having none there."""
    best = [(max(c, key=lambda t: (c[t], t)), c) for c in columns]
    return [t for t, c in best if c[t] > total - sum(c.values())]


def apart(a: list[str], b: list[str]) -> int:
    """Tokens to insert, leave out or exchange between two lists."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _ranked(links: DataFrame, records: DataFrame, sources: DataFrame, fields: dict[str, str]) -> DataFrame:
    """event_id, field_name, value, rank (trust, late, id; the least is the best) of every value of events with two or more distinct records."""
    late = F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp_ltz")), F.lit(-(1 << 62)))
    tell = [F.when(says_something(F.col(f)), F.col(f)).alias(f) for f in fields]
    link = links.select(F.trim("event_id").alias("event_id"), F.trim("canonical_input_id").alias("id")).where("event_id <> '' and id <> ''").distinct()
    # a record delivered more than once ranks by its latest delivery
    rec = records.select(F.trim("canonical_input_id").alias("id"), late.alias("late"), "source_name", *tell).where("id <> ''")
    trust = small(sources.where("source_name is not null").groupBy("source_name").agg(*[F.min(c).alias(c) for c in set(fields.values())]))
    long = link.join(rec, "id").join(trust, "source_name", "left").select(
        "event_id", "id", "late", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.coalesce(F.col(t).cast("int"), F.lit(1 << 30)).alias("trust")) for f, t in fields.items()])).alias("x")
    )
    # late is negated so that the smallest struct is the best
    ranked = long.where("x.value is not null").select("event_id", "x.field_name", "x.value", F.struct(F.col("x.trust").alias("trust"), (-F.col("late")).alias("late"), F.col("id").alias("id")).alias("rank"))
    many = link.groupBy("event_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("event_id")
    return ranked.join(many, "event_id")


def survivors(links: DataFrame, records: DataFrame, sources: DataFrame, fields: dict[str, str]) -> DataFrame:
    """event_id, field_name, canonical_input_id of the record whose value survives in strict order.

    ``links``: event_id, canonical_input_id; ``records``: canonical_input_id,
    source_name, ingested_at and the fields; ``sources``: source_name and the trust
    columns; ``fields``: field to trust column (1 is best, a source without one
    comes last). Events with two or more distinct records count; ids are trimmed,
    empty and null ids link nothing; values that say nothing are left out, and a
    field without any value gives no row. Rank: trust, then the latest
    ingested_at, then the smallest id. Repeated links and deliveries count once,
    empty tables give an empty result.

    This is the limit of ``consensus_survivors`` in which a record outweighs all
    that rank after it together: its tokens win every column, so the value closest
    to the outcome is its own. The least rank is taken map-side, so a hot event
    never comes together.
    """
    best = _ranked(links, records, sources, fields).groupBy("event_id", "field_name").agg(F.min("rank").alias("rank"))
    return best.select("event_id", "field_name", F.col("rank.id").alias("canonical_input_id"))


def votes(rank: Column, as_of: int, trust_ratio: float, half_life_days: float) -> Column:
    """The weight of a record: ``trust_ratio`` times less for every step of trust (at most 20), half for every ``half_life_days`` of age at ``as_of``."""
    age = F.least(F.lit(20.0), F.greatest(F.lit(0.0), (F.lit(as_of) + rank["late"]) / (86_400e6 * half_life_days)))
    return F.pow(F.lit(trust_ratio), 1.0 - F.least(rank["trust"], F.lit(21))) * F.pow(F.lit(2.0), -age)


def consensus_survivors(links: DataFrame, records: DataFrame, sources: DataFrame, fields: dict[str, str], trust_ratio: float = 1.5, half_life_days: float = 365.0) -> DataFrame:
    """event_id, field_name, canonical_input_id, value, built, distance of the value that survives by token-level consensus.

    Frames and rules of what counts are those of ``survivors``. built is the
    outcome of the vote, a token wins its column if it outweighs having none there;
    value is the existing one closest to it by tokens to insert, leave out or
    exchange (distance), ties by the greater weight, then the better rank, and
    canonical_input_id is the best-ranked record that carries it. A record votes
    once for each value it was delivered with.

    Equal values are pre-aggregated, and a group of more than BATCH values is
    aligned in salted batches whose profiles are then merged in rounds, so that no
    value loses its votes and no task holds an unbounded group.
    """
    keys = ["event_id", "field_name"]
    as_of = records.agg(F.max(F.unix_micros(F.col("ingested_at").cast("timestamp_ltz")))).first()[0] or 0
    each = _ranked(links, records, sources, fields).groupBy(*keys, "value", "rank.id").agg(F.min("rank").alias("rank"))
    values = cut(each.groupBy(*keys, "value").agg(F.sum(votes(F.col("rank"), as_of, trust_ratio, half_life_days)).alias("weight"), F.min("rank").alias("rank")))
    totals = cut(values.groupBy(*keys).agg(F.sum("weight").alias("total"), F.count("*").alias("n")))

    def batched(df: DataFrame, by: str) -> DataFrame:
        hot = totals.where(F.col("n") > BATCH).select(*keys, "n")
        return df.join(small(hot), keys, "left").withColumn("part", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.ceil(F.col("n") * 2 / BATCH)))).drop("n")

    kind = "array<map<string,double>>"

    def udf(of: Callable[[list], Profile]) -> Callable[[Column], Column]:
        @F.pandas_udf(kind)
        def run(lists: pd.Series) -> pd.Series:
            return lists.map(lambda x: of(list(x)))

        return run

    first = udf(lambda rows: profile([r["value"] for r in rows], [r["weight"] for r in rows]))

    def sum_up(profiles: list) -> Profile:
        out: Profile = []
        for p in profiles:
            out = merged(out, [dict(c) for c in p])
        return out

    again = udf(sum_up)
    lists = batched(values, "value").groupBy(*keys, "part").agg(F.collect_list(F.struct("value", "weight")).alias("rows"))
    found = cut(lists.select(*keys, "part", first("rows").alias("columns")))
    while not found.where("part > 0").isEmpty():
        up = found.withColumn("part", F.floor(F.col("part") / BATCH)).groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.to_json("columns"))).alias("rows"))
        found = cut(up.select(*keys, "part", again(F.transform("rows", lambda r: F.from_json(r, kind))).alias("columns")))

    @F.pandas_udf("array<string>")
    def outcome(columns: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([elected([dict(c) for c in p], w) for p, w in zip(columns, total, strict=True)])

    @F.pandas_udf("int")
    def far(value: pd.Series, tokens: pd.Series) -> pd.Series:
        return pd.Series([apart(_TOKEN.findall(v.lower()), list(t)) for v, t in zip(value, tokens, strict=True)], dtype="int32")

    voted = cut(found.join(totals, keys).select(*keys, outcome("columns", "total").alias("tokens")))
    judged = values.join(voted, keys).select(*keys, "value", "weight", "rank", "tokens", far("value", "tokens").alias("distance"))
    best = judged.groupBy(*keys).agg(F.min(F.struct("distance", (-F.col("weight")).alias("lighter"), "rank", "value")).alias("x"), F.first("tokens").alias("tokens"))
    return best.select(*keys, F.col("x.rank.id").alias("canonical_input_id"), "x.value", F.array_join("tokens", " ").alias("built"), "x.distance")
