"""Exact and rule-based deduplication, candidate pairs and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightloom.functions.text import normalize_key
from nightloom.operators.graph import components

# Confidence of the key families, and the bands of a pair score.
HIGH, MEDIUM, LOW = "high", "medium", "low"
BANDS = ((0.86, "auto"), (0.72, "strong"), (0.58, "review"))


def fingerprint(date: Column, time: Column, location: Column, description: Column) -> Column:
    """Head of the SHA-1 of the normalised keys as sorted JSON; null unless date, location and description say something."""
    d, t, loc, text = normalize_key(date), normalize_key(time), normalize_key(location), normalize_key(description)
    payload = F.to_json(F.struct(d.alias("date"), text.alias("description"), loc.alias("location"), t.alias("time")), {"ignoreNullFields": "false"})
    return F.when((d != "") & (loc != "") & (text != ""), F.substring(F.sha1(payload), 1, 24))


def exact_dedupe(records: DataFrame, key: Column, rank: Column, keep: list[str]) -> DataFrame:
    """One row a key (null keys stay alone): the record of the highest rank, and the number of members."""
    k = F.coalesce(key, F.concat(F.lit("single_"), F.col("id").cast("string")))
    ranked = records.select(k.alias("key"), *keep, rank.alias("_rank"))
    best = ranked.groupBy("key").agg(F.max(F.struct("_rank", *keep)).alias("best"), F.count("*").alias("members"))
    return best.select("key", *[f"best.{c}" for c in keep], "members")


def key_groups(records: DataFrame, families: dict[str, Column]) -> DataFrame:
    """id, root, families: records joined by any shared key of any family, directly or through others.

    Each key's records are linked to the least of them, so a hot key adds one edge
    a record; then components.
    """
    keys = F.array_compact(F.array(*[F.when(c.isNotNull() & (c != ""), F.struct(F.lit(n).alias("family"), c.alias("key"))) for n, c in families.items()]))
    long = records.select("id", F.explode(keys).alias("k")).select("id", "k.family", "k.key")
    heads = long.groupBy("family", "key").agg(F.min("id").alias("head"), F.max("id").alias("other")).where("head <> other").drop("other")
    linked = long.join(heads, ["family", "key"])
    roots = components(linked.select(F.col("id").alias("a"), F.col("head").alias("b")))
    named = linked.select("id", "family").distinct().groupBy("id").agg(F.array_sort(F.collect_set("family")).alias("families"))
    return roots.select(F.col("node").alias("id"), "root").join(named, "id")


def group_confidence(families: Column, of: dict[str, str]) -> Column:
    """The highest confidence of any family present."""
    has = lambda level: F.arrays_overlap(families, F.array(*[F.lit(f) for f, c in of.items() if c == level] or [F.lit("")]))
    return F.when(has(HIGH), HIGH).when(has(MEDIUM), MEDIUM).otherwise(LOW)


def blocked_pairs(records: DataFrame, block: list[str], cap: int | None = None) -> DataFrame:
    """left_id, right_id of records that share a block, lesser id first.

    ``cap`` is the operator's own limit of a block's size; blocks beyond it come
    back from ``oversized_blocks`` for another rule, and none without a cap.
    """
    r = records.dropna(subset=block)
    if cap is not None:
        fit = r.groupBy(*block).count().where(F.col("count") <= cap).drop("count")
        r = r.join(fit, block, "left_semi")
    a, b = r.select(*block, F.col("id").alias("left_id")), r.select(*block, F.col("id").alias("right_id"))
    return a.join(b, block).where("left_id < right_id").select("left_id", "right_id").distinct()


def oversized_blocks(records: DataFrame, block: list[str], cap: int) -> DataFrame:
    """Blocks that ``blocked_pairs`` leaves out under a cap, with their sizes."""
    return records.dropna(subset=block).groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > cap)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 0 without any."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def pair_score(**signs: tuple[Column, float, float]) -> Column:
    """Sum of weights, each sign given as (agrees, weight if true, weight if false); a null sign adds nothing; within 0 and 1."""
    total = F.lit(0.0)
    for agrees, yes, no in signs.values():
        total = total + F.when(agrees, yes).when(~agrees, no).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def score_band(score: Column) -> Column:
    """Band of a pair score."""
    out = F.lit("reject")
    for bound, name in reversed(BANDS):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Catalyst limits each group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_pair(rows: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One row an unordered pair, the best score."""
    return rows.groupBy(F.least(left, right).alias(left), F.greatest(left, right).alias(right)).agg(F.max(score).alias(score))


def guarded_overlay(base: DataFrame, patches: DataFrame, key: str, field: str) -> DataFrame:
    """``base`` with ``field`` replaced where a patch's guard still equals the present value; says whether it was applied."""
    p = patches.select(key, F.col("guard").alias("_guard"), F.col("value").alias("_value"), F.lit(True).alias("_there"))
    hit = F.coalesce(F.col("_there") & F.col(field).eqNullSafe(F.col("_guard")), F.lit(False))
    return base.join(p, key, "left").withColumns({"applied": hit, field: F.when(hit, F.col("_value")).otherwise(F.col(field))}).drop("_guard", "_value", "_there")


def unique_matches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose left side has exactly one right side."""
    one = pairs.groupBy(left).agg(F.min(right).alias(right), F.max(right).alias("_m"))
    return one.where(F.col(right) == F.col("_m")).drop("_m")


def dominant_match(pairs: DataFrame, left: str, right: str, weight: str, ratio: float) -> DataFrame:
    """The heaviest right side of each left one if it outweighs the next ``ratio`` times."""
    top = top_per_group(pairs, [left], [F.desc(weight), F.col(right)], 2)
    two = top.groupBy(left).agg(F.min_by(right, "rank").alias(right), F.max(F.when(F.col("rank") == 1, F.col(weight))).alias("_a"), F.max(F.when(F.col("rank") == 2, F.col(weight))).alias("_b"))
    return two.where(F.col("_b").isNull() | (F.col("_a") >= F.col("_b") * ratio)).select(left, right)


def priority_union(lanes: list[DataFrame], key: str) -> DataFrame:
    """One row a key from the first lane that has it."""
    from functools import reduce

    every = reduce(DataFrame.unionByName, [lane.withColumn("lane", F.lit(i)) for i, lane in enumerate(lanes)])
    return top_per_group(every, [key], [F.col("lane")], 1).drop("rank")


def claims(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """claim_id, key, field, value: fields unpivoted, one row per distinct claim that says something."""
    long = records.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(key, "x.*")
    said = long.where(F.trim("value") != "").distinct()
    return said.withColumn("claim_id", F.substring(F.sha1(F.concat_ws("\u001f", F.col(key).cast("string"), "field", "value")), 1, 20))
