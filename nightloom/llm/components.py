"""Pairwise matches consolidated into groups by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.session import cut


def tidy_id(value: Column) -> Column:
    """An id without outer blanks and case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(value, r"^\s+|\s+$", "")), F.lit(""))


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest node around it.

    ``edges`` has u > v. The minimum of each node is pre-aggregated and joined
    back, so a hot node is never gathered in one task; its edges are split by
    adaptive execution.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node itself, moves to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40))), F.lit(0))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: for every node of ``edges`` (u, v strings) its component's least node.

    Rows with a missing end and self-links are ignored, repeated and turned-round
    rows change nothing, and an empty table gives an empty result. Each round ends
    in a checkpoint in the shared folder; it stops when a round changes nothing.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    before = _state(edges)
    for _ in range(max_rounds):
        edges = cut(small_star(large_star(edges).distinct()).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record in a group of two or more: input_id, group_id.

    ``records``: input_id, event_id; ``pairs``: left_input_id, right_input_id,
    verdict. Links are pairs with verdict 'same' and equal event ids; ids compare
    without case and outer blanks; a missing or empty id links nothing. Ends that
    are no record can carry a link but are not reported. group_id is the smallest
    input_id of the group. Members of an event are linked to its least member, so
    a hot event adds one link a record.
    """
    rec = records.select("input_id", tidy_id(F.col("input_id")).alias("node"), tidy_id(F.col("event_id")).alias("event")).where("node is not null")
    heads = rec.where("event is not null").groupBy("event").agg(F.min("node").alias("v"), F.max("node").alias("other")).where("v <> other").drop("other")
    by_event = rec.join(heads, "event").where("node <> v").select(F.col("node").alias("u"), "v")
    same = pairs.where(F.lower(F.trim("verdict")) == "same").select(tidy_id(F.col("left_input_id")).alias("u"), tidy_id(F.col("right_input_id")).alias("v"))
    roots = connected_components(by_event.union(same))
    members = rec.select("input_id", "node").join(roots, "node").select("input_id", "root")
    named = members.groupBy("root").agg(F.min("input_id").alias("group_id"), F.max("input_id").alias("last")).where("group_id <> last").drop("last")
    return members.join(named, "root").select("input_id", "group_id").distinct()
