"""Connected components by minimum labels, with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightloom.session import cut


def components(edges: DataFrame, max_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """node, root of every node of undirected edges (a, b): labels fall to the least neighbour and then to their label's label.

    The second step halves path lengths, so rounds grow with their logarithm.
    Aggregations are partial before the shuffle, and joins on the label are split
    by adaptive execution when one is hot. ``keep`` cuts the lineage of a round.
    """
    both = edges.where("a is not null and b is not null and a <> b").selectExpr("a as u", "b as v")
    both = keep(both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    for _ in range(max_rounds):
        seen = both.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        low = label.join(seen, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = low.join(label.select(F.col("u").alias("m"), F.col("l").alias("j")), "m", "left").select("u", "l", F.least("m", "j").alias("n"))
        # a label also lowers the node whose name it was
        push = jump.groupBy(F.col("l").alias("u")).agg(F.min("n").alias("p"))
        new = keep(jump.join(push, "u", "left").select("u", F.col("l").alias("old"), F.least("n", "p").alias("l")))
        changed = new.where("l < old").limit(1).count()
        label = new.select("u", "l")
        if not changed:
            return label.select(F.col("u").alias("node"), F.col("l").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
