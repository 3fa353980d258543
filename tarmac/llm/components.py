"""Connected components of an edge list, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of ``edges`` (a, b); root is the least node reachable.

    A node that is its own root has no row.

    Every round links each node's larger neighbours to its least neighbour, then
    its smaller ones (large and small stars), until no edge changes.  A node with
    very many neighbours is a skewed join key, never a collected list, and each
    round is checkpointed, so a lost executor costs one round.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    if now.isEmpty():
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    while True:
        both = now.union(now.select("lo", "hi")).toDF("n", "m")
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = (
            both.where("m > n").join(least, "n")
            .select(F.col("m").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        )
        small_least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        after = saved(
            large.join(small_least, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi"), F.col("least").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct()
        )
        # stars whose centres are nobody's leaf: nothing is left to shorten
        if after.join(after.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty() and after.groupBy("hi").count().where("count > 1").isEmpty():
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        now = after
