"""H1: connected components by hooking parents below the smallest label around them, written out each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators.scratch import forget, kept


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); component: the smallest node reachable.

    Each node points to a parent that is no larger; it begins with its smallest neighbour. In a round a node learns the
    smallest grandparent m of its neighbours; it and its parent both take m as parent if that is smaller than what they
    have, and pointers jump to grandparents. As whole trees are hooked and not single nodes, the rounds grow with the
    logarithm of a component's size: 3 for a star, about log2(n) + 2 for a path of n nodes in any order.

    A round is two joins and two aggregates with partial sums, over tables that are written first, so that a hub's rows
    can be split. Tables of finished rounds are deleted.
    """
    both = kept(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    first = kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")))
    labels = _with_grandparents(first)
    while True:
        grand = labels.select(F.col("node").alias("b"), "grand")
        near = both.join(grand, "b").groupBy("a").agg(F.min("grand").alias("m"))
        met = labels.join(near, labels["node"] == near["a"])
        own = F.struct("node", F.least("grand", "m").alias("to"), F.col("parent").alias("was"))
        above = F.struct(F.col("parent").alias("node"), F.col("m").alias("to"), F.lit(None).alias("was"))
        moved = kept(
            met.select(F.inline(F.array(own, above))).groupBy("node").agg(F.min("to").alias("parent"), F.max("was").alias("was"))
        )
        if moved.where("parent <> was").isEmpty():
            forget(both, first, moved)
            return labels.select("node", F.col("parent").alias("component"))
        last, labels = labels, _with_grandparents(moved)
        forget(first, last)
        first = moved


def _with_grandparents(labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("node").alias("u"), F.col("parent").alias("grand"))
    return kept(labels.join(up, labels["parent"] == up["u"]).select("node", "parent", "grand"))
