"""Connected components over a table of links, by minimum labels with pointer
jumping. Nothing is collected but one count a round; each round's labels are a
written table, so rounds survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for each node of `links` (a, b): component is the smallest
    node that links reach. Directions and repeats don't matter. Labels of a node's
    neighbours meet in a partial minimum, so a node with very many links is no
    more rows to its task than there are map tasks, and hot nodes and labels are joined
    by broadcast."""
    ends = links.where("a <> b").select("a", "b")
    both = common.written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = common.written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("links")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), "links"), "labels")
    total = both.count()
    for _ in range(rounds):
        # A node of very many links, and a label of very many nodes, are met by broadcast.
        near = common.hot_split_join(both, labels, "b", "node", "links", total).groupBy(F.col("a").alias("of")).agg(F.min("label").alias("near"))
        step = common.written(labels.join(near, F.col("node") == F.col("of")).select("node", "links", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        held = step.groupBy(F.col("label").alias("to")).agg(F.count("*").alias("nodes"))
        next_ = common.written(held.join(step.select(F.col("node").alias("_node"), F.col("label").alias("next")), F.col("to") == F.col("_node")).select("to", "nodes", "next"), "jumps")
        moved = common.hot_split_join(step, next_, "label", "to", "nodes", total)
        labels = common.written(moved.select("node", "links", "was", F.least("label", "next").alias("label")), "labels")
        if not labels.where("was <> label").limit(1).count():
            break
    else:
        raise RuntimeError(f"links need more than {rounds} rounds")
    return labels.select("node", F.col("label").alias("component"))
