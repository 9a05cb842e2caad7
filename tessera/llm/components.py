"""Connected components by contraction: no task and no driver ever holds a component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import join_spread, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """node and label for every node of edges (a, b: long); equal labels mean connected, and a label is one of the component's nodes.

    In each round every node joins the neighbour (or itself) that a hash, another one each round, puts first. Edges move to the
    nodes joined, and those inside one node go. A round takes away a constant share of nodes on average, so the number of
    rounds grows with the logarithm of the input. Minima are aggregated before they are shuffled, and a hub's edges and a component's
    nodes meet their label where they are (shared.join_spread), so hubs are no trouble.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while not left.isEmpty():
        first = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("p"), F.col(c).alias("to"))
        both = left.select(F.col("a").alias("node"), first("b").alias("x"), F.lit(1).alias("of_a"), F.lit(0).alias("of_b")).union(left.select(F.col("b").alias("node"), first("a").alias("x"), F.lit(0), F.lit(1)))
        joined = stage(both.groupBy("node").agg(F.min("x").alias("x"), F.sum("of_a").alias("of_a"), F.sum("of_b").alias("of_b")).select("node", F.least("x", first("node"))["to"].alias("to"), "of_a", "of_b"), "joined")
        at_a, at_b = joined.where("of_a > 0").select(F.col("node").alias("a"), F.col("to").alias("to_a"), "of_a"), joined.where("of_b > 0").select(F.col("node").alias("b"), F.col("to").alias("to_b"), "of_b")
        moved = join_spread(join_spread(left, at_a, ["a"], "of_a", ["a", "b"]), at_b, ["b"], "of_b", ["a", "b"]).where("to_a <> to_b")
        left = stage(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        steps = joined.select(F.col("node").alias("label"), "to")
        if labels is None:
            labels = steps.toDF("node", "label")
        else:
            sizes = labels.groupBy("label").agg(F.count("*").alias("nodes"))
            known = stage(steps.join(sizes, "label"), "label-steps")
            labels = stage(join_spread(labels, known, ["label"], "nodes", ["node"]).select("node", F.coalesce("to", "label").alias("label")), "labels")
        turn += 1
    return labels if labels is not None else left.toDF("node", "label")
