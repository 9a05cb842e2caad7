"""Numbers over a whole table without one task that sees all of it, and tables cut off from their lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: monotonically_increasing_id keeps the partition above this many bits and the row's place below them.
PLACE_BITS = 33


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the folder that spark.checkpoint.dir names; without one, only a local master has a place to write to."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or "file:///tmp/checkpoints")
    return df.checkpoint()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with a gapless number from 1 in the given order (which has to leave no ties).

    The rows are sorted into ranges; a row's number is its place in its range and the sizes of the ranges before. What is
    summed and broadcast is one row per range, so its size is that of the number of shuffle partitions.
    """
    ranges = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", PLACE_BITS), F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    sizes = ranges.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    joined = ranges.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.col("__before") + place + 1).drop("__at", "__part", "__before")
