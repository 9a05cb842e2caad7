"""Identities: names, states folded from an action log, lookups with several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.clean import auto_name, auto_number
from tessera.operators.clusters import components
from tessera.operators.numbering import cut, numbered
from tessera.operators.similarity import best_before
from tessera.operators.spread import join_counted


def status_pivot(df: DataFrame, identity: str, status: str, statuses: list[str], score: str) -> DataFrame:
    counts = [F.count(F.when(F.col(status) == s, 1)).alias(f"n_{s}") for s in statuses]
    return df.groupBy(identity).agg(F.count("*").alias("n"), *counts, F.avg(score).alias("mean_score"))


def without_lane(pivot: DataFrame, lane: str) -> DataFrame:
    """Identities that have rows outside a lane."""
    return pivot.where(F.col(f"n_{lane}") < F.col("n"))


def free_numbers(used: DataFrame, number: str, wanted: int, most: int = 99_999) -> DataFrame:
    """The first `wanted` numbers from 1 that aren't used, with their names. Filling gaps comes first."""
    free = used.sparkSession.range(1, most + 1).toDF("number").join(used.select(F.col(number).cast("long").alias("number")).distinct(), "number", "left_anti")
    return free.orderBy("number").limit(wanted).withColumn("name", auto_name(F.col("number")))


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """The newest row of each key: insert or replace."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("n = 1").drop("n")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with rows replaced, and rows added, by changes (one per key)."""
    return base.join(changes, key, "left_anti").unionByName(changes, allowMissingColumns=True)


def fold_actions(actions: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """State of every key after its actions: for each column the last action that sets it (its expression isn't null)."""
    last = {name: F.max_by(value, F.when(value.isNotNull(), F.col(order))) for name, value in columns.items()}
    return actions.groupBy(key).agg(F.count("*").alias("actions"), *(c.alias(n) for n, c in last.items()))


def rename_chain(names: Column, renames: list[tuple[str, str]]) -> Column:
    """Merges and renames in their order: each acts on what a name is by then."""
    for old, new in renames:
        names = F.when(names == old, F.lit(new)).otherwise(names)
    return names


def first_match(left: DataFrame, left_id: str, left_keys: list[str], right: DataFrame, right_order: str, right_keys: list[str], value: str) -> DataFrame:
    """For each left row the value of the first right row found by its keys, tried in order.

    All right keys share one space of values, so any left key may meet any right one; a value stands for the first right row that has it.
    Rows that ask for a frequent value stay where they are (spread.join_counted).
    """
    spots = right.select(F.col(right_order).alias("o"), F.col(value).alias("found"), F.posexplode(F.array(*(F.lower(F.trim(F.col(k).cast("string"))) for k in right_keys))).alias("k", "v")).where("v <> ''")
    lookup = spots.groupBy("v").agg(F.min_by("found", F.struct("o", "k")).alias("found"), F.lit(True).alias("hit"))
    asked = left.select(left_id, F.posexplode(F.array(*(F.lower(F.trim(F.col(k).cast("string"))) for k in left_keys))).alias("k", "v")).where("v <> ''")
    hits = join_counted(asked, lookup, ["v"], [left_id]).where("hit").groupBy(left_id).agg(F.min_by("found", "k").alias(value), F.min("k").alias("by_key"))
    return left.select(left_id).join(hits, left_id, "left")


def assign_in_order(vectors: DataFrame, threshold: float) -> DataFrame:
    """Identities given one after another (id, vec): the best earlier vector's if similar enough (ties: the earliest), else the next number.

    Which earlier vector a vector follows doesn't depend on the names given so far. So everything points at its best
    predecessor, a tree of these is an identity, and its root, the smallest id in it, is where the number was given out.
    """
    best = best_before(vectors, threshold)
    follows = best.where(F.col("match").isNotNull()).select(F.col("id").alias("a"), F.col("match").alias("b"))
    roots = components(vectors.select("id"), follows)
    numbers = numbered(roots.where("id = root").select("root"), ["root"], "identity")
    return roots.join(numbers, "root").select("id", "identity")


def assign_against_store(rows: DataFrame, threshold: float, version: str, excluded: tuple[str, ...] = ("multibird", "low_quality", "false_positive", "junk")) -> DataFrame:
    """Identities of new rows, one after another by id, against a store of earlier vectors and the new rows before them.

    rows: id, vec, identity (of stored rows, which come before the new ones; null for new rows), version, status. Rows of
    other versions take no part, nor do stored ones of an excluded status. Gives id, identity, decision (match or new),
    score (of the best earlier vector, null without one) and match (that vector, if it is similar enough). New names fill the
    smallest numbers that no identity of rows has; an error if none is left.
    """
    stored = F.col("identity").isNotNull()
    part = cut(rows.where((F.col("version") == version) & ~(stored & F.coalesce("status", F.lit("")).isin(*excluded))).select("id", "vec", "identity"))
    new = part.where("identity is null").select("id")
    best = cut(best_before(part.select("id", "vec"), threshold, asked=new))  # for the roots, and for what is given back
    roots = components(part.select("id"), best.where("match is not null").select(F.col("id").alias("a"), F.col("match").alias("b")))
    given = part.where("identity is not null").select(F.col("id").alias("root"), "identity")
    fresh = numbered(new.join(roots.where("id = root").select("id"), "id"), ["id"], "place")
    wanted = fresh.count()
    free = free_numbers(rows.select(auto_number(F.col("identity")).alias("n")).where("n is not null"), "n", wanted)
    names = numbered(free.select("number", "name"), ["number"], "place").select("place", F.col("name").alias("identity"))
    if names.count() < wanted:
        raise ValueError("no free number is left")
    named = given.union(fresh.join(names, "place").select(F.col("id").alias("root"), "identity"))
    return best.join(roots, "id").join(named, "root").select("id", "identity", "decision", F.col("cosine").alias("score"), "match")
