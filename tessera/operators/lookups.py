"""Lookups that take one of several rows: the last, the first by name or by place, the largest of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.clean import base_name
from tessera.operators.spread import join_counted


def with_last(left: DataFrame, right: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row of its key; none: null. Rows of left are neither lost nor multiplied."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("__last"))
    return left.join(last, key, "left").select(left.columns + [F.col(f"__last.{v}").alias(v) for v in values])


def by_name_or_place(staged: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """staged (place, path) with the value of the found row (place, path) of the same file name in any case, else of the same place.

    Of several found rows with one name the last counts; `matched` says which way a value came.
    """
    named = found.groupBy(base_name(F.col("path")).alias("name")).agg(F.max_by(value, "place").alias("by_name"), F.lit(True).alias("has_name"))
    placed = found.groupBy("place").agg(F.first(value).alias("by_place"), F.lit(True).alias("has_place"))
    both = staged.withColumn("name", base_name(F.col("path"))).join(named, "name", "left").join(placed, "place", "left")
    matched = F.when(F.col("has_name"), "name").when(F.col("has_place"), "place").otherwise("none")
    return both.select(*staged.columns, F.when(F.col("has_name"), F.col("by_name")).otherwise(F.col("by_place")).alias(value), matched.alias("matched"))


def largest_in_frame(boxes: DataFrame, frame: str, role: str, asked: str, other: str, area: str, ratio: float) -> DataFrame:
    """Rows of one role with the largest area of another role in their frame, and whether it dominates theirs."""
    most = boxes.where(F.col(role) == other).groupBy(frame).agg(F.max(area).alias("largest_other"))
    rows = boxes.where(F.col(role) == asked).join(most, frame, "left")
    return rows.withColumn("dominated", F.coalesce((F.col(area) > 0) & (F.col("largest_other") / F.greatest(F.lit(1.0), F.col(area)) >= ratio), F.lit(False)))


def by_any_key(rows: DataFrame, row_id: str, row_keys: list[str], found: DataFrame, found_order: str, found_keys: list[str], value: str) -> DataFrame:
    """rows with the value of the first found row that meets them under a kind of key; kinds are tried in their order, and each only meets its own kind."""
    kinds = lambda names: F.posexplode(F.array(*(F.nullif(F.lower(F.trim(F.col(n).cast("string"))), F.lit("")) for n in names)))
    has = found.select(F.col(found_order).alias("o"), F.col(value).alias("v"), kinds(found_keys).alias("kind", "k")).where("k is not null")
    first = has.groupBy("kind", "k").agg(F.min_by("v", "o").alias("v"))
    asks = rows.select(row_id, kinds(row_keys).alias("kind", "k"))
    hits = join_counted(asks.where("k is not null"), first.withColumn("hit", F.lit(True)), ["kind", "k"], [row_id]).where("hit").groupBy(row_id).agg(F.min_by("v", "kind").alias(value), F.min("kind").alias("kind"))
    return rows.select(row_id).join(hits, row_id, "left")
