"""Exact quantiles and ordered distinct texts of groups of any size, with bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.clean import blank_to_null
from tessera.operators.numbering import cut

#: Values that one task may hold of a group, and bins that a range is cut into.
HELD, BINS = 100_000, 1024


def _even(v: Column) -> Column:
    """Half the value, so that no range overflows."""
    return v / 2


def _by_size(v: Column) -> Column:
    """A value by its order of magnitude, ascending: 745 is more than the logarithm of the smallest double falls below 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 745))


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """keys and one column per share: the quantile of the value (double) in the group, between two values in proportion; null without values.

    Groups of HELD values at most are sorted as they are. Of larger ones each rank asked for is closed in on: a pass counts values by bins
    of the range that the rank lies in (even ones, and ones by magnitude, by turns), goes on inside its bin, and ends when HELD values are left, which are sorted. So a task
    holds BINS counters, or HELD values, of a group, and what is broadcast is a row for each rank of a large group.
    """
    rows = df.select(*keys, value.cast("double").alias("__v")).where("__v is not null AND NOT isnan(__v)")
    sizes = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
    direct = lambda df: df.groupBy(*keys).agg(*(F.percentile("__v", s).alias(name) for name, s in shares.items()))
    large = sizes.where(F.col("__n") > HELD)
    if large.isEmpty():
        return direct(rows)
    same = [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys]
    marks = large.select(*(F.col(k).alias(f"__key_{k}") for k in keys))
    small = direct(rows.join(F.broadcast(marks), same, "left_anti"))  # at most one row to HELD values
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(s * (F.col("__n") - 1)), F.ceil(s * (F.col("__n") - 1))) for s in shares.values()))))
    spans = cut(large.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.explode(ranks).alias("__rank"), F.lit(0).cast("long").alias("__below"), "__low", "__high", F.col("__n").alias("__held")))
    names = [*(f"__key_{k}" for k in keys), "__rank"]
    turn = 0
    while not (wide := spans.where(f"__held > {HELD} AND __low < __high")).isEmpty():
        inside = rows.join(F.broadcast(wide), [*same, F.col("__v").between(F.col("__low"), F.col("__high"))])
        v, low, high = (_even(F.col(c)) if turn % 2 == 0 else _by_size(F.col(c)) for c in ("__v", "__low", "__high"))
        bin_ = F.when(high > low, F.least(F.floor((v - low) / (high - low) * BINS), F.lit(BINS - 1))).otherwise(0)
        turn += 1
        counts = inside.groupBy(*names, "__below", bin_.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
        upto = F.sum("__c").over(W.partitionBy(*names).orderBy("__bin"))  # BINS rows
        found = counts.withColumn("__upto", F.col("__below") + upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
        closer = found.select(*names, (F.col("__upto") - F.col("__c")).alias("__below"), "__low", "__high", F.col("__c").alias("__held"))
        spans = cut(spans.where(f"NOT (__held > {HELD} AND __low < __high)").unionByName(closer))
    settled = spans.where("__low = __high").select(*names, F.col("__low").alias("__at"))
    left = rows.join(F.broadcast(spans.where("__low < __high")), [*same, F.col("__v").between(F.col("__low"), F.col("__high"))])
    sorted_ = left.groupBy(*names, "__below").agg(F.sort_array(F.collect_list("__v")).alias("__vs"))  # HELD values
    at = settled.unionByName(sorted_.select(*names, F.get("__vs", (F.col("__rank") - F.col("__below")).cast("int")).alias("__at")))
    by_rank = at.groupBy(*(f"__key_{k}" for k in keys)).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__at"))).alias("__m"))
    spot = lambda s: s * (F.col("__n") - 1)
    value_at = lambda k: F.element_at("__m", k.cast("long"))
    between = lambda s: F.when(F.ceil(spot(s)) == F.floor(spot(s)), value_at(F.floor(spot(s)))).otherwise((F.ceil(spot(s)) - spot(s)) * value_at(F.floor(spot(s))) + (spot(s) - F.floor(spot(s))) * value_at(F.ceil(spot(s))))
    big = large.join(F.broadcast(by_rank), same).select(*keys, *(between(s).alias(name) for name, s in shares.items()))
    return small.unionByName(big)


def first_distinct(df: DataFrame, key: str, value: Column, order: Column, most: int = 12) -> DataFrame:
    """key and texts: the first `most` distinct filled texts of each key in the order given, joined by semicolons.

    A task sums up each text to its first place; of a key only the first `most` places go on to the task that joins them.
    """
    texts = df.select(key, blank_to_null(value).alias("__t"), order.alias("__o")).where("__t is not null").groupBy(key, "__t").agg(F.min("__o").alias("__o"))
    place = F.row_number().over(W.partitionBy(key).orderBy("__o", "__t"))
    few = texts.withColumn("__n", place).where(F.col("__n") <= most)  # Spark cuts such ranks off before the shuffle, too
    joined = few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__t"))), lambda p: p["__t"]), ";").alias("texts"))
    return df.select(key).distinct().join(joined, key, "left").select(key, F.coalesce("texts", F.lit("")).alias("texts"))


def with_quantiles(grouped: DataFrame, quantiles: DataFrame, keys: list[str]) -> DataFrame:
    """grouped with its groups' quantiles; groups may be many, and null is a key like any other."""
    named = quantiles.toDF(*(f"__{k}" if k in keys else k for k in quantiles.columns))
    return grouped.join(named, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*(f"__{k}" for k in keys))
