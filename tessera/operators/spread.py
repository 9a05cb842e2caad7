"""Joins on keys that a large share of all rows may have: heavy keys are told by counts, and their rows stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.numbering import cut

#: A key is heavy if more than one row in so many has it.
HEAVY_SHARE = 1000


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names near the wanted ones that no column of df has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], n: str, spread: list[str]) -> DataFrame:
    """rows left-joined to a staged table with one row per key, whose column n tells how many rows have the key.

    Keys of more than one row in a thousand are a thousand at most, whatever the input: they are broadcast, and their rows stay
    where they are. All other keys are shuffled; rows already matched and those with a null key are spread by `spread`.
    """
    total, most = table.agg(F.sum(n), F.max(n)).first()
    limit = (total or 0) // HEAVY_SHARE
    values = [c for c in table.columns if c not in on and c != n]
    if (most or 0) <= limit:
        return rows.join(table.drop(n), on, "left")
    salt, mark, *names = free_names(rows, "salt", "heavy", *(f"heavy_{c}" for c in values), *(f"key_{c}" for c in on), *(f"late_{c}" for c in values))
    early, keys, late = names[: len(values)], names[len(values) : len(values) + len(on)], names[len(values) + len(on) :]
    heavy = table.where(F.col(n) > limit).select(*on, *(F.col(c).alias(e) for c, e in zip(values, early, strict=True)), F.lit(True).alias(mark))
    first = rows.join(F.broadcast(heavy), on, "left")  # at most HEAVY_SHARE rows
    alone = F.col(mark).isNotNull()
    for c in on:
        alone = alone | F.col(c).isNull()
    keyed = first.withColumns({k: F.when(~alone, F.col(c)) for k, c in zip(keys, on, strict=True)} | {salt: F.when(alone, F.pmod(F.xxhash64(*spread), F.lit(HEAVY_SHARE))).otherwise(F.lit(-1).cast("long"))})
    rest = table.where(F.col(n) <= limit).select(*(F.col(c).alias(k) for c, k in zip(on, keys, strict=True)), *(F.col(c).alias(e) for c, e in zip(values, late, strict=True)), F.when(F.col(n) <= limit, F.lit(-1).cast("long")).alias(salt))  # no literal: the optimiser would take it out of the keys
    return keyed.join(rest, [*keys, salt], "left").select(*rows.columns, *(F.coalesce(a, b).alias(c) for a, b, c in zip(early, late, values, strict=True)))


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """rows left-joined to a table with one row per key; how many rows have each key is counted first, by sums of each task."""
    asked = rows.groupBy(*on).agg(F.count("*").alias("__n"))
    return join_spread(rows, cut(table.join(asked, on)), on, "__n", spread)
