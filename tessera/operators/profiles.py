"""Profiles of identities: visits, first and last sight, time spent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile_stats(df: DataFrame, name: str, event: str, seen: str, seconds: str) -> DataFrame:
    """Rows, distinct filled events (without any: rows), first and last time, and the sum, mean and maximum of durations."""
    events = F.countDistinct(F.nullif(F.trim(F.col(event).cast("string")), F.lit("")))
    return df.groupBy(name).agg(
        F.count("*").alias("n"), F.when(events > 0, events).otherwise(F.count("*")).alias("visits"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
        F.sum(seconds).alias("total_s"), F.avg(seconds).alias("mean_s"), F.max(seconds).alias("max_s"),
    )


def duration_text(seconds: Column) -> Column:
    """Below a minute seconds to one digit, from there whole minutes and seconds; TBD if unknown."""
    tie = seconds * 4 == F.floor(seconds * 4)  # only quarters are exact ties; those go to the even digit
    short = F.concat(F.when(tie, F.bround(seconds, 1)).otherwise(F.round(seconds, 1)).cast("string"), F.lit(" sec"))
    long = F.concat(F.floor(seconds / 60), F.lit(" min "), F.floor(seconds % 60), F.lit(" sec"))
    return F.when(seconds < 60, short).when(seconds >= 60, long).otherwise("TBD")


def flag_counts(df: DataFrame, flags: str) -> DataFrame:
    """How often each flag of a ;-joined list occurs."""
    return df.select(F.explode(F.split(flags, ";")).alias("flag")).where(F.trim("flag") != "").groupBy(F.trim("flag").alias("flag")).agg(F.count("*").alias("n"))


def inventory(df: DataFrame, by: list[str], size: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
