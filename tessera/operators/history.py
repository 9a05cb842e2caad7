"""Changes of identities that leave a trace: every change gives the new rows, a history row for each row changed, and one action row.

Rows have id, crop_path, identity, identity_status, review_status and reviewed_at; other columns stay as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.clean import auto_name, auto_number, blank_to_null
from tessera.operators.identity import free_numbers
from tessera.operators.numbering import numbered


class Change(NamedTuple):
    rows: DataFrame
    history: DataFrame
    action: DataFrame


def _change(rows: DataFrame, chosen: Column, identity: str, action: str, source: str, at: str) -> Change:
    hit = F.coalesce(chosen, F.lit(False))
    changed = rows.where(hit)
    history = changed.select(F.lit(at).alias("at"), F.col("id").alias("crop_id"), "crop_path", F.col("identity").alias("old_identity"), F.lit(identity).alias("new_identity"), F.lit(action).alias("action"))
    counted = changed.agg(F.count("*").alias("crops")).select(F.lit(at).alias("at"), F.lit(action).alias("action"), F.lit(source).alias("source"), F.lit(identity).alias("target"), "crops")
    return Change(rows.withColumn("identity", F.when(hit, F.lit(identity)).otherwise(F.col("identity"))), history, counted)


def merged(rows: DataFrame, source: str, target: str, at: str, group: str = "multibird") -> Change:
    """All rows of one identity under another. The group of several animals stays, and nothing is merged with itself: no history, no action."""
    if source in (target, group):
        nothing = _change(rows, F.lit(False), target, "merge_identity", source, at)
        return nothing._replace(rows=rows, action=nothing.action.limit(0))
    return _change(rows, F.col("identity") == source, target, "merge_identity", source, at)


def renamed(rows: DataFrame, source: str, target: str, at: str, group: str = "multibird") -> Change:
    """An identity under a new name; an error if the name is blank or taken, or for the group. Unknown identities leave no trace."""
    target = target.strip()
    if source == group or not target:
        raise ValueError("the group of several animals keeps its name" if source == group else "a name can't be blank")
    if target == group or not rows.where(F.col("identity") == target).isEmpty():
        raise ValueError(f"{target} exists")
    change = _change(rows, F.col("identity") == source, target, "name_identity_profile", source, at)
    return change._replace(action=change.action.where("crops > 0"))


def autonamed(rows: DataFrame, at: str, status: str = "provisional", review: str = "auto", partly: bool = False) -> DataFrame:
    """Rows without an identity, in order of id, get the free names from the smallest number on; a review time that is there stays.

    Names differ from row to row. If there are fewer free numbers than rows: an error, or partly: the first rows get
    them, and the others stay as they are, waiting for a name.
    """
    blank = blank_to_null(F.col("identity")).isNull()
    waiting = numbered(rows.where(blank).select("id"), ["id"], "place")
    wanted = waiting.count()
    free = free_numbers(rows.select(auto_number(F.col("identity")).alias("n")).where("n is not null"), "n", wanted)
    names = numbered(free.select("number"), ["number"], "place").select("place", auto_name(F.col("number")).alias("given"))
    if not partly and names.count() < wanted:
        raise ValueError("no free number is left")
    given = waiting.join(names, "place").select("id", "given")
    put = lambda name, value: F.when(F.col("given").isNotNull(), value).otherwise(F.col(name))
    states = {"identity": put("identity", F.col("given")), "identity_status": put("identity_status", F.lit(status)), "review_status": put("review_status", F.lit(review)), "reviewed_at": put("reviewed_at", F.coalesce("reviewed_at", F.lit(at)))}
    return rows.join(given, "id", "left").withColumns(states).drop("given")


def called(name: str) -> Column:
    """Whether a row of the older layout goes by a name: its own, the individual's, or the one shown (the individual's if filled, else its own)."""
    own, individual = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "individual_name"))
    return (own == name) | (individual == name) | (F.coalesce(F.nullif(individual, F.lit("")), own) == name)


def updated(rows: DataFrame, old: str, at: str, name: str | None = None, status: str | None = None, label: str | None = None, review: str | None = None, note: str | None = None) -> DataFrame:
    """Rows called `old` with what is given: both names, status, label, review state; a note follows the older ones in its brackets of time."""
    told = F.trim(F.concat(F.coalesce("cleanup_notes", F.lit("")), F.lit(f" [{at}] {note}")))
    given = {"individual_name": name, "name": name, "identity_status": status, "training_label": label, "review_status": review}
    new = {c: F.lit(v) for c, v in given.items() if v is not None} | ({"cleanup_notes": told} if note is not None else {}) | {"reviewed_at": F.coalesce("reviewed_at", F.lit(at))}
    hit = called(old)
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})


def rejected_for_training(rows: DataFrame, status: str = "false_positive") -> DataFrame:
    """Rows that teach what is no animal: by status, or by any training label."""
    return rows.where((F.coalesce("identity_status", F.lit("")) == status) | (F.coalesce("training_label", F.lit("")) != ""))


def known_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Ids of the rows whose crop_path is among the paths."""
    return rows.join(paths.select("crop_path").distinct(), "crop_path", "left_semi").select("id")
