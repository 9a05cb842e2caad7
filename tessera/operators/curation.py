"""Review decisions as changes of tables: every change takes rows and gives rows, and says what it did in an action row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.clean import auto_number, blank_to_null

#: States that take a row out of the raw lane.
LANES = ("sandbox", "active", "false_positive", "junk", "low_quality", "multibird", "ai_suspicious")


def counted(status: Column, excluded: tuple[str, ...]) -> Column:
    """Whether a row takes part: an unknown status does."""
    return ~F.coalesce(status, F.lit("")).isin(*excluded)


def lane(status: Column) -> Column:
    return F.when(status == "sandbox", "sandbox").when(status == "active", "true_names").when(status.isNull() | ~status.isin(*LANES), "raw")


def moved(df: DataFrame, chosen: Column, identity: str, status: str = "provisional", review: str = "auto") -> DataFrame:
    """Chosen rows under another identity, with a state of their own (identity, identity_status, review_status)."""
    put = lambda name, value: F.when(chosen, F.lit(value)).otherwise(F.col(name))
    return df.withColumns({"identity": put("identity", identity), "identity_status": put("identity_status", status), "review_status": put("review_status", review)})


def marked(df: DataFrame, chosen: Column, status: str, label: str = "", note: str = "") -> DataFrame:
    """Chosen rows with a status and a label; a blank note leaves the old one."""
    notes = F.when(chosen & F.lit(note != ""), F.lit(note)).otherwise(F.col("notes"))
    put = lambda name, value: F.when(chosen, F.lit(value)).otherwise(F.col(name))
    return df.withColumns({"identity_status": put("identity_status", status), "training_label": put("training_label", label), "notes": notes})


def reset_to_raw(df: DataFrame, chosen: Column, lane_name: str) -> DataFrame:
    """Chosen rows as they came in, with a note of where they were; it follows an older note after a semicolon."""
    said = F.lit(f"returned to raw from {lane_name}")
    notes = F.concat_ws("; ", F.nullif(F.col("notes"), F.lit("")), said)
    put = lambda name, value: F.when(chosen, value).otherwise(F.col(name))
    states = {"identity_status": F.lit("provisional"), "review_status": F.lit("auto"), "training_label": F.lit(""), "notes": notes}
    return df.withColumns({name: put(name, value) for name, value in states.items()})


def deleted(tables: list[DataFrame], key: str, gone: DataFrame) -> list[DataFrame]:
    """The tables without the keys of `gone`."""
    keys = gone.select(key).distinct()
    return [t.join(keys, key, "left_anti") for t in tables]


def settle_new(df: DataFrame, now: Column) -> DataFrame:
    """New rows (or such without review status) become automatic ones; what they lack is filled, what they have stays."""
    new = F.coalesce(F.col("review_status"), F.lit("new")) == "new"
    put = lambda name, value: F.when(new, value).otherwise(F.col(name))
    filled = {"identity_status": F.coalesce(blank_to_null(F.col("identity_status")), F.lit("provisional")), "reviewed_at": F.coalesce(F.col("reviewed_at"), now)}
    return df.withColumns({name: put(name, value) for name, value in (filled | {"review_status": F.lit("auto")}).items()})


def listing_order(identity: str, status: str, score: str, path: str) -> list[Column]:
    """Identity; several birds, low quality, others, false positives; least score first, none last; path."""
    s = F.col(status)
    place = F.when(s == "multibird", 0).when(s == "low_quality", 1).when(s == "false_positive", 3).otherwise(2)
    return [F.col(identity), place, F.coalesce(F.col(score), F.lit(999.0)), F.col(path)]


def natural_order(name: Column) -> list[Column]:
    """Numbered names by number, then all others by lower-cased text, then by the name itself."""
    number = auto_number(F.trim(name))
    return [number.isNull(), number, F.lower(F.trim(name)), name]


def training_gate(label: Column, premium: Column, path: Column, points: list[Column], wanted: str) -> Column:
    """Why a row may not train (the first reason), else null. Negative coordinates are missing ones."""
    reason = F.when(F.coalesce(label, F.lit("")) != wanted, "label").when(~F.coalesce(premium, F.lit(False)), "not_premium")
    missing = F.lit(False)
    for p in points:
        missing = missing | F.coalesce(p < 0, F.lit(True))
    return reason.when(blank_to_null(path).isNull(), "no_path").when(missing, "coordinates")


def last_with_backup(actions: DataFrame, order: str, action: str, backup: str, most: int = 50) -> DataFrame:
    """The newest of the last `most` actions that is no undoing and has a backup."""
    recent = actions.orderBy(F.col(order).desc()).limit(most)
    name = F.coalesce(F.col(action), F.lit(""))
    usable = ~name.startswith("undo_") & ~name.startswith("pre_undo") & F.col(backup).isNotNull()
    return recent.where(usable).orderBy(F.col(order).desc()).limit(1)


def run_status(observations: DataFrame, state: str, recorded: Column, scale_ready: bool, validated: bool) -> DataFrame:
    """One row: counts, and what the run as a whole amounts to."""
    s = F.col(state)
    counts = observations.agg(F.count("*").alias("n"), F.count_if(recorded).alias("n_recorded"), F.count_if(s == "full").alias("n_full"), F.count_if(s == "partial").alias("n_partial"))
    scale = ("VALIDATED_SCALE" if validated else "PROVISIONAL_SCALE") if scale_ready else "UNCALIBRATED"
    status = (
        F.when(F.col("n") == 0, "FAIL_NO_OBSERVATIONS")
        .when(F.col("n_recorded") == 0, "FAIL_NO_RECORDED_OBSERVATIONS")
        .when(F.col("n_full") > 0, f"PASS_READY_{scale}")
        .when(F.col("n_partial") > 0, "PARTIAL_LOWER_BOUND_ONLY")
        .otherwise("PARTIAL_DIAGNOSTIC_ONLY")
    )
    return counts.withColumn("status", status)
