"""Audits: every rule is a DataFrame of issues (rule, id, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.clean import to_flag, to_whole


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def issues(df: DataFrame, id_: Column, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row of df breaks (its expression is true)."""
    found = F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items()))  # array_compact would be a lambda: Spark interprets it with all rules inside
    return df.select(id_.alias("id"), F.explode(found).alias("rule")).where("rule is not null")


def box_rules() -> dict[str, Column]:
    """Of detector boxes (x1, y1, x2, y2, width, height, area): order, sides within 1.01 px, area within 2 px or 2 %."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = F.col("width") * F.col("height")
    return {
        "box_order": (w <= 0) | (h <= 0),
        "box_width": F.abs(w - F.col("width")) > 1.01,
        "box_height": F.abs(h - F.col("height")) > 1.01,
        "box_area": F.abs(F.col("area") - area) > F.greatest(F.lit(2.0), 0.02 * area),
    }


def verdict(all_issues: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, all_issues).agg(F.count("*").alias("n_issues")).withColumn("status", F.when(F.col("n_issues") == 0, "PASS").otherwise("FAIL"))


#: Codes that only warn.
WARNINGS = ("planned_expected_mismatch",)


def _coded(df: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    level = F.when(F.col("rule").isin(*WARNINGS), "warning").otherwise("error")
    found = issues(df, F.col(id_), {code: F.coalesce(broken, F.lit(False)) for code, broken in rules.items()})
    return found.select(level.alias("level"), F.col("rule").alias("code"), F.col("id").cast("string").alias("id"))


#: So many equal rows are listed at once.
AT_ONCE = 4096


def _times(df: DataFrame, n: str) -> DataFrame:
    """(level, code, id) as errors, n times each; of no row more than AT_ONCE are held at once."""
    lots = df.where(F.col(n) > 0).select("code", "id", F.col(n).alias("__n"), F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / AT_ONCE))).alias("__lot"))
    each = lots.select("code", "id", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE).cast("long"), F.col("__n") - F.col("__lot") * AT_ONCE))))
    return each.select(F.lit("error").alias("level"), "code", F.col("id").cast("string").alias("id"))


def sampling_issues(sequences: DataFrame, frames: DataFrame, extracted: DataFrame) -> DataFrame:
    """Issues (level, code, id) of sampled sequences, their frames and the frames extracted; all columns are manifest text, `row` numbers the rows.

    A row without an id, or whose numbers can't be read, breaks no further rule; of sequences with one id the last counts.
    Issues name the id, those of rows without one the row.
    """
    id_of = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    whole = lambda *names: {n: to_whole(F.col(n)) for n in names}
    named = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.concat(F.lit("row "), F.col("row").cast("string")))

    s = sequences.withColumns({"sequence_id": id_of("sequence_id")} | whole("start_frame_index", "end_frame_index", "anchor_frame_index", "sequence_frames_planned", "sequence_frame_count_expected", "sequence_frames_selected_for_extraction", "sequence_frames_written"))
    s = s.withColumn("who", named("sequence_id"))
    start, end, anchor, planned = (F.col(c) for c in ("start_frame_index", "end_frame_index", "anchor_frame_index", "sequence_frames_planned"))
    is_named = F.col("sequence_id") != ""
    read = start.isNotNull() & end.isNotNull() & anchor.isNotNull()
    written, selected = (F.coalesce(F.col(c), F.lit(0)) for c in ("sequence_frames_written", "sequence_frames_selected_for_extraction"))
    of_sequences = _coded(s, "who", {
        "blank_sequence_id": ~is_named,
        "sequence_numeric_parse_failed": is_named & ~read,
        "sequence_start_after_end": is_named & read & (start > end),
        "anchor_outside_sequence": is_named & read & ~anchor.between(start, end),
        "planned_expected_mismatch": is_named & read & (planned != F.col("sequence_frame_count_expected")),
        "sequence_written_exceeds_selected": is_named & read & (written > selected),
    })

    last = s.where(is_named).groupBy("sequence_id").agg(F.max_by(F.struct(start.alias("start"), end.alias("end"), planned.alias("planned")), "row").alias("sequence"))
    f = frames.withColumns({"frame_id": id_of("frame_id"), "sequence_id": id_of("sequence_id"), "output_frame_path": id_of("output_frame_path"), "frame_materialization_status": id_of("frame_materialization_status"), "chosen": to_flag(F.col("frame_selected_for_extraction"))} | whole("source_frame_index", "anchor_frame_index", "offset_from_anchor_frames"))
    frames_read = f
    f = f.withColumn("who", named("frame_id")).join(last, "sequence_id", "left")
    at, offset, low, high = F.col("source_frame_index"), F.col("offset_from_anchor_frames"), F.col("sequence.start"), F.col("sequence.end")
    has_id, linked = F.col("frame_id") != "", F.col("sequence").isNotNull()
    numbers = at.isNotNull() & anchor.isNotNull() & offset.isNotNull() & low.isNotNull() & high.isNotNull()
    fine, cached = has_id & linked & numbers, F.col("frame_materialization_status") == "written_debug_cache"
    of_frames = _coded(f, "who", {
        "blank_frame_id": ~has_id,
        "frame_missing_sequence": has_id & ~linked,
        "frame_numeric_parse_failed": has_id & linked & ~numbers,
        "frame_outside_sequence": fine & ~at.between(low, high),
        "offset_mismatch": fine & (at - anchor != offset),
        "written_frame_missing_output_path": fine & F.col("chosen") & cached & (F.col("output_frame_path") == ""),
        "unselected_frame_written": fine & ~F.col("chosen") & cached,
    })

    seen = frames_read.where(has_id).groupBy("sequence_id").agg(F.count("*").alias("seen"))
    counted = last.join(seen, "sequence_id", "left").where(F.col("sequence.planned") != F.coalesce("seen", F.lit(0)))
    of_counts = counted.select(F.lit("error").alias("level"), F.lit("sequence_frame_count_mismatch").alias("code"), F.col("sequence_id").alias("id"))

    x = extracted.withColumn("frame_id", id_of("frame_id"))
    blank = x.where(~has_id).select(F.lit("error").alias("level"), F.lit("blank_extracted_frame_id").alias("code"), named("frame_id").alias("id"))
    # Repeated ids, and those extracted that are in no frame, from one count of both tables' ids
    ids = frames_read.where(has_id).select("frame_id", F.lit(1).alias("in_f"), F.lit(0).alias("in_x")).union(x.where(has_id).select("frame_id", F.lit(0), F.lit(1)))
    counts = ids.groupBy("frame_id").agg(F.sum("in_f").alias("in_f"), F.sum("in_x").alias("in_x")).where("in_f > 1 or in_x > 1 or in_f = 0")
    in_f, in_x = F.col("in_f"), F.col("in_x")
    times = {"duplicate_frame_id": in_f - 1, "duplicate_extracted_frame_id": in_x - 1, "extracted_frame_not_in_sampled_frames": F.when(in_f == 0, in_x).otherwise(0)}
    of_ids = counts.select(F.col("frame_id").alias("id"), F.inline(F.array(*(F.struct(F.lit(code).alias("code"), n.cast("long").alias("n")) for code, n in times.items()))))
    again = duplicates(s.where(is_named), ["sequence_id"]).select(F.lit("duplicate_sequence_id").alias("code"), F.col("sequence_id").alias("id"), (F.col("copies") - 1).alias("n"))
    return reduce(DataFrame.unionByName, [of_sequences, of_frames, of_counts, blank, _times(of_ids, "n"), _times(again, "n")])
