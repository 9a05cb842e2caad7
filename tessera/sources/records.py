"""Records in JSON documents of several layouts: lists, envelopes and maps from paths, and the trainer's rows from three layouts of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.clean import TRUE_WORDS, to_number
from tessera.operators.numbering import numbered
from tessera.operators.spread import join_counted

# Under which keys the records of a kind of document are looked for, in this order.
ENVELOPES = {"trainer": ("rows",), "sampler": ("records", "rows", "candidates"), "assistant": ("predictions", "rows", "records", "items"), "species": ("predictions", "outputs", "images", "results", "detections")}
#: Kinds whose empty envelope gives way to the next one, and kinds whose envelope, or whole document, may map paths to records.
GIVING_WAY, MAPPED = ("sampler", "assistant"), ("species",)


def _kind(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _listed(v: Column) -> Column:
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("record")))


def _mapped(v: Column) -> Column:
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string, variant>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("record")))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then of a value that is worked out once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def json_records(document: Column, kind: str) -> Column:
    """Records (array of n, key and variant) of JSON text: a list's objects, else those of the first envelope of its kind, else of a map from paths.

    key is the path only where the whole document maps paths to records (all its values are objects). Elements that are no objects are left out,
    but keep their places: n counts all. No JSON, or no records in it, gives an empty array.
    """
    unnamed = lambda entries: F.transform(entries, lambda e: F.struct(F.lit(None).cast("string").alias("key"), e["record"].alias("record")))

    def inside(v: Column) -> Column:
        found = F.when(_kind(v, "ARRAY"), _listed(v))
        if kind in GIVING_WAY:
            return _let(found, lambda f: F.when(F.size(f) > 0, f))
        return F.coalesce(found, F.when(_kind(v, "OBJECT"), unnamed(_mapped(v)))) if kind in MAPPED else found

    def of_object(whole: Column) -> Column:
        tries = [_let(F.try_variant_get(whole, f"$.{name}", "variant"), inside) for name in ENVELOPES[kind]]
        if kind in MAPPED:
            tries.append(_let(_mapped(whole), lambda entries: F.when(F.forall(entries, lambda e: _kind(e["record"], "OBJECT")), entries)))
        return F.coalesce(*tries)

    all_of = _let(F.try_parse_json(document), lambda whole: F.when(_kind(whole, "ARRAY"), _listed(whole)).when(_kind(whole, "OBJECT"), of_object(whole)))
    placed = F.transform(all_of, lambda e, n: F.struct(n.cast("long").alias("n"), e["key"].alias("key"), e["record"].alias("record")))
    return F.coalesce(F.filter(placed, lambda e: _kind(e["record"], "OBJECT")), F.array().cast("array<struct<n: bigint, key: string, record: variant>>"))


def read_records(spark: SparkSession, path: str, kind: str, one_value: bool = True) -> DataFrame:
    """(file, n, key, record) of JSON files. one_value: a file is one document; else each line is one, and files are split."""
    raw = spark.read.option("wholetext", one_value).text(path).select(F.col("_metadata.file_path").alias("file"), F.inline(json_records(F.regexp_replace("value", "^﻿", ""), kind)))
    return raw


# Fields of a trainer's row, in their order, and the label that trains.
TRAINER_FIELDS = (
    "created_at", "updated_at", "image_path", "image_index", "source_row_index", "source_video_key", "frame_number", "time_sec", "sequence_id", "sequence_position", "neighbor_count", "best_bill_frame",
    "mmpose_bill_base_x", "mmpose_bill_base_y", "mmpose_bill_base_score", "gpt_label", "gpt_bill_base_x", "gpt_bill_base_y", "gpt_bill_tip_x", "gpt_bill_tip_y", "gpt_gorget_x", "gpt_gorget_y", "gpt_confidence", "gpt_reject_reason", "gpt_notes", "gpt_imported_at", "gpt_accepted",
    "corrected_bill_base_x", "corrected_bill_base_y", "clicked_tip_x", "clicked_tip_y", "corrected_bill_length_px", "corrected_bill_angle_deg", "label", "training_use", "is_premium_training_row",
    "old_v01_accepted", "old_v01_bill_length_px", "old_v01_bill_angle_deg", "old_v01_nearest_candidate_method", "old_v01_nearest_candidate_distance_px", "notes",
)
LABEL_VALID = "valid_full_bill_side_view"
NEWER_KEYS = ("mmpose_bill_base_x", "corrected_bill_base_x", "label")
CROP_ONLY_NOTE = "imported crop; no mmpose base"
#: Types of the fields that are no text, and what stands where a value is missing.
KINDS = dict.fromkeys(TRAINER_FIELDS, "string") | {f: "double" for f in TRAINER_FIELDS if f.endswith(("_x", "_y", "_px", "_deg", "_score", "_sec"))}
KINDS |= dict.fromkeys(("image_index", "source_row_index", "frame_number", "sequence_position", "neighbor_count"), "long") | dict.fromkeys(("best_bill_frame", "gpt_accepted", "is_premium_training_row", "old_v01_accepted"), "boolean")
DEFAULTS = {"string": "", "double": -1.0, "long": -1, "boolean": False}
#: Where a newer row takes a field from if it lacks the field's own key; what an older row calls its fields.
OTHER_KEYS = {"mmpose_bill_base_x": "bill_base_x", "mmpose_bill_base_y": "bill_base_y", "mmpose_bill_base_score": "bill_base_score", "gpt_bill_tip_x": "gpt_tip_x", "gpt_bill_tip_y": "gpt_tip_y"}
OLDER_KEYS = {
    "created_at": "created_at", "image_path": "image_path", "image_index": "image_index", "mmpose_bill_base_x": "bill_base_x", "mmpose_bill_base_y": "bill_base_y", "mmpose_bill_base_score": "bill_base_score", "clicked_tip_x": "clicked_tip_x", "clicked_tip_y": "clicked_tip_y",
    "old_v01_accepted": "accepted", "old_v01_bill_length_px": "bill_length_px", "old_v01_bill_angle_deg": "bill_angle_deg", "old_v01_nearest_candidate_method": "nearest_candidate_method", "old_v01_nearest_candidate_distance_px": "nearest_candidate_distance_px", "notes": "notes",
}
#: Fields that are made of others, never read.
MADE = ("corrected_bill_length_px", "corrected_bill_angle_deg", "training_use", "is_premium_training_row")
SAMPLER_KEYS = {"image_path": ("candidate_path", "image_path"), "image_index": ("evidence_rank",), "source_video_key": ("source_key", "source_video_key"), "frame_number": ("frame_number",), "time_sec": ("time_sec",), "sequence_id": ("sequence_id", "source_key"), "neighbor_count": ("neighbor_count",)}


def _there(record: Column, key: str) -> Column:
    """Whether an object has a key, be its value null."""
    return F.try_variant_get(record, f"$.{key}", "variant").isNotNull()


def _read(record: Column, keys: Iterable[str]) -> Column:
    """A record's values under some keys, each read once: whether it is there, as text, and whether it is written as text."""
    told = lambda v: F.struct(v.isNotNull().alias("there"), F.try_variant_get(v, "$", "string").alias("text"), _kind(v, "STRING").alias("quoted"))
    return F.struct(*(_let(F.try_variant_get(record, f"$.{k}", "variant"), told).alias(k) for k in dict.fromkeys(keys)))


def _text(r: Column, key: str) -> Column:
    """A value read as text; false, zero and what is empty are blank unless they are written as text."""
    text = r[key]["text"]
    return F.when(r[key]["quoted"] | ~text.rlike(r"^(-?0(\.0*)?|false|\[\]|\{\})$"), F.nullif(text, F.lit("")))


def _typed(r: Column, field: str, key: str) -> Column:
    """A field's value by its kind, from what was read under the key, null where the kind's default stands."""
    raw, kind = r[key]["text"], KINDS[field]
    if kind == "boolean":
        return F.lower(F.trim(raw)).isin(*TRUE_WORDS)
    return _text(r, key) if kind == "string" else to_number(raw).try_cast("long") if kind == "long" else to_number(raw, infinite=True)


def _older(r: Column) -> dict[str, Column]:
    """Corrected bases are never filled from an older row's; its tip is shown only if the row was accepted and the tip is whole."""
    out = {f: _typed(r, f, k) for f, k in OLDER_KEYS.items()}
    shown = out["old_v01_accepted"] & (out["clicked_tip_x"] >= 0) & (out["clicked_tip_y"] >= 0)
    return out | {f: F.when(shown, out[f]) for f in ("clicked_tip_x", "clicked_tip_y")}


def _newer(r: Column) -> dict[str, Column]:
    """A field's own key counts if it is there, be it blank; without it the other key."""
    own = {f: _typed(r, f, f) for f in TRAINER_FIELDS if f not in MADE}
    return own | {f: F.when(r[f]["there"], own[f]).otherwise(_typed(r, f, k)) for f, k in OTHER_KEYS.items()}


def _sampled(r: Column) -> dict[str, Column]:
    """Bases that a sampler wrote are not trusted."""
    out = {f: F.coalesce(*(_typed(r, f, k) for k in keys)) for f, keys in SAMPLER_KEYS.items()}
    said = lambda k: F.coalesce(r[k]["text"], F.when(r[k]["there"], "None"), F.lit(""))
    note = F.concat(F.lit("sampler manifest import; bucket="), said("evidence_bucket"), F.lit("; rank="), said("evidence_rank"), F.lit("; score="), said("identity_evidence_score"))
    return out | {"best_bill_frame": F.lower(_text(r, "evidence_bucket")) == "best", "notes": note}


def _row(df: DataFrame, record: Column, layouts: dict[str, tuple[list[str], Callable[[Column], dict[str, Column]]]], carried: list[str], now: str) -> DataFrame:
    """One schema from the layouts: a field is its layout's value, else its kind's default; identity from the image's name and status from points and label are filled in.

    A layout is its keys, which are read once each, and what makes fields of them; without keys it gets the record as it is.
    The fields are read inside of one lambda: as columns of their own they would outgrow what Spark compiles into one class.
    """
    def filled(layout: Callable[[Column], dict[str, Column]]) -> Callable[[Column], Column]:
        def fields(r: Column) -> Column:
            found = layout(r)
            return F.struct(*(F.coalesce(*([found[f]] if f in found else []), F.lit(DEFAULTS[KINDS[f]])).cast(KINDS[f]).alias(f) for f in TRAINER_FIELDS))

        return fields

    def whole_row(r: Column) -> Column:
        made = [(F.col("layout") == name, _let(_read(r, keys) if keys else r, filled(layout))) for name, (keys, layout) in layouts.items()]
        return reduce(lambda out, x: out.when(*x), made[1:], F.when(*made[0]))

    out = df.select(*carried, "n", "layout", _let(record, whole_row).alias("__row")).select(*carried, "n", "layout", "__row.*")
    path = F.col("image_path")
    told = names.crop_name(path)
    bx, by, tx, ty = (F.col(c) for c in ("corrected_bill_base_x", "corrected_bill_base_y", "clicked_tip_x", "clicked_tip_y"))
    whole = (bx >= 0) & (by >= 0) & (tx >= 0) & (ty >= 0)
    default = lambda c, other: F.when(c == "", other).otherwise(c)
    out = out.withColumns({
        "created_at": default(F.col("created_at"), F.lit(now)), "source_video_key": default(F.col("source_video_key"), default(F.coalesce(told["source"], F.lit("")), F.lit("."))), "source_row_index": F.when(F.col("source_row_index") < 0, F.col("n")).otherwise(F.col("source_row_index")),
        "image_index": F.when(F.col("image_index") < 0, F.col("n")).otherwise(F.col("image_index")), "frame_number": F.when(F.col("frame_number") < 0, told["frame"]).otherwise(F.col("frame_number")), "time_sec": F.when(F.col("time_sec") < 0, told["seconds"]).otherwise(F.col("time_sec")),
        "neighbor_count": F.greatest("neighbor_count", F.lit(0)), "corrected_bill_length_px": F.when(whole, F.hypot(tx - bx, ty - by)).otherwise(-1.0), "corrected_bill_angle_deg": F.when(whole, F.degrees(F.atan2(ty - by, tx - bx))).otherwise(-1.0),
    })
    best = (F.col("label") == LABEL_VALID) & (F.col("corrected_bill_length_px") > 0)
    use = F.when(best, "bill_base_and_tip").when(F.col("label") != "", "exclude").otherwise("unreviewed")
    return out.withColumns({"is_premium_training_row": best, "training_use": use}).select(*carried, "layout", *TRAINER_FIELDS)


def trainer_rows(records: DataFrame, carried: list[str], now: str) -> DataFrame:
    """carried columns, layout and TRAINER_FIELDS of each record (n, record): newer rows are those with one of NEWER_KEYS, all others older.

    Numbers that can't be read are -1, as are missing ones; negative indexes count as missing. now stands where a row has no created_at.
    """
    r = F.col("record")
    newer = _there(r, NEWER_KEYS[0]) | _there(r, NEWER_KEYS[1]) | _there(r, NEWER_KEYS[2])
    return _row(records.withColumn("layout", F.when(newer, "v02").otherwise("v01")), r, {"v01": ([*OLDER_KEYS.values()], _older), "v02": ([*(f for f in TRAINER_FIELDS if f not in MADE), *OTHER_KEYS.values()], _newer)}, carried, now)


def sampled_rows(records: DataFrame, document: str, now: str) -> DataFrame:
    """document (its column, filled), layout and TRAINER_FIELDS of a sampler's records; those without a path are left out.

    image_index counts a document's rows from 0 by rank (missing last), score down, source, frame, then place; documents of any size are numbered over all tasks.
    """
    r, sampler_keys = F.col("record"), [*(k for keys in SAMPLER_KEYS.values() for k in keys), "evidence_bucket", "identity_evidence_score"]
    df = records.withColumns({"layout": F.lit("sampler"), "__rank": F.coalesce(to_number(F.try_variant_get(r, "$.evidence_rank", "string")).try_cast("long"), F.lit(10**9)), "__score": F.coalesce(to_number(F.try_variant_get(r, "$.identity_evidence_score", "string"), infinite=True), F.lit(-1.0))})
    rows = _row(df.withColumn("__place", F.col("n")), r, {"sampler": (sampler_keys, _sampled)}, [document, "__place", "__rank", "__score"], now)
    kept = rows.where("image_path <> ''")
    placed = numbered(kept, [document, "__rank", F.col("__score").desc(), "source_video_key", "frame_number", "__place"], "__spot")
    starts = placed.groupBy(document).agg(F.min("__spot").alias("__first"))
    out = join_counted(placed, starts, [document], ["__spot"])
    return out.withColumn("image_index", F.col("__spot") - F.col("__first")).select(document, "layout", *TRAINER_FIELDS)


def image_rows(images: DataFrame, path: str, now: str) -> DataFrame:
    """layout and TRAINER_FIELDS of crops that come as image files alone, numbered from 0 by path; repeated paths count once."""
    listed = numbered(images.select(F.col(path).alias("__path")).where("__path is not null").distinct(), ["__path"], "__spot").withColumn("n", F.col("__spot") - 1)
    return _row(listed.withColumn("layout", F.lit("image")), F.col("__path"), {"image": ([], lambda path: {"image_path": path, "notes": F.lit(CROP_ONLY_NOTE)})}, [], now)
