"""Observations of bill lengths: one row with all 85 fields for each smart-crop manifest row, and the row of aliases that profiles read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import clean, plane
from tessera.functions.ladders import likelihood_band
from tessera.operators.paths import tidy
from tessera.operators.spread import join_counted
from tessera.sources.settings import Calibration

# Names of an observation's fields, in their order, and what is carried over as it is.
FIELDS = (
    "metrics_schema_version", "metrics_decision", "metrics_note", "metric_input_index", "metric_family", "measurement_type", "measurement_method", "metric_observation_state", "metric_use_class", "length_px_role",
    "range_support_class", "metric_px_ready", "aggregation_eligible", "lower_bound_eligible", "autosort_feature_eligible", "metric_blockers", "metric_warnings", "metric_scale_ready", "metric_scale_state", "scale_source",
    "scale_confidence", "px_per_mm", "calibration_profile_path", "calibration_profile_name", "calibration_profile_status", "calibration_profile_units", "calibration_profile_has_front_px_per_mm", "calibration_profile_front_px_per_mm", "value_px", "value_px_recomputed",
    "value_px_recompute_delta", "value_px_visible_lower_bound", "value_px_for_range", "value_mm", "value_mm_visible_lower_bound", "value_mm_for_range", "length_axis_angle_deg", "point_bounds_state", "visibility_state", "whole_feature_visibility_state",
    "base_outside_raw_crop_px", "tip_outside_raw_crop_px", "visible_lower_bound_clip_x", "visible_lower_bound_clip_y", "visible_lower_bound_clip_t", "likelihood_quality_band", "min_point_likelihood", "base_x_raw_crop", "base_y_raw_crop", "base_likelihood",
    "tip_x_raw_crop", "tip_y_raw_crop", "tip_likelihood", "raw_crop_width_px", "raw_crop_height_px", "source_video", "frame_id", "source_frame_index", "camera_local_time_seconds", "detection_id",
    "raw_crop_path", "whole_candidate_crop_path", "head_bill_crop_path", "body_crop_path", "smart_cropper_decision", "smart_cropper_note", "metric_eligible_bill_length", "metric_eligibility_reason", "autosort_visual_ready", "autosort_metric_ready",
    "dlc_billtip_decision", "dlc_prediction_note", "dlc_h5_path", "dlc_row_index", "dlc_match_method", "dlc_bill_base_bodypart_used", "dlc_bill_tip_bodypart_used", "bill_tip_in_head_roi", "bill_base_in_head_roi", "retention_decision",
    "retention_score", "mmpose_ok", "pose_map_decision", "pose_handoff_decision", "notes",
)
CARRIED = FIELDS[FIELDS.index("source_video") :]
PATHS = ("raw_crop_path", "whole_candidate_crop_path", "head_bill_crop_path", "body_crop_path")
#: Digits behind the point in a manifest: 3 for pixels of points and crops, 9 for the scale, 6 for all else.
DIGITS = {"px_per_mm": 9} | dict.fromkeys(("base_x_raw_crop", "base_y_raw_crop", "tip_x_raw_crop", "tip_y_raw_crop", "raw_crop_width_px", "raw_crop_height_px"), 3)
#: Per state: class of use, role of the length, support of the range.
USES = {
    "full_length_px_ready": ("biometrics_candidate", "full_length_candidate", "range_candidate"),
    "partial_length_lower_bound": ("biometrics_lower_bound", "partial_length_lower_bound", "range_floor_support"),
    "diagnostic_predicted_extension": ("diagnostic_only", "diagnostic_predicted_extension", "diagnostic_only"),
    "rejected_geometry": ("reject", "rejected_geometry", "reject"),
}
#: Per place of the points: bounds, visibility, visibility of the whole.
BOUNDS = {
    "inside": ("inside_raw_crop_bounds", "whole_bill_points_inside_raw_crop", "bill_points_inside_raw_crop"),
    "tip": ("tip_outside_raw_crop_bounds", "partial_bill_tip_outside_raw_crop", "blocked_bill_tip_outside_raw_crop"),
    "base": ("base_outside_raw_crop_bounds", "partial_bill_base_outside_raw_crop", "blocked_bill_base_outside_raw_crop"),
    "points": ("points_outside_raw_crop_bounds", "points_outside_raw_crop", "blocked_points_outside_raw_crop"),
    "unknown": ("unknown_bounds_state", "unknown", "unknown"),
}
FULL, PARTIAL, EXTENSION, REJECTED = USES
NOTES = {PARTIAL: "partial bill lower-bound observation retained; not aggregation-ready", EXTENSION: "diagnostic predicted-extension observation retained; not biometrics-ready"}
#: A reported length may differ from the points' distance by so many pixels.
RECOMPUTE_TOLERANCE = 0.02


def _one_of(key: Column, table: dict[str, tuple[str, ...]], k: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for name, values in table.items() for x in (name, values[k]))), key)


def _missing_paths(rows: DataFrame, row_id: str, files: DataFrame) -> DataFrame:
    """Per row the blockers of its paths, in their order: missing if blank, unreadable if no file of the inventory has it. Paths many rows share are met where they are."""
    there = files.select(tidy(F.col("path")).alias("__c")).where("__c is not null").distinct().withColumn("__there", F.lit(True))
    path = lambda c: F.trim(F.col(c).cast("string"))
    each = F.array(*(F.struct(F.lit(k).alias("__k"), F.lit(c).alias("__field"), tidy(F.nullif(path(c), F.lit(""))).alias("__c")) for k, c in enumerate(PATHS)))
    met = join_counted(rows.select(row_id, F.inline(each)), there, ["__c"], [row_id])
    why = F.when(F.col("__c").isNull(), F.concat(F.lit("missing_path:"), "__field")).when(F.col("__there").isNull(), F.concat(F.lit("unreadable_path:"), "__field"))
    found = F.array_sort(F.collect_list(F.when(why.isNotNull(), F.struct("__k", why.alias("why")))))  # four at most
    return met.groupBy(row_id).agg(F.transform(found, lambda x: x["why"]).alias("__paths"))


def bill_length_observations(rows: DataFrame, row_id: str, files: DataFrame, scale: Calibration, profile: dict[str, object] | None = None, least_likelihood: float = 0.3) -> DataFrame:
    """row_id and the FIELDS, typed (manifest_text shows them as text); rows: smart-crop manifest as text, row_id unique and filled, files: the inventory (path).

    Columns that rows lack are blank; numbers that can't be read are missing. A length that differs from the points' distance by more than 0.02 px blocks.
    Any blocker rejects, but points that both lie outside stay diagnostic. profile: path, name, status, units and front_px_per_mm of the feeder's profile.
    """
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in {*CARRIED, "dlc_bill_length_px", "bill_axis_angle_deg", *(f"bill_{p}_{x}" for p in ("base", "tip") for x in ("x_raw_crop", "y_raw_crop", "likelihood"))} - set(rows.columns)})
    number = lambda c: clean.to_number(F.col(c).cast("string"))
    first = lambda *names: clean.first_filled(rows, list(names))[0]
    values = {
        "__w": clean.to_number(first("raw_crop_width_actual", "raw_crop_width")), "__h": clean.to_number(first("raw_crop_height_actual", "raw_crop_height")), "__bx": number("bill_base_x_raw_crop"), "__by": number("bill_base_y_raw_crop"),
        "__tx": number("bill_tip_x_raw_crop"), "__ty": number("bill_tip_y_raw_crop"), "__bp": number("bill_base_likelihood"), "__tp": number("bill_tip_likelihood"), "__told": number("dlc_bill_length_px"), "__angle": number("bill_axis_angle_deg"),
        "metric_input_index": F.coalesce(first("smart_cropper_input_index", "dlc_input_index"), F.col(row_id).cast("string")),
    }
    df = rows.join(_missing_paths(rows, row_id, files), row_id).withColumns(values)
    w, h, bx, by, tx, ty, bp, tp, told = (F.col(c) for c in ("__w", "__h", "__bx", "__by", "__tx", "__ty", "__bp", "__tp", "__told"))
    length, least = F.hypot(tx - bx, ty - by), F.when(bp.isNotNull() & tp.isNotNull(), F.least(bp, tp))
    df = df.withColumns({"__length": length, "__least": least, "__base": plane.inside(bx, by, w, h), "__tip": plane.inside(tx, ty, w, h), "__delta": F.abs(length - told)})
    length, least, base, tip = (F.col(c) for c in ("__length", "__least", "__base", "__tip"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    blockers = F.array_compact(F.array(
        F.when(length <= 0, "zero_length"), F.when(F.col("__delta") > RECOMPUTE_TOLERANCE, "length_recompute_mismatch"), F.when(no((w > 0) & (h > 0)), "invalid_raw_crop_dimensions"),
        F.when(bx.isNull() | by.isNull(), "missing_bill_base_xy"), F.when(tx.isNull() | ty.isNull(), "missing_bill_tip_xy"),
        F.when(least.isNull(), "missing_bill_point_likelihood").when(least < least_likelihood, "low_bill_point_likelihood"),
    ))
    clip = F.when(base & ~tip, plane.edge_met(bx, by, tx, ty, w, h)).when(~base & tip, plane.edge_met(tx, ty, bx, by, w, h))
    df = df.withColumns({"__blockers": F.concat("__paths", blockers), "__clip0": clip})
    place = F.when(base & tip, "inside").when(base & ~tip, "tip").when(~base & tip, "base").when(~base & ~tip, "points").otherwise("unknown")
    df = df.withColumns({"__place": place, "__free": F.size("__blockers") == 0})
    place, free = F.col("__place"), F.col("__free")
    state = F.when(place == "points", EXTENSION).when((place == "unknown") | ~free, REJECTED).when(place == "inside", FULL).when(F.col("__clip0").isNotNull(), PARTIAL).otherwise(EXTENSION)
    df = df.withColumn("metric_observation_state", state).withColumn("__clip", F.when(F.col("metric_observation_state") == PARTIAL, F.col("__clip0")))
    state, clip = F.col("metric_observation_state"), F.col("__clip")
    full, partial, rejected = state == FULL, state == PARTIAL, state == REJECTED
    no_edge = F.when(place.isin("tip", "base") & (state == EXTENSION), "_no_clip_intersection").otherwise("")
    warnings = F.array_distinct(F.array_compact(F.array(
        F.when(length.isNotNull() & told.isNull(), "missing_reported_length_px"), F.when(partial | (state == EXTENSION), F.concat(place, F.lit("_outside_raw_crop_bounds"), no_edge)),
        F.when(no(F.trim("smart_cropper_decision") == "smart_cropper_ready"), "smart_cropper_decision_not_ready"), F.when(~clean.to_flag(F.col("metric_eligible_bill_length").cast("string")), "smart_cropper_metric_eligible_bill_length_false"),
        F.lit(scale.state), *(F.lit(f"calibration:{text}") for text in scale.warnings),
    )))
    visible = F.when(clip.isNotNull(), F.least(clip["t"], F.lit(1.0)) * length)
    best = F.coalesce(F.nullif(length, F.lit(0.0)), told)
    for_range = F.when(full | (state == EXTENSION), best).when(partial, visible)
    ready, per_mm, feeder = scale.px_per_mm is not None, F.lit(scale.px_per_mm).cast("double"), profile or {}
    refused = F.concat(F.lit("metric observation rejected"), F.when(~free, F.concat(F.lit(": "), F.array_join("__blockers", ";"))).otherwise(""))
    note = F.when(full, "full bill length observation with scale" if ready else "full bill length px-ready observation; metric_scale_ready false").when(partial, NOTES[PARTIAL]).when(rejected, refused).otherwise(NOTES[EXTENSION])
    made = {
        "metrics_schema_version": F.lit("metrics_v0.7"), "metrics_decision": F.when(rejected, "metric_observation_rejected").otherwise("metric_observation_recorded"), "metrics_note": note, "metric_family": F.lit("length"), "measurement_type": F.lit("bill_length"),
        "measurement_method": F.lit("dlc_bill_base_to_bill_tip_px_from_smart_crop_manifest"), "metric_use_class": _one_of(state, USES, 0), "length_px_role": _one_of(state, USES, 1), "range_support_class": _one_of(state, USES, 2),
        "metric_px_ready": full, "aggregation_eligible": full, "lower_bound_eligible": partial, "autosort_feature_eligible": full | partial, "metric_blockers": F.array_join("__blockers", ";"), "metric_warnings": F.array_join(warnings, ";"),
        "metric_scale_ready": F.lit(ready), "metric_scale_state": F.lit(scale.state), "scale_source": F.lit(scale.source), "scale_confidence": F.lit(scale.confidence), "px_per_mm": per_mm,
        **{f"calibration_profile_{k}": F.lit(str(feeder.get(k) or "")) for k in ("path", "name", "status", "units")}, "calibration_profile_has_front_px_per_mm": F.lit((feeder.get("front_px_per_mm") or 0) > 0), "calibration_profile_front_px_per_mm": F.lit(feeder.get("front_px_per_mm")).cast("double"),
        "value_px": told, "value_px_recomputed": length, "value_px_recompute_delta": F.col("__delta"), "value_px_visible_lower_bound": visible, "value_px_for_range": for_range, "value_mm": plane.millimetres(F.when(full, best), per_mm),
        "value_mm_visible_lower_bound": plane.millimetres(visible, per_mm), "value_mm_for_range": plane.millimetres(for_range, per_mm), "length_axis_angle_deg": F.col("__angle"), "point_bounds_state": _one_of(place, BOUNDS, 0), "visibility_state": _one_of(place, BOUNDS, 1),
        "whole_feature_visibility_state": _one_of(place, BOUNDS, 2), "base_outside_raw_crop_px": plane.outside_by(bx, by, w, h), "tip_outside_raw_crop_px": plane.outside_by(tx, ty, w, h), "visible_lower_bound_clip_x": clip["x"], "visible_lower_bound_clip_y": clip["y"],
        "visible_lower_bound_clip_t": clip["t"], "likelihood_quality_band": likelihood_band(least, least_likelihood), "min_point_likelihood": least, "base_x_raw_crop": bx, "base_y_raw_crop": by, "base_likelihood": bp, "tip_x_raw_crop": tx, "tip_y_raw_crop": ty, "tip_likelihood": tp,
        "raw_crop_width_px": w, "raw_crop_height_px": h,
    }
    carried = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CARRIED}
    return df.select(row_id, *((made | carried).get(c, F.col(c)).alias(c) for c in FIELDS))


def manifest_text(observations: DataFrame) -> DataFrame:
    """Observations as manifest text: numbers with their digits, True and False, blank for null."""
    def shown(name: str, kind: str) -> Column:
        text = clean.fixed_digits(F.col(name), DIGITS.get(name, 6)) if kind == "double" else F.initcap(F.col(name).cast("string")) if kind == "boolean" else F.col(name).cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return observations.select(*(shown(name, kind) if name in FIELDS else F.col(name) for name, kind in observations.dtypes))


#: Under which names profiles look for what they show, in this order.
PROFILE_ALIASES = {
    "name": ["identity", "bird_name", "profile_name", "individual_name", "name", "label"], "crop_path": ["crop_path", "image_path", "file_path", "path", "filename"], "event_id": ["event_id", "group_id", "visit_id", "review_group", "id"],
    "source_video": ["source_video", "video_path", "video", "input_video"], "timestamp": ["timestamp", "frame_time", "time_seconds", "seconds", "created_at"], "duration": ["duration", "duration_seconds", "visit_duration", "event_duration"],
}


UNKNOWN_NAME = "Unknown"


def profile_name(c: Column) -> Column:
    """Letters, digits, blanks, dashes and underscores of a name; Unknown if none is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N} _-]+", "")), F.lit("")), F.lit(UNKNOWN_NAME))


def profile_observations(rows: DataFrame, carry: list[str]) -> DataFrame:
    """Columns carried (with carried_ before their names), and what profiles show: each the first of its aliases that isn't empty (blanks count as a value), else empty.

    parsed_timestamp is the time told by the timestamp, else by the video's name, else by the crop's, as ISO text; empty without one.
    """
    first = lambda aliases: F.coalesce(*(F.nullif(F.col(a).cast("string"), F.lit("")) for a in aliases if a in rows.columns), F.lit(""))
    found = rows.select(*(F.col(c).alias(f"carried_{c}") for c in carry), *(first(aliases).alias(name) for name, aliases in PROFILE_ALIASES.items()))
    time = clean.any_time(*(F.nullif(F.col(c), F.lit("")) for c in ("timestamp", "source_video", "crop_path")))
    return found.withColumns({"name": profile_name(F.col("name")), "parsed_timestamp": F.coalesce(time, F.lit(""))})
