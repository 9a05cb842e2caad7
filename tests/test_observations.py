"""Observations of lengths: each state and blocker by hand, their text, and empty or narrow tables."""

from pyspark.sql import functions as F

from tessera.operators import observations as obs
from tessera.sources.settings import Calibration

SCALE, NONE = Calibration(2.0, "same_plane_feeder1_validated", "given", "validated"), Calibration(None, "uncalibrated_px_only", "none", "none", ["w"])
COLUMNS = "row_index long, bill_base_x_raw_crop string, bill_base_y_raw_crop string, bill_tip_x_raw_crop string, bill_tip_y_raw_crop string, bill_base_likelihood string, bill_tip_likelihood string, dlc_bill_length_px string, raw_crop_path string, notes string"
ROWS = [
    (1, "10", "10", "13", "14", "0.9", "0.8", "5.02", "/a", "n"), (2, "10", "10", "13", "14", "0.9", "0.8", "5.0201", "/a", None), (3, "90", "50", "110", "50", "0.9", "0.5", "20", "/a", ""), (4, "110", "50", "90", "50", "0.9", "0.5", "", "/a", ""),
    (5, "-5", "-5", "-5", "-5", "0.1", "0.5", "7", "/gone", ""), (6, "10", "10", "13", "14", "0.9", None, "5", " ", ""), (7, None, "-1", "-4", "-4", "0.9", "0.9", "5", "/a", ""), (8, "4", "4", "4", "4", "0.3", "0.3", "0", "/a", ""),
]


def seen(spark, rows, scale=SCALE, **more):
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("/a") for c in obs.PATHS if c != "raw_crop_path"} | {"raw_crop_width": F.lit("100"), "raw_crop_height": F.lit("80"), "smart_cropper_decision": F.lit("smart_cropper_ready"), "VALUE_PX_X": F.lit(1)})
    files = spark.createDataFrame([("/a",), (None,)], "path string")
    return obs.bill_length_observations(df, "row_index", files, scale, **more)


def test_states_blockers_and_values(spark):
    found = {r.row_index: r for r in seen(spark, ROWS).collect()}
    assert {k: r.metric_observation_state for k, r in found.items()} == {1: obs.FULL, 2: obs.REJECTED, 3: obs.PARTIAL, 4: obs.PARTIAL, 5: obs.EXTENSION, 6: obs.REJECTED, 7: obs.REJECTED, 8: obs.REJECTED}
    assert {k: r.metric_blockers for k, r in found.items() if r.metric_blockers} == {2: "length_recompute_mismatch", 5: "unreadable_path:raw_crop_path;zero_length;length_recompute_mismatch;low_bill_point_likelihood", 6: "missing_path:raw_crop_path;missing_bill_point_likelihood", 7: "missing_bill_base_xy", 8: "zero_length"}
    one, three, four, five, seven = (found[k] for k in (1, 3, 4, 5, 7))
    assert (one.value_px, one.value_px_recomputed, one.value_mm, one.value_px_for_range, one.metric_warnings, one.value_px_visible_lower_bound) == (5.02, 5.0, 2.5, 5.0, "same_plane_feeder1_validated", None)
    assert (three.value_px_visible_lower_bound, three.visible_lower_bound_clip_t, three.visible_lower_bound_clip_x, three.visible_lower_bound_clip_y, three.value_mm, three.value_mm_for_range) == (10.0, 0.5, 100.0, 50.0, None, 5.0)
    assert four.metric_warnings == "missing_reported_length_px;base_outside_raw_crop_bounds;same_plane_feeder1_validated" and (four.base_outside_raw_crop_px, four.visible_lower_bound_clip_x) == (10.0, 100.0)
    assert (five.value_px_for_range, five.metrics_decision, five.metric_use_class) == (7.0, "metric_observation_recorded", "diagnostic_only")
    assert (seven.point_bounds_state, seven.metrics_note, seven.base_outside_raw_crop_px) == ("unknown_bounds_state", "metric observation rejected: missing_bill_base_xy", None)


def test_all_fields_as_text(spark):
    text = obs.manifest_text(seen(spark, ROWS[:1], NONE, profile={"path": "p.json", "front_px_per_mm": 0.0}))
    assert text.columns == ["row_index", *obs.FIELDS] and len(obs.FIELDS) == 85
    row = text.first().asDict()
    assert row | {"value_px": "5.020000", "base_x_raw_crop": "10.000", "px_per_mm": "", "metric_px_ready": "True", "metric_scale_ready": "False", "value_mm": "", "notes": "n", "dlc_h5_path": "", "metric_input_index": "1", "calibration_profile_path": "p.json"} == row
    assert (row["calibration_profile_front_px_per_mm"], row["calibration_profile_has_front_px_per_mm"], row["metric_warnings"], row["metrics_note"]) == ("0.000000", "False", "uncalibrated_px_only;calibration:w", "full bill length px-ready observation; metric_scale_ready false")


def test_empty_and_narrow_tables(spark):
    assert seen(spark, []).count() == 0
    bare = spark.createDataFrame([(1,)], "row_index long")
    row = obs.bill_length_observations(bare, "row_index", spark.createDataFrame([], "path string"), NONE).first()
    assert row.metric_blockers.count("missing_path:") == 4 and row.metric_observation_state == obs.REJECTED
    shown = obs.profile_observations(bare, ["row_index"]).first()
    assert (shown.name, shown.crop_path, shown.parsed_timestamp) == ("Unknown", "", "")
