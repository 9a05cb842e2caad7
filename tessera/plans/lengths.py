"""Observations of lengths and of profiles, bound to events as manifest rows and customers as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import observations
from tessera.plans.registry import query
from tessera.plans.rules import CLOCK, DIGITS, PATH, _iso_sql, _name_time_sql, as_sql, derived, pick
from tessera.sources.settings import Calibration

SCALE = Calibration(4.0, "same_plane_feeder1_candidate", "settings:px_per_mm", "provisional", ["scale not validated"])
BX, BY, TX = "(event_id * 7 % 130 - 15)", "(event_id * 11 % 100 - 10)", "(event_id * 13 % 140 - 20)"
TY = f"(CASE WHEN event_id % 3 > 0 THEN {BY} ELSE event_id * 5 % 110 - 15 END)"
CROP = "'/c/' || CAST({} AS VARCHAR(20)) || '.png'"
MANIFEST = {
    "id": "event_id", "smart_cropper_input_index": "CASE WHEN event_id % 4 > 0 THEN '' ELSE 's' || CAST(event_id AS VARCHAR(20)) END", "dlc_input_index": "CASE WHEN event_id % 4 = 1 THEN ' d1 ' ELSE ' ' END",
    "raw_crop_width": "CASE WHEN event_id % 53 > 0 THEN '100' ELSE '' END", "raw_crop_width_actual": "CASE WHEN event_id % 10 = 3 THEN '120' ELSE ' ' END", "raw_crop_height": "CASE WHEN event_id % 59 > 0 THEN '80' ELSE '0' END",
    "bill_base_x_raw_crop": f"CASE WHEN event_id % 61 > 0 THEN CAST({BX} AS VARCHAR(20)) ELSE 'x' END", "bill_base_y_raw_crop": f"CAST({BY} AS VARCHAR(20))", "bill_tip_x_raw_crop": f"CASE WHEN event_id % 47 > 0 THEN CAST({TX} AS VARCHAR(20)) ELSE CAST({BX} AS VARCHAR(20)) END", "bill_tip_y_raw_crop": f"CASE WHEN event_id % 71 > 0 THEN CAST({TY} AS VARCHAR(20)) ELSE '' END",
    "bill_base_likelihood": "CASE WHEN event_id % 67 > 0 THEN '0.' || CAST(1 + event_id % 9 AS VARCHAR(20)) ELSE 'nan' END", "bill_tip_likelihood": "'0.' || CAST(2 + user_id % 8 AS VARCHAR(20))",
    "dlc_bill_length_px": f"CASE WHEN event_id % 11 > 0 THEN CAST(abs({TX} - {BX}) + CASE WHEN event_id % 17 > 0 THEN 0 ELSE 1 END AS VARCHAR(20)) ELSE '' END", "bill_axis_angle_deg": "CAST(event_id % 180 AS VARCHAR(20))",
    "smart_cropper_decision": pick("event_id", "'smart_cropper_ready'", "' smart_cropper_ready'", "'smart_cropper_blocked'", "NULL"), "metric_eligible_bill_length": pick("user_id", "'true'", "'No'", "''", "'perhaps'"), "notes": "event_type",
    "raw_crop_path": CROP.format("1 + event_id % 140"), "whole_candidate_crop_path": "'/c/./1.png'", "head_bill_crop_path": "CASE WHEN event_id % 37 > 0 THEN '/c/2.png' ELSE ' ' END", "body_crop_path": CROP.format("1 + event_id % 100"),
}
FILES = {"path": CROP.format("c_custkey"), "number": "c_custkey"}
_NUMBERS = "value_px value_px_recomputed value_px_recompute_delta value_px_visible_lower_bound value_px_for_range value_mm value_mm_visible_lower_bound value_mm_for_range length_axis_angle_deg base_outside_raw_crop_px tip_outside_raw_crop_px visible_lower_bound_clip_x visible_lower_bound_clip_y visible_lower_bound_clip_t min_point_likelihood base_x_raw_crop base_y_raw_crop base_likelihood tip_x_raw_crop tip_y_raw_crop tip_likelihood raw_crop_width_px raw_crop_height_px".split()
_WORDS = "metrics_decision metrics_note metric_input_index metric_observation_state metric_use_class length_px_role range_support_class metric_px_ready aggregation_eligible lower_bound_eligible autosort_feature_eligible metric_blockers metric_warnings point_bounds_state visibility_state whole_feature_visibility_state likelihood_quality_band raw_crop_path smart_cropper_decision notes".split()
_NUM = lambda c: f"(CASE WHEN lower(trim({c})) <> 'nan' THEN try_cast(trim({c}) AS DOUBLE) END)"
_OUT = lambda x, y: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL THEN sqrt(greatest(-{x}, {x} - w, 0) ** 2 + greatest(-{y}, {y} - h, 0) ** 2) END"
_IN = lambda x, y: f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL THEN {x} BETWEEN 0 AND w AND {y} BETWEEN 0 AND h END"


def _edge(start: str, step: str, edge: str, other: str, other_step: str, most: str) -> str:
    t = f"(({edge} - {start}) / nullif({step}, 0))"
    return f"CASE WHEN {t} > 1e-9 AND {other} + {t} * {other_step} BETWEEN -1e-6 AND {most} + 1e-6 THEN {t} END"


_EDGES = ", ".join((_edge("x0", "dx", "0", "y0", "dy", "h"), _edge("x0", "dx", "w", "y0", "dy", "h"), _edge("y0", "dy", "0", "x0", "dx", "w"), _edge("y0", "dy", "h", "x0", "dx", "w")))
_LIST = lambda *parts: "concat_ws(';', " + ", ".join(parts) + ")"
_PATH = lambda c: f"CASE WHEN trim({c}) = '' THEN 'missing_path:{c}' WHEN replace({c}, '/./', '/') NOT IN (SELECT path FROM f) THEN 'unreadable_path:{c}' END"
OBSERVATION_SQL = f"""WITH {as_sql('events', MANIFEST)}, f AS (SELECT {FILES['path']} AS path FROM customer WHERE c_custkey <= 139),
    v AS (SELECT *, {_NUM("coalesce(nullif(trim(raw_crop_width_actual), ''), raw_crop_width)")} AS w, {_NUM('raw_crop_height')} AS h, {_NUM('bill_base_x_raw_crop')} AS bx, {_NUM('bill_base_y_raw_crop')} AS b_y, {_NUM('bill_tip_x_raw_crop')} AS tx, {_NUM('bill_tip_y_raw_crop')} AS ty,
        {_NUM('bill_base_likelihood')} AS bp, {_NUM('bill_tip_likelihood')} AS tp, {_NUM('dlc_bill_length_px')} AS told FROM x),
    s AS (SELECT *, sqrt((tx - bx) ** 2 + (ty - b_y) ** 2) AS len, CASE WHEN bp IS NOT NULL AND tp IS NOT NULL THEN least(bp, tp) END AS p, {_IN('bx', 'b_y')} AS base, {_IN('tx', 'ty')} AS tip FROM v),
    b AS (SELECT *, {_LIST(*(_PATH(c) for c in observations.PATHS), "CASE WHEN len <= 0 THEN 'zero_length' END", "CASE WHEN abs(len - told) > 0.02 THEN 'length_recompute_mismatch' END", "CASE WHEN w > 0 AND h > 0 THEN NULL ELSE 'invalid_raw_crop_dimensions' END",
        "CASE WHEN bx IS NULL OR b_y IS NULL THEN 'missing_bill_base_xy' END", "CASE WHEN tx IS NULL OR ty IS NULL THEN 'missing_bill_tip_xy' END", "CASE WHEN p IS NULL THEN 'missing_bill_point_likelihood' WHEN p < 0.3 THEN 'low_bill_point_likelihood' END")} AS metric_blockers,
        CASE WHEN base AND tip THEN 'inside' WHEN base AND NOT tip THEN 'tip' WHEN NOT base AND tip THEN 'base' WHEN NOT base AND NOT tip THEN 'points' ELSE 'unknown' END AS place,
        CASE WHEN base THEN bx ELSE tx END AS x0, CASE WHEN base THEN b_y ELSE ty END AS y0, CASE WHEN base THEN tx - bx ELSE bx - tx END AS dx, CASE WHEN base THEN ty - b_y ELSE b_y - ty END AS dy FROM s),
    e AS (SELECT *, CASE WHEN place IN ('tip', 'base') THEN least({_EDGES}) END AS t0 FROM b),
    o AS (SELECT *, CASE WHEN place = 'points' THEN 'diagnostic_predicted_extension' WHEN place = 'unknown' OR metric_blockers <> '' THEN 'rejected_geometry' WHEN place = 'inside' THEN 'full_length_px_ready' WHEN t0 IS NOT NULL THEN 'partial_length_lower_bound' ELSE 'diagnostic_predicted_extension' END AS state FROM e),
    q AS (SELECT *, state = 'full_length_px_ready' AS full_, state = 'partial_length_lower_bound' AS part, state = 'rejected_geometry' AS bad, state = 'diagnostic_predicted_extension' AS far, CASE WHEN state = 'partial_length_lower_bound' THEN t0 END AS t FROM o),
    r AS (SELECT *, least(t, 1.0) * len * CASE WHEN t IS NULL THEN NULL ELSE 1 END AS seen FROM q), z AS (SELECT *, CASE WHEN full_ OR far THEN coalesce(nullif(len, 0), told) WHEN part THEN seen END AS ranged FROM r)
    SELECT id, CASE WHEN bad THEN 'metric_observation_rejected' ELSE 'metric_observation_recorded' END AS metrics_decision,
      CASE WHEN full_ THEN 'full bill length observation with scale' WHEN part THEN 'partial bill lower-bound observation retained; not aggregation-ready' WHEN far THEN 'diagnostic predicted-extension observation retained; not biometrics-ready' WHEN metric_blockers <> '' THEN 'metric observation rejected: ' || metric_blockers ELSE 'metric observation rejected' END AS metrics_note,
      coalesce(nullif(trim(smart_cropper_input_index), ''), nullif(trim(dlc_input_index), ''), CAST(id AS VARCHAR(20))) AS metric_input_index, state AS metric_observation_state,
      CASE WHEN full_ THEN 'biometrics_candidate' WHEN part THEN 'biometrics_lower_bound' WHEN far THEN 'diagnostic_only' ELSE 'reject' END AS metric_use_class, CASE WHEN full_ THEN 'full_length_candidate' ELSE state END AS length_px_role,
      CASE WHEN full_ THEN 'range_candidate' WHEN part THEN 'range_floor_support' WHEN far THEN 'diagnostic_only' ELSE 'reject' END AS range_support_class, full_ AS metric_px_ready, full_ AS aggregation_eligible, part AS lower_bound_eligible, full_ OR part AS autosort_feature_eligible, metric_blockers,
      {_LIST("CASE WHEN len IS NOT NULL AND told IS NULL THEN 'missing_reported_length_px' END", "CASE WHEN part OR far THEN place || '_outside_raw_crop_bounds' || CASE WHEN far AND place <> 'points' THEN '_no_clip_intersection' ELSE '' END END", "CASE WHEN trim(smart_cropper_decision) = 'smart_cropper_ready' THEN NULL ELSE 'smart_cropper_decision_not_ready' END",
        "CASE WHEN metric_eligible_bill_length = 'No' THEN 'smart_cropper_metric_eligible_bill_length_false' END", "'same_plane_feeder1_candidate'", "'calibration:scale not validated'")} AS metric_warnings,
      CASE place WHEN 'inside' THEN 'inside_raw_crop_bounds' WHEN 'unknown' THEN 'unknown_bounds_state' ELSE place || '_outside_raw_crop_bounds' END AS point_bounds_state,
      CASE place WHEN 'inside' THEN 'whole_bill_points_inside_raw_crop' WHEN 'tip' THEN 'partial_bill_tip_outside_raw_crop' WHEN 'base' THEN 'partial_bill_base_outside_raw_crop' WHEN 'points' THEN 'points_outside_raw_crop' ELSE 'unknown' END AS visibility_state,
      CASE place WHEN 'inside' THEN 'bill_points_inside_raw_crop' WHEN 'tip' THEN 'blocked_bill_tip_outside_raw_crop' WHEN 'base' THEN 'blocked_bill_base_outside_raw_crop' WHEN 'points' THEN 'blocked_points_outside_raw_crop' ELSE 'unknown' END AS whole_feature_visibility_state,
      CASE WHEN p IS NULL THEN 'missing_likelihood' WHEN p < 0.3 THEN 'below_minimum' WHEN p >= 0.7 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS likelihood_quality_band, raw_crop_path, coalesce(smart_cropper_decision, '') AS smart_cropper_decision, notes,
      {', '.join(f'round({e}, 6) + 0.0 AS {n}' for n, e in zip(_NUMBERS, ['told', 'len', 'abs(len - told)', 'seen', 'ranged', 'CASE WHEN full_ THEN coalesce(nullif(len, 0), told) / 4 END', 'seen / 4', 'ranged / 4', 'CAST(bill_axis_angle_deg AS DOUBLE)', _OUT('bx', 'b_y'), _OUT('tx', 'ty'), 'least(greatest(x0 + t * dx, 0), w) + 0 * t', 'least(greatest(y0 + t * dy, 0), h) + 0 * t', 't', 'p', 'bx', 'b_y', 'bp', 'tx', 'ty', 'tp', 'w', 'h'], strict=True))} FROM z"""


@query(OBSERVATION_SQL)
def length_observations(spark, sf_dir):
    rows = derived(spark, sf_dir, "events", MANIFEST)
    files = derived(spark, sf_dir, "customer", FILES).where("number <= 139")
    seen = observations.bill_length_observations(rows, "id", files, SCALE)
    return seen.select("id", *_WORDS, *((F.round(n, 6) + F.lit(0.0)).alias(n) for n in _NUMBERS))


SEEN = {
    "id": "event_id", "bird_name": pick("event_id", "''", "' Ann-1 '", "'Bo/b #2'", "NULL", "'//'"), "label": pick("user_id", "''", "event_type", "'wren'"), "image_path": PATH, "path": "'/c/' || event_type", "group_id": pick("event_id", "''", "'g1'", "' '"),
    "video": pick("user_id", f"printf('cam_%04d-%02d-%02d.mp4', {DIGITS})", "''", "'v.mp4'"), "frame_time": pick("event_id", "''", "'12.5'", f"printf('%04d-%02d-%02dT%02d:%02d:%02d', {DIGITS}, {CLOCK})"), "visit_duration": pick("user_id", "''", "'7'"),
}
_FIRST = lambda *names: "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')"


@query(f"""WITH {as_sql('events', SEEN)}, o AS (SELECT id AS carried_id, {_FIRST('bird_name', 'label')} AS n, {_FIRST('image_path', 'path')} AS crop_path, {_FIRST('group_id', 'CAST(id AS VARCHAR(20))')} AS event_id, {_FIRST('video')} AS source_video, {_FIRST('frame_time')} AS timestamp, {_FIRST('visit_duration')} AS duration FROM x)
    SELECT carried_id, coalesce(nullif(trim(regexp_replace(trim(n), '[^\\p{{L}}\\p{{N}} _-]+', '', 'g')), ''), 'Unknown') AS name, crop_path, event_id, source_video, timestamp, duration,
      coalesce({', '.join(f"{_iso_sql(v)}, strftime({_name_time_sql(v)}, '%Y-%m-%dT%H:%M:%S')" for v in ("nullif(timestamp, '')", "nullif(source_video, '')", "nullif(crop_path, '')"))}, '') AS parsed_timestamp FROM o""")
def profile_observations(spark, sf_dir):
    return observations.profile_observations(derived(spark, sf_dir, "events", SEEN), ["id"])
