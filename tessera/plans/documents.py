"""Records and trainer rows of JSON documents that are made of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.plans.rules import as_sql, derived, pick
from tessera.sources import records

ONE = "'{\"id\": ' || CAST(event_id AS VARCHAR(20)) || '}'"
DOCUMENTS = {
    "doc": "event_id",
    "body": pick(
        "event_id", f"'[' || {ONE} || ', 7, ' || {ONE} || ']'", f"'{{\"outputs\": [' || {ONE} || '], \"images\": [{{}}]}}'", f"'{{\"' || event_type || '/1.png\": ' || {ONE} || ', \"b.png\": {{\"id\": 5}}}}'", f"'{{\"detections\": {{\"x\": ' || {ONE} || ', \"y\": 3}}}}'",
        f"'{{\"predictions\": [], \"images\": [' || {ONE} || ']}}'", "'no json ' || event_type", f"'{{\"a\": ' || {ONE} || ', \"b\": 1}}'", "props", "NULL",
    ),
}


@query(f"""WITH {as_sql('events', DOCUMENTS)}, j AS (SELECT doc, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS v FROM x),
    a AS (SELECT doc, 'l' AS kind, v AS part FROM j WHERE json_type(v) = 'ARRAY' UNION ALL
        SELECT doc, CASE json_type(part) WHEN 'ARRAY' THEN 'l' ELSE 'm' END, part FROM (SELECT doc, CASE {' '.join(f"WHEN json_type(v, '$.{e}') IN ('ARRAY', 'OBJECT') THEN json_extract(v, '$.{e}')" for e in records.ENVELOPES['species'])} END AS part FROM j WHERE json_type(v) = 'OBJECT') WHERE part IS NOT NULL
        UNION ALL SELECT doc, 'w', v FROM j WHERE json_type(v) = 'OBJECT' AND {' AND '.join(f"coalesce(json_type(v, '$.{e}') NOT IN ('ARRAY', 'OBJECT'), true)" for e in records.ENVELOPES['species'])} AND (SELECT bool_and(type = 'OBJECT') FROM json_each(v))),
    e AS (SELECT doc, kind, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN kind = 'l' THEN CAST(k.key AS BIGINT) END, k.key) - 1 AS n, k.key AS name, k.type AS type, k.value AS value FROM a, json_each(part) AS k)
    SELECT doc, n, CASE WHEN kind = 'w' THEN name END AS key, CAST(json_extract_string(value, '$.id') AS BIGINT) AS id FROM e WHERE type = 'OBJECT'""")
def prediction_records(spark, sf_dir):
    found = derived(spark, sf_dir, "events", DOCUMENTS).select("doc", F.inline(records.json_records(F.col("body"), "species")))
    return found.select("doc", "n", "key", F.try_variant_get("record", "$.id", "long").alias("id"))


_N = lambda e: f"CAST({e} AS VARCHAR(20))"
_IMAGE = pick("user_id", "'d/cam' || event_type || '-frame-' || " + _N("event_id") + " || '-t12.5-animal-1.png'", "event_type || '.png'", "''")
SHEETS = {
    "sheet": "event_id",
    "body": pick(
        "event_id",
        f"""'{{"rows": [{{"image_path": "' || {_IMAGE} || '", "accepted": "' || CASE WHEN event_id % 4 = 0 THEN 'Yes' ELSE 'no' END || '", "bill_base_x": ' || {_N('event_id % 90')} || ', "bill_base_y": "' || {_N('event_id % 80')} || '", "clicked_tip_x": ' || {_N('user_id % 70 - 3')} || ', "clicked_tip_y": 8, "notes": 0}}]}}'""",
        f"""'[{{"image_path": "' || {_IMAGE} || '", "label": "' || CASE WHEN event_id % 4 = 1 THEN '{records.LABEL_VALID}' WHEN event_id % 8 = 3 THEN 'other' ELSE '' END || '", "bill_base_x": 4, "mmpose_bill_base_y": "", "bill_base_y": 9, "corrected_bill_base_x": ' || {_N('event_id % 50')} || ', "corrected_bill_base_y": ' || {_N('user_id % 40 - 2')} || ', "clicked_tip_x": "' || {_N('event_id % 50 + 3')} || '", "clicked_tip_y": ' || {_N('user_id % 40 + 2')} || ', "frame_number": ' || {_N('event_id % 9 - 2')} || ', "image_index": "x", "notes": "' || event_type || '", "source_video_key": "' || CASE WHEN event_id % 5 > 0 THEN '' ELSE 'v' END || '"}}, 3]'""",
    ),
}
_GET = lambda k: f"json_extract_string(r, '$.{k}')"
_REAL = lambda k: f"coalesce(try_cast({_GET(k)} AS DOUBLE), -1.0)"


@query(f"""WITH {as_sql('events', SHEETS)}, o AS (SELECT sheet, r, json_exists(r, '$.label') AS newer FROM (SELECT sheet, CASE WHEN json_type(body) = 'ARRAY' THEN json_extract(body, '$[0]') ELSE json_extract(body, '$.rows[0]') END AS r FROM x)),
    p AS (SELECT sheet, newer, {_GET('image_path')} AS image_path, regexp_replace(regexp_extract({_GET('image_path')}, '[^/]*$'), '\\.png$', '') AS stem, coalesce({_GET('label')}, '') AS label, coalesce({_GET('accepted')} = 'Yes', false) AS old_v01_accepted, CASE WHEN newer THEN {_GET('notes')} ELSE '' END AS notes,
        {_REAL('bill_base_x')} AS mmpose_bill_base_x, CASE WHEN newer THEN -1.0 ELSE {_REAL('bill_base_y')} END AS mmpose_bill_base_y, CASE WHEN newer THEN {_REAL('corrected_bill_base_x')} ELSE -1.0 END AS bx, CASE WHEN newer THEN {_REAL('corrected_bill_base_y')} ELSE -1.0 END AS b_y,
        {_REAL('clicked_tip_x')} AS tx0, {_REAL('clicked_tip_y')} AS ty0, coalesce(try_cast({_GET('frame_number')} AS BIGINT), -1) AS frame0, coalesce({_GET('source_video_key')}, '') AS key0 FROM o),
    q AS (SELECT *, CASE WHEN newer OR (old_v01_accepted AND tx0 >= 0 AND ty0 >= 0) THEN tx0 ELSE -1.0 END AS tx, CASE WHEN newer OR (old_v01_accepted AND tx0 >= 0 AND ty0 >= 0) THEN ty0 ELSE -1.0 END AS ty, contains(stem, '-frame-') AS framed FROM p),
    l AS (SELECT *, CASE WHEN bx >= 0 AND b_y >= 0 AND tx >= 0 AND ty >= 0 THEN sqrt((tx - bx) ** 2 + (ty - b_y) ** 2) ELSE -1.0 END AS len FROM q)
    SELECT sheet, CASE WHEN newer THEN 'v02' ELSE 'v01' END AS layout, image_path, 0 AS image_index, CASE WHEN key0 <> '' THEN key0 WHEN framed THEN split_part(stem, '-frame-', 1) WHEN stem <> '' THEN stem ELSE '.' END AS source_video_key,
      CASE WHEN frame0 >= 0 THEN frame0 WHEN framed THEN CAST(regexp_extract(stem, 'frame-(\\d+)', 1) AS BIGINT) ELSE -1 END AS frame_number, CASE WHEN framed THEN 12.5 ELSE -1.0 END AS time_sec, mmpose_bill_base_x, mmpose_bill_base_y, bx AS corrected_bill_base_x, b_y AS corrected_bill_base_y, tx AS clicked_tip_x, ty AS clicked_tip_y,
      round(len, 6) AS corrected_bill_length_px, CASE WHEN len >= 0 THEN round(degrees(atan2(ty - b_y, tx - bx)), 6) ELSE -1.0 END AS corrected_bill_angle_deg, label, label = '{records.LABEL_VALID}' AND len > 0 AS is_premium_training_row,
      CASE WHEN label = '{records.LABEL_VALID}' AND len > 0 THEN 'bill_base_and_tip' WHEN label <> '' THEN 'exclude' ELSE 'unreviewed' END AS training_use, old_v01_accepted, notes, 'now' AS created_at FROM l""")
def trainer_sheets(spark, sf_dir):
    found = derived(spark, sf_dir, "events", SHEETS).select("sheet", F.inline(records.json_records(F.col("body"), "trainer")))
    rows = records.trainer_rows(found, ["sheet"], "now").withColumns({c: F.round(c, 6) for c in ("corrected_bill_length_px", "corrected_bill_angle_deg")})
    wanted = "sheet layout image_path image_index source_video_key frame_number time_sec mmpose_bill_base_x mmpose_bill_base_y corrected_bill_base_x corrected_bill_base_y clicked_tip_x clicked_tip_y corrected_bill_length_px corrected_bill_angle_deg label is_premium_training_row training_use old_v01_accepted notes created_at"
    return rows.select(*wanted.split())


CANDIDATES = {
    "manifest": "event_type", "id": "event_id",
    "body": f"""'{{"candidate_path": "' || CASE WHEN event_id % 13 > 0 THEN 'c' || {_N('event_id')} || '.png' ELSE '' END || '", "evidence_rank": ' || CASE WHEN event_id % 6 > 0 THEN {_N('user_id % 20')} ELSE 'null' END || ', "identity_evidence_score": ' || {_N('event_id % 7')} || ', "source_key": "s' || {_N('user_id % 3')} || '", "frame_number": ' || {_N('event_id % 11')} || ', "bill_base_x": 5}}'""",
}


@query(f"""WITH {as_sql('events', CANDIDATES)}, r AS (SELECT manifest, id, json_extract_string(body, '$.candidate_path') AS image_path, try_cast(json_extract_string(body, '$.evidence_rank') AS BIGINT) AS rank, json_extract_string(body, '$.evidence_rank') AS told, CAST(json_extract_string(body, '$.identity_evidence_score') AS BIGINT) AS score,
        json_extract_string(body, '$.source_key') AS source, CAST(json_extract_string(body, '$.frame_number') AS BIGINT) AS frame FROM x)
    SELECT manifest, image_path, row_number() OVER (PARTITION BY manifest ORDER BY coalesce(rank, 1000000000), score DESC, source, frame, id) - 1 AS image_index, id AS source_row_index, source AS source_video_key, source AS sequence_id, frame AS frame_number, -1.0 AS mmpose_bill_base_x, false AS best_bill_frame, 'unreviewed' AS training_use,
      'sampler manifest import; bucket=; rank=' || coalesce(told, 'None') || '; score=' || score AS notes FROM r WHERE image_path <> ''""")
def sampler_imports(spark, sf_dir):
    rows = derived(spark, sf_dir, "events", CANDIDATES).select("manifest", F.col("id").alias("n"), F.try_parse_json("body").alias("record"))
    wanted = "manifest image_path image_index source_row_index source_video_key sequence_id frame_number mmpose_bill_base_x best_bill_frame training_use notes"
    return records.sampled_rows(rows, "manifest", "now").select(*wanted.split())
