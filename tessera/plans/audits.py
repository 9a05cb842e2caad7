"""Audits over several tables, bound to orders (inputs and results), lineitem (detections and crops), part and nation (files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import detector_audit
from tessera.plans.registry import query
from tessera.plans.rules import derived, pick

RUN = "CAST(l_orderkey % 7 AS VARCHAR(20))"
LINE_ID = "CAST(l_orderkey AS VARCHAR(20)) || '-' || CAST(l_linenumber AS VARCHAR(20))"
WIDE, HIGH = "(CAST(l_quantity AS INT) - l_linenumber)", "(l_linenumber * 3)"
DETECTIONS = {
    "run": RUN, "detection_id": f"CASE WHEN l_partkey % 40 > 0 THEN {LINE_ID} ELSE '' END", "frame_id": "CASE WHEN l_suppkey % 9 > 0 THEN CAST(l_orderkey AS VARCHAR(20)) ELSE 'lost' END",
    "detection_role": pick("l_partkey", "'animal'", "''", "'Person'", "'beast'", "' '"), "class_name": pick("l_suppkey", "'Bird of prey'", "''", "'Human'", "'racecar'", "'tree'"),
    "xmin": "CAST(l_linenumber AS VARCHAR(20))", "ymin": "'0'", "xmax": "CASE WHEN l_partkey % 60 <> 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) ELSE 'x' END", "ymax": f"CAST({HIGH} AS VARCHAR(20))",
    "w": f"CAST({WIDE} + l_suppkey % 3 AS VARCHAR(20))", "h": f"CAST({HIGH} + l_partkey % 4 AS VARCHAR(20))", "area": f"CAST({WIDE} * {HIGH} + l_partkey % 90 AS VARCHAR(20))",
}
INPUTS = {"run": "CAST(o_orderkey % 7 AS VARCHAR(20))", "detector_input_id": "''", "frame_id": "CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderkey AS VARCHAR(20)) ELSE '' END"}
CROPS = {
    "run": RUN, "kept": "l_returnflag", "detection_id": f"CASE WHEN l_suppkey % 8 > 0 THEN {LINE_ID} ELSE 'none' END", "crop_path": "CASE WHEN l_partkey % 30 > 0 THEN '/c/' || CAST(l_partkey AS VARCHAR(20)) || '.png' ELSE ' ' END",
    "crop_bytes": "CAST(1 + l_partkey % 50 AS VARCHAR(20))", "detection_role": pick("l_partkey", "'animal'", "''", "'Person'", "''"), "class_name": pick("l_suppkey", "'Bird of prey'", "''", "'cat'"),
}
CROP_FILES = {"path": "'/c/' || CAST(p_partkey AS VARCHAR(20)) || '.png'", "length": "CAST(p_size AS BIGINT)", "number": "p_partkey"}
VIDEOS = {"path": "'/v/' || CAST(n_nationkey AS VARCHAR(20)) || '.mp4'", "length": "CAST(n_nationkey AS BIGINT)", "number": "n_nationkey"}
#: What manifest and ledger of a run claim, made of its lines (n) and crops (c); run 5 has no manifest, run 3 no ledger.
CLAIMS = [
    ("manifest", "database_mutation", "CASE WHEN run = '4' THEN 'true' ELSE 'false' END"), ("manifest", "durable_evidence_written", "CASE WHEN run = '2' THEN 'maybe' ELSE 'no' END"), ("manifest", "detector_input_rows", "'1'"),
    ("manifest", "detections_written", "CAST(n + CASE WHEN run = '1' THEN 1 ELSE 0 END AS VARCHAR(20))"), ("manifest", "crop_exports_written", "CAST(c AS VARCHAR(20))"), ("manifest", "crop_export_rows", "'0'"),
    ("manifest", "animal_detections", "CAST(n AS VARCHAR(20))"), ("manifest", "person_detections", "'0'"), ("manifest", "vehicle_detections", "'-1'"), ("manifest", "other_detections", "'0'"),
    ("manifest", "crop_export_mode", "CASE WHEN run IN ('0', '1') THEN 'Animal_preview' ELSE 'all' END"), ("manifest", "source_video", "CASE WHEN run = '6' THEN '' WHEN run = '2' THEN '/v/none.mp4' ELSE '/v/' || run || '.mp4' END"), ("manifest", "max_crop_exports_total", "CAST(c - 1 AS VARCHAR(20))"),
    ("ledger", "database_mutation", "'0'"), ("ledger", "durable_evidence_written", "CASE WHEN run = '0' THEN 'yes' ELSE 'no' END"), ("ledger", "detector_input_frames", "NULL"), ("ledger", "crop_export_rows", "CAST(c AS VARCHAR(20))"),
    ("ledger", "bytes_written", "CAST(c * 7 AS VARCHAR(20))"), ("ledger", "max_bytes_total_mb", "CASE WHEN run IN ('0', '4') THEN '0.0001' ELSE '9999' END"), ("ledger", "max_crop_exports_total", "CASE WHEN run = '1' THEN '0' ELSE CAST(c AS VARCHAR(20)) END"),
]
MADE = "(source = 'manifest' AND run <> '5') OR (source = 'ledger' AND run <> '3')"


def detector_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    detections = derived(spark, sf_dir, "lineitem", DETECTIONS)
    crops = derived(spark, sf_dir, "lineitem", CROPS)
    inputs = derived(spark, sf_dir, "orders", INPUTS)
    files = derived(spark, sf_dir, "part", CROP_FILES).where("number % 13 > 0").union(derived(spark, sf_dir, "nation", VIDEOS)).drop("number")
    base = crops.groupBy("run").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(crops.where("kept = 'A'").groupBy("run").agg({"*": "count"}).withColumnRenamed("count(1)", "c"), "run")
    rows = ", ".join(f"named_struct('source', '{s}', 'field', '{f}', 'value', CAST({v} AS STRING))" for s, f, v in CLAIMS)
    claims = base.selectExpr("run", f"inline(array({rows}))").where(MADE)
    return [inputs, inputs.where("run <> '2'"), detections, crops.where("kept = 'A'").drop("kept"), files, claims]


_HAS = lambda text, *words: "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"
_TOLD = lambda source, *fields: "coalesce(" + ", ".join(f"nullif(max(value) FILTER (source = '{source}' AND field = '{f}'), '')" for f in fields) + ", NULL)"
_NUMBERS = "inputs detections crops crop_bytes".split()
_FIELDS = {
    "inputs": ("detector_input_frames", "detector_input_rows"), "detections": ("detections_written",), "crops": ("crop_exports_written", "crop_export_rows"), "mutation": ("database_mutation",), "durable": ("durable_evidence_written",),
    "video": ("source_video",), "max_crops": ("max_crop_exports_total",), "max_mb": ("max_bytes_total_mb",),
}


def _told_sql() -> str:
    columns = [f"{_TOLD(s, *fields)} AS {s}_{name}" for s in ("manifest", "ledger") for name, fields in _FIELDS.items()]
    columns += [f"{_TOLD('manifest', r + '_detections')} AS manifest_{r}" for r in ("animal", "person", "vehicle", "other")]
    columns += [f"{_TOLD('manifest', 'crop_export_bytes_written')} AS manifest_crop_bytes", f"{_TOLD('ledger', 'bytes_written')} AS ledger_crop_bytes", f"{_TOLD('manifest', 'crop_export_mode')} AS mode"]
    columns += [f"count(*) FILTER (source = '{s}') AS {s}_rows" for s in ("manifest", "ledger")]
    return "told AS (SELECT run, " + ", ".join(columns) + " FROM claims GROUP BY run)"


def _tables_sql() -> str:
    claims = " UNION ALL ".join(f"SELECT run, '{s}' AS source, '{f}' AS field, {v} AS value FROM base" for s, f, v in CLAIMS)
    inventory = f"SELECT {CROP_FILES['path']} AS path, {CROP_FILES['length']} AS bytes FROM part WHERE p_partkey % 13 > 0 UNION ALL SELECT {VIDEOS['path']}, {VIDEOS['length']} FROM nation"
    role = f"""CASE WHEN trim(detection_role) <> '' THEN CASE WHEN lower(trim(detection_role)) IN ('animal', 'person', 'vehicle', 'other', 'unknown') THEN lower(trim(detection_role)) ELSE 'other' END WHEN class_name = '' THEN 'unknown'
        WHEN {_HAS('lower(class_name)', 'animal', 'bird')} THEN 'animal' WHEN {_HAS('lower(class_name)', 'person', 'human')} THEN 'person' WHEN {_HAS('lower(class_name)', 'vehicle', 'car', 'truck')} THEN 'vehicle' ELSE 'other' END"""
    return f"""WITH d0 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in DETECTIONS.items())} FROM lineitem), d AS (SELECT *, CASE WHEN detection_id <> '' THEN detection_id ELSE frame_id END AS id, {role} AS r,
            try_cast(xmin AS DOUBLE) AS x1, try_cast(ymin AS DOUBLE) AS y1, try_cast(xmax AS DOUBLE) AS x2, try_cast(ymax AS DOUBLE) AS y2, CAST(w AS DOUBLE) AS ww, CAST(h AS DOUBLE) AS hh, CAST(area AS DOUBLE) AS aa FROM d0),
        i AS (SELECT {', '.join(f'{e} AS {n}' for n, e in INPUTS.items())} FROM orders), c0 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in CROPS.items())} FROM lineitem),
        base AS (SELECT run, count(*) AS n, count(*) FILTER (kept = 'A') AS c FROM c0 GROUP BY run HAVING count(*) FILTER (kept = 'A') > 0), claims AS (SELECT * FROM ({claims}) WHERE {MADE}), files AS ({inventory}), {_told_sql()},
        c AS (SELECT c0.*, bytes FROM c0 LEFT JOIN files ON trim(crop_path) = path WHERE kept = 'A'),
        totals AS (SELECT run, sum(inputs)::BIGINT AS inputs, sum(input_ids)::BIGINT AS input_ids, sum(results)::BIGINT AS results, sum(detections)::BIGINT AS detections, sum(detection_ids)::BIGINT AS detection_ids, sum(animal)::BIGINT AS animal, sum(person)::BIGINT AS person,
            sum(vehicle)::BIGINT AS vehicle, sum(other)::BIGINT AS other, sum(unknown)::BIGINT AS unknown, sum(crops)::BIGINT AS crops, sum(crop_bytes)::BIGINT AS crop_bytes FROM (
            SELECT run, count(*) AS inputs, count(*) FILTER (frame_id <> '') AS input_ids, count(*) FILTER (run <> '2') AS results, 0 AS detections, 0 AS detection_ids, 0 AS animal, 0 AS person, 0 AS vehicle, 0 AS other, 0 AS unknown, 0 AS crops, 0 AS crop_bytes FROM i GROUP BY run
            UNION ALL SELECT run, 0, 0, 0, count(*), count(*) FILTER (detection_id <> ''), count(*) FILTER (r = 'animal'), count(*) FILTER (r = 'person'), count(*) FILTER (r = 'vehicle'), count(*) FILTER (r = 'other'), count(*) FILTER (r = 'unknown'), 0, 0 FROM d GROUP BY run
            UNION ALL SELECT run, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, count(*), coalesce(sum(bytes), 0) FROM c GROUP BY run) GROUP BY run),
        runs AS (SELECT t.*, o.* EXCLUDE (run), coalesce(manifest_video, ledger_video) AS video FROM totals t LEFT JOIN told o USING (run))"""


def _issues_sql() -> str:
    rows = [("error", "box_missing", "x1 IS NULL OR y1 IS NULL OR x2 IS NULL OR y2 IS NULL"), ("error", "box_order", "x2 <= x1 OR y2 <= y1"), ("warning", "box_width", "abs(x2 - x1 - ww) > 1.01"), ("warning", "box_height", "abs(y2 - y1 - hh) > 1.01"), ("warning", "box_area", "abs((x2 - x1) * (y2 - y1) - aa) > greatest(2.0, 0.02 * greatest(1.0, aa))")]
    parts = [f"SELECT run, '{level}' AS level, '{code}' AS code, id FROM d WHERE {rule}" for level, code, rule in rows]
    crop = [
        ("warning", "crop_path_missing", "trim(crop_path) = ''"), ("error", "crop_file_missing", "trim(crop_path) <> '' AND bytes IS NULL"), ("warning", "crop_bytes_differ", "CAST(crop_bytes AS BIGINT) <> bytes"),
        ("error", "crop_role_refused", "bytes IS NOT NULL AND mode = 'Animal_preview' AND detection_role = 'Person'"), ("warning", "crop_class_refused", "bytes IS NOT NULL AND mode = 'Animal_preview' AND detection_role = '' AND class_name = 'cat'"),
    ]
    parts += [f"SELECT c.run, '{level}', '{code}', detection_id FROM c LEFT JOIN told USING (run) WHERE {rule}" for level, code, rule in crop]
    parts.append("SELECT run, 'error', 'detection_input_unknown', id FROM d WHERE run IN (SELECT run FROM i WHERE frame_id <> '') AND NOT EXISTS (SELECT 1 FROM i WHERE i.run = d.run AND i.frame_id = d.frame_id)")
    parts.append("SELECT run, 'error', 'crop_detection_unknown', detection_id FROM c WHERE run IN (SELECT run FROM d WHERE detection_id <> '') AND NOT EXISTS (SELECT 1 FROM d WHERE d.run = c.run AND d.detection_id = c.detection_id)")
    whole = []
    for s in ("manifest", "ledger"):
        whole.append(("error", f"{s}_missing", f"coalesce({s}_rows, 0) = 0"))
        for name in ("mutation", "durable"):
            whole += [("error", f"{s}_{name}", f"{s}_{name} IN ('true', 'yes', '1')"), ("warning", f"{s}_{name}_unknown", f"{s}_{name} IS NULL OR {s}_{name} NOT IN ('true', 'yes', '1', 'false', 'no', '0')")]
        whole += [("error", f"{s}_{name}_differ", f"CAST({s}_{name} AS BIGINT) <> {name}") for name in _NUMBERS]
    whole += [("warning", f"manifest_{r}_differ", f"CAST(manifest_{r} AS BIGINT) <> {r}") for r in ("animal", "person", "vehicle", "other")]
    whole += [
        ("warning", "results_differ_from_inputs", "results <> inputs"), ("error", "source_video_missing", "video IS NOT NULL AND video NOT IN (SELECT path FROM files)"), ("warning", "source_video_unrecorded", "video IS NULL"),
        ("warning", "detection_links_unverified", "detections > 0 AND input_ids = 0"), ("warning", "crop_links_unverified", "crops > 0 AND detection_ids = 0"),
        ("error", "crops_over_budget", "crops > coalesce(nullif(CAST(ledger_max_crops AS BIGINT), 0), CAST(manifest_max_crops AS BIGINT))"), ("error", "bytes_over_budget", "crop_bytes > coalesce(CAST(ledger_max_mb AS DOUBLE), CAST(manifest_max_mb AS DOUBLE)) * 1048576"),
    ]
    parts += [f"SELECT run, '{level}', '{code}', '' FROM runs WHERE {rule}" for level, code, rule in whole]
    return " UNION ALL ".join(parts)


@query(f"{_tables_sql()} {_issues_sql()}")
def detector_issues(spark, sf_dir):
    return detector_audit.detector_issues(*detector_tables(spark, sf_dir))


@query(f"""{_tables_sql()}, found AS ({_issues_sql()}), levels AS (SELECT run, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM found GROUP BY run)
    SELECT t.*, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN coalesce(errors, 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM totals t LEFT JOIN levels USING (run)""")
def detector_report(spark, sf_dir):
    return detector_audit.detector_report(*detector_audit.audited(*detector_tables(spark, sf_dir)))
