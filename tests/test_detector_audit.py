"""The detector's audit over small tables that break each rule once."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import detector_audit as audit

DETECTION = "run string, detection_id string, frame_id string, detection_role string, class_name string, xmin string, ymin string, xmax string, ymax string, w string, h string, area string"
CROP = "run string, detection_id string, crop_path string, crop_bytes string, detection_role string, class_name string"
DETECTIONS = [
    ("a", "d1", "f1", "animal", "x", "0", "0", "10", "10", "10", "10", "100"), ("a", "d2", "f2", "", "Human", "0", "0", "10", "10", "12", "8", "90"), ("a", "d3", "f9", "", "Racecar", "5", "5", "4", "9", None, None, None),
    ("a", "d4", "", "zebra", "bird", "1", "x", "3", "4", None, None, None), ("a", "d5", "f1", None, None, "0", "0", "100", "100", "101", "101.0", "9804"), ("b", "e1", "f1", "", "bird", "0", "0", "1", "1", "", "", ""),
]
CROPS = [
    ("a", "d1", "/c/1.png", "10", "animal", ""), ("a", "d2", "/c/2.png", "11", "person", ""), ("a", "d7", "/c//./3.png", "", "", "car"), ("a", "d4", "/c/none.png", "1", "person", ""), ("a", "", "", "", "", ""), ("b", "e1", "/c/1.png", "10", "person", ""),
]
CLAIMS = [
    ("a", "manifest", "database_mutation", "false"), ("a", "manifest", "durable_evidence_written", "true"), ("a", "manifest", "detector_input_frames", "2"), ("a", "manifest", "detector_input_rows", "7"), ("a", "manifest", "detections_written", "4"), ("a", "manifest", "animal_detections", "3"),
    ("a", "manifest", "crop_export_mode", "Animal_Preview"), ("a", "manifest", "source_video", "/v/gone.mp4"), ("a", "manifest", "max_crop_exports_total", "4"), ("a", "manifest", "max_bytes_total_mb", "1"), ("a", "ledger", "max_crop_exports_total", "0"), ("a", "ledger", "bytes_written", "30"), ("a", "ledger", "database_mutation", "no"),
    ("b", "ledger", "source_video", "/v/b.mp4"), ("b", "ledger", "max_bytes_total_mb", "0.000001"), ("c", "manifest", "crop_export_rows", "0"),
]
FOUND = {
    ("a", "warning", "box_width", "d2"), ("a", "warning", "box_height", "d2"), ("a", "warning", "box_area", "d2"), ("a", "error", "box_order", "d3"), ("a", "error", "box_missing", "d4"),
    ("a", "error", "detection_input_unknown", "d3"), ("a", "error", "crop_detection_unknown", "d7"), ("a", "error", "crop_file_missing", "d4"), ("a", "warning", "crop_path_missing", None), ("a", "warning", "crop_bytes_differ", "d2"),
    ("a", "error", "crop_role_refused", "d2"), ("a", "warning", "crop_class_refused", "d7"), ("a", "error", "manifest_durable", ""), ("a", "error", "manifest_detections_differ", ""), ("a", "warning", "manifest_animal_differ", ""),
    ("a", "error", "ledger_crop_bytes_differ", ""), ("a", "warning", "ledger_durable_unknown", ""), ("a", "warning", "results_differ_from_inputs", ""), ("a", "error", "source_video_missing", ""), ("a", "error", "crops_over_budget", ""),
    ("b", "error", "manifest_missing", ""), ("b", "warning", "manifest_mutation_unknown", ""), ("b", "warning", "manifest_durable_unknown", ""), ("b", "warning", "ledger_mutation_unknown", ""), ("b", "warning", "ledger_durable_unknown", ""),
    ("b", "warning", "detection_links_unverified", ""), ("b", "error", "bytes_over_budget", ""), ("c", "error", "ledger_missing", ""), ("c", "warning", "manifest_mutation_unknown", ""), ("c", "warning", "manifest_durable_unknown", ""),
    ("c", "warning", "ledger_mutation_unknown", ""), ("c", "warning", "ledger_durable_unknown", ""), ("c", "warning", "source_video_unrecorded", ""),
}


@pytest.fixture(scope="module")
def tables(spark):
    inputs = spark.createDataFrame([("a", "", "f1"), ("a", None, "f2")], "run string, detector_input_id string, frame_id string")
    results = spark.createDataFrame([("a", "f1")], "run string, frame_id string")
    files = spark.createDataFrame([("/c/1.png", 10), ("/c/2.png", 12), ("/c/3.png", 9), ("/v/b.mp4", 5)], "path string, length long")
    return inputs, results, spark.createDataFrame(DETECTIONS, DETECTION), spark.createDataFrame(CROPS, CROP), files, spark.createDataFrame(CLAIMS, "run string, source string, field string, value string")


def test_each_rule_fires_once(tables):
    found = [tuple(r) for r in audit.detector_issues(*tables).collect()]
    assert len(found) == len(set(found))
    assert set(found) == FOUND


def test_report_counts_and_passes_only_without_errors(spark, tables):
    inputs, results, detections, crops, files, _ = tables
    counts = audit.totals(inputs, results, detections, audit.crops_with_files(crops, files))
    fine = spark.createDataFrame([("b", "warning", "x", "")], "run string, level string, code string, id string")
    report = {r.run: r for r in audit.detector_report(fine, counts).collect()}
    a = report["a"]
    assert (a.inputs, a.input_ids, a.results, a.detections, a.crops, a.crop_bytes) == (2, 2, 1, 5, 5, 31)
    assert [a[r] for r in audit.ROLES] == [1, 1, 1, 1, 1]
    assert (report["b"].status, report["b"].warnings, a.errors) == ("PASS", 1, 0)
    broken = fine.withColumn("level", F.lit("error"))
    assert {r.run: r.status for r in audit.detector_report(broken, counts).collect()} == {"a": "PASS", "b": "FAIL"}


def test_empty_tables_and_null_runs(tables):
    empty = [t.limit(0) for t in tables]
    assert audit.detector_issues(*empty).count() == 0
    inputs, results, detections, crops, files, claims = tables
    none = [t.withColumn("run", F.lit(None).cast("string")) for t in (inputs, results, detections, crops)]
    found = {r.code for r in audit.detector_issues(*none, files, claims.limit(0)).collect() if r.run is None}
    assert {"manifest_missing", "ledger_missing", "box_order", "detection_input_unknown", "crop_file_missing"} <= found


def test_rules_are_compiled_and_roles_worked_out_once(tables):
    inputs, results, detections, crops, files, claims = tables
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    issues, _ = audit.audited(*tables)
    assert "lambda" not in plan(issues)
    assert plan(audit.totals(inputs, results, detections, audit.crops_with_files(crops, files))).count("human") == 1


@pytest.mark.parametrize("few", [0, 100_000])
def test_links_of_a_null_run_are_not_those_of_a_blank_one(spark, monkeypatch, few):
    """By broadcast and by shuffle; a key that all rows have is among them."""
    monkeypatch.setattr(audit, "FEW_ROWS", few)
    inputs = spark.createDataFrame([("", "f1"), (None, "f2"), ("q", "f3")], "run string, frame_id string")
    rows = [(None, "d1", "f1"), (None, "d2", "f2"), ("", "d3", "f1"), ("", "d4", "f2"), ("z", "d5", "f1"), *(("q", f"q{k}", "f3" if k % 2 else "lost") for k in range(40))]
    detections = spark.createDataFrame(rows, "run string, detection_id string, frame_id string")
    none = [spark.createDataFrame([], t) for t in ("run string", "run string, detection_id string, crop_path string", "path string, length long", "run string, source string, field string, value string")]
    found = audit.detector_issues(inputs, none[0], detections, *none[1:]).where("code = 'detection_input_unknown'")
    assert {(r.run, r.id) for r in found.collect()} == {(None, "d1"), ("", "d4"), *(("q", f"q{k}") for k in range(0, 40, 2))}
    assert found.count() == 22


def test_report_and_issues_agree(tables):
    issues, counts = audit.audited(*tables)
    report = {r.run: (r.errors, r.warnings) for r in audit.detector_report(issues, counts).collect()}
    assert report == {run: tuple(sum(f[:2] == (run, level) for f in FOUND) for level in ("error", "warning")) for run in "abc"}
