"""Rules of single values over literal tables that reach every branch."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, nested
from tessera.operators import audit, clusters, fusion, history, measures


def found(spark, cases, names, column):
    """What a rule gives for each case; cases are values, or tuples of them."""
    rows = [(k, *(c if isinstance(c, tuple) else (c,))) for k, c in enumerate(cases)]
    got = spark.createDataFrame(rows, f"id long, {names}").select("id", column.alias("found")).orderBy("id").collect()
    return [r.found for r in got]


NAMES = {
    "D:/clips\\cam_20260707_061725.mp4": "2026-07-07 06:17:25", "20260707-061725.mp4": "2026-07-07 06:17:25", "20260707 061725.mp4": "2026-07-07 06:17:25", "x20260707061725y": "2026-07-07 06:17:25",
    "2026-07-07_06-17-25.mp4": "2026-07-07 06:17:25", "2026_07_07 06_17_25": "2026-07-07 06:17:25", "2026-07_07-06_17-25.mp4": "2026-07-07 06:17:25", "cam_2026-07-07-06-17-25.mp4": "2026-07-07 06:17:25",
    "cam_2026-07-07.mp4": "2026-07-07 00:00:00", "20260707.mp4": "2026-07-07 00:00:00", "20261307_101010": None, "2026-13-07.mp4": None, "20260707_256199": "2026-07-07 00:00:00",
    "19990101_000000": None, "plain.mp4": None, "20260230.mp4": None, "a/20260707/b.mp4": None, "20240229.mp4": "2024-02-29 00:00:00", "": None,
}
TIMES = {
    ("2026-07-07T06:17:25", "20250101.mp4"): "2026-07-07T06:17:25", ("2026-07-07 06:17", None): "2026-07-07T06:17:00", ("2026-07-07", "x"): "2026-07-07T00:00:00", ("", "20250101.mp4"): "2025-01-01T00:00:00",
    ("soon", "cam_2026-07-07-06-17-25"): "2026-07-07T06:17:25", ("2026-07-07T06:17:25.987Z", None): "2026-07-07T06:17:25+00:00", ("2026-07-07T06:17:25-05:00", None): "2026-07-07T06:17:25-05:00", ("2026-02-30", "none"): None, (None, None): None,
}
HEADERS = {" Row ID ": "row_id", "_id_": "id", "Name -": "name", "a--b  c": "a_b_c", "Größe (px)": "gre_px", "x__y": "x_y", "---": "", "\ufeffFrame-Path": "frame_path"}
ROLES = {"Animal": "animal", "hummingbird": "animal", "person": "person", " HUMAN ": "person", "vehicle": "vehicle", "car": "vehicle", "Truck": "vehicle", "bus": "vehicle", "bird in car": "animal", "tree": "other", "": "other"}
RANKS = {(0.5, 40, 0, 0): 0.65, (None, 40, 100, 50): 0.3, (0.5, 5, 100, 200): 0.44, (1.5, 100, 10, 10): 1.0, (-1.0, 0, 10, 10): 0.0, (None, 0, None, 10): 0.0}
NUMBERS = {1: "row-000001 Bird00001", 99_999: "row-099999 Bird99999", 100_000: "row-100000 Bird100000", 1_234_567: "row-1234567 Bird1234567", 1_234_568: "row-1234568 Bird1234568"}
SHOWN = {1.5: "1.50000000", 0.123456789: "0.12345679", float("nan"): "", float("inf"): "", None: "", -2.0: "-2.00000000"}
OFFSETS = {"-0.25;0, 0.25": "-0.25|0.0|0.25", " ; ": "9.0", "": "9.0", None: "9.0", "1": "1.0", "1,,2;": "1.0|2.0"}
GUARDED = {("C:/Data/x/a.png", "c:\\data"): 1, ("C:/Data", "C:/data/"): 1, ("C:/DataX/a", "C:/Data"): 0, ("D:/Data/a", "C:/Data"): 0}
LABELS = {
    '{"prediction": {"label": " bird ", "score": 0.9}}': "bird|0.9",
    '{"prediction": {"label": "", "class": "finch", "prob": "0.5"}}': "finch|0.5",
    '{"prediction": {"predictions": [{"name": "a", "p": 0.2}, {"name": "b", "p": 0.7}, {"name": "c", "p": 0.7}, "d"]}}': "b|0.7",
    '{"prediction": {"classes": [], "top": {"taxon": "wren", "confidence": 0.4}}}': "wren|0.4",
    '{"prediction": ["x", "y", {"label": "z", "score": 0.1}, "w"]}': "z|0.1",
    '{"prediction": ["x", "y"]}': "y|none",
    '{"prediction": "plain", "classifications": [{"label": "late"}]}': "plain|none",
    '{"prediction": {"other": 1}, "classifications": [{"label": "late", "score": "soon"}]}': "late|none",
    '{"prediction": null}': "|none", "{}": "|none", "no json": "|none", None: "|none",
}
POINTS = {
    '{"tip_x": 4.5}': 4.5, '{"bill_tip_x": "7", "tip_x": 4}': 7.0, '{"bill_tip_x": -3, "tip_x": 0}': 0.0, '{"bill_tip_x": "", "bill_tip": {"x": 12, "y": 3}}': 12.0, '{"bill_tip": {}, "tip": {"x": 5}}': 5.0,
    '{"bill_tip": {"x": -8}}': -8.0, '{"bill_tip": 3, "tip": {"x": 5}}': -1.0, '{"bill_tip": {"y": 5}}': -1.0, "{}": -1.0, "no json": -1.0, None: -1.0,
}
#: Rows of the older layout (individual_name, name, status, label, notes, reviewed_at) and what they are once Ann becomes Bea.
OLDER = {
    ("Ann", "x", "active", "", None, None): "Bea|Bea|active||[now] moved|now", (" ", " Ann ", None, None, "old", "then"): "Bea|Bea|active||old [now] moved|then", ("Cy", "Ann", "false_positive", "leaf", "", None): "Bea|Bea|active||[now] moved|now",
    ("Cy", "Di", "false_positive", "", "n", None): "Cy|Di|false_positive||n|", (None, None, None, "leaf", None, None): "|||leaf||", ("ann", "", "active", None, None, None): "ann||active|||",
}
LAYOUT = "individual_name string, name string, identity_status string, training_label string, cleanup_notes string, reviewed_at string"
SEQUENCES = [("a", "0", "10", "5", "2", "3", "1", "2"), ("b", "9", "3", "5", "0", "0", "", ""), ("", "0", "1", "0", "", "", "", ""), ("c", "x", "1", "0", "0", "", "", ""), ("d", "0", "4", "2", "1", "1", "1", "1"), ("d", "0", "8", "2", "3", "3", "3", "3")]
FRAMES = [("f1", "a", "4", "5", "-1", "true", "written_debug_cache", ""), ("f1", "a", "12", "5", "6", "no", "written_debug_cache", "p"), ("", "a", "1", "5", "-4", "", "", ""), ("f2", "zz", "1", "1", "0", "", "", ""), ("f3", "d", "", "2", "0", "", "", ""), ("f4", "d", "6", "2", "4", "yes", "written_debug_cache", "q"), ("f5", "c", "1", "0", "1", "", "", "")]
ISSUES = [
    ("warning", "planned_expected_mismatch", "a"), ("error", "sequence_written_exceeds_selected", "a"), ("error", "sequence_start_after_end", "b"), ("error", "anchor_outside_sequence", "b"), ("error", "blank_sequence_id", "row 3"), ("error", "sequence_numeric_parse_failed", "c"),
    ("error", "duplicate_sequence_id", "d"), ("error", "written_frame_missing_output_path", "f1"), ("error", "duplicate_frame_id", "f1"), ("error", "frame_outside_sequence", "f1"), ("error", "offset_mismatch", "f1"), ("error", "unselected_frame_written", "f1"), ("error", "blank_frame_id", "row 3"),
    ("error", "frame_missing_sequence", "f2"), ("error", "frame_numeric_parse_failed", "f3"), ("error", "frame_numeric_parse_failed", "f5"), ("error", "sequence_frame_count_mismatch", "d"), ("error", "sequence_frame_count_mismatch", "c"),
    ("error", "blank_extracted_frame_id", "row 1"), ("error", "duplicate_extracted_frame_id", "f4"), ("error", "extracted_frame_not_in_sampled_frames", "f9"),
]
#: Edges (a, b, score) best first: 0-1-2 close a ring; 3 is apart from 0, so 2-3 is blocked, even once 3 and 4 are one; 6 is apart from 4.
MERGES = {
    (0, 1, 0.95): "used 0", (1, 2, 0.9): "used 0", (0, 2, 0.9): "already_connected 0", (2, 3, 0.85): "blocked 0", (3, 4, 0.8): "used 3", (0, 4, 0.8): "blocked 0",
    (5, 6, 0.75): "used 5", (4, 5, 0.7): "blocked 3", (7, 8, 0.65): "used 7", (8, 8, 0.66): "already_connected 7",
}


def test_single_values(spark):
    c = F.col
    assert found(spark, NAMES, "path string", F.date_format(clean.name_time(c("path")), "yyyy-MM-dd HH:mm:ss")) == list(NAMES.values())
    assert found(spark, TIMES, "captured string, path string", clean.any_time(c("captured"), c("path"))) == list(TIMES.values())
    assert found(spark, HEADERS, "header string", clean.header_name(c("header"))) == list(HEADERS.values())
    assert found(spark, ROLES, "class string", measures.role_of(c("class"))) == list(ROLES.values())
    assert found(spark, RANKS, "mean double, matches int, points_a int, points_b int", F.round(fusion.keypoint_rank(*map(c, ("mean", "matches", "points_a", "points_b"))), 6)) == list(RANKS.values())
    assert found(spark, NUMBERS, "n long", F.concat_ws(" ", clean.row_id(F.lit(None).cast("string"), c("n")), clean.auto_name(c("n")))) == list(NUMBERS.values())
    assert found(spark, SHOWN, "x double", clean.fixed_digits(c("x"), 8)) == list(SHOWN.values())
    assert found(spark, OFFSETS, "t string", F.array_join(F.transform(clean.number_list(c("t"), [9.0]), lambda x: x.cast("string")), "|")) == list(OFFSETS.values())
    assert found(spark, GUARDED, "path string, root string", clean.under_folder(c("path"), c("root")).cast("int")) == list(GUARDED.values())
    assert found(spark, {-3.0: 0, 12.345: 0, 100.001: 0, 0.125: 0, 0.375: 0}, "raw double", measures.legacy_score(c("raw"))) == [0.0, 12.34, 100.0, 0.12, 0.38]


def test_nested_values(spark):
    label = nested.nested_label(F.col("record"), ("prediction", "classifications"))
    assert found(spark, LABELS, "record string", F.concat_ws("|", label["label"], F.coalesce(label["score"].cast("string"), F.lit("none")))) == list(LABELS.values())
    assert found(spark, POINTS, "record string", nested.flexible_coordinate(F.col("record"), ("bill_tip_x", "tip_x"), ("bill_tip", "tip"), "x")) == list(POINTS.values())


def test_rows_of_the_older_layout(spark):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(OLDER)], f"id long, {LAYOUT}")
    new = history.updated(df, "Ann", "now", name="Bea", status="active", label="", note="moved")
    state = F.concat_ws("|", *(F.coalesce(c.split()[0], F.lit("")) for c in LAYOUT.split(", ")))
    assert [r.s for r in new.select("id", state.alias("s")).orderBy("id").collect()] == list(OLDER.values())
    assert sorted(r.id for r in history.rejected_for_training(df).collect()) == [2, 3, 4]


def test_every_code_of_the_sampling_audit(spark):
    text = lambda rows, names: spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], "row long, " + ", ".join(f"{n} string" for n in names.split()))
    s = text(SEQUENCES, "sequence_id start_frame_index end_frame_index anchor_frame_index sequence_frames_planned sequence_frame_count_expected sequence_frames_selected_for_extraction sequence_frames_written")
    f = text(FRAMES, "frame_id sequence_id source_frame_index anchor_frame_index offset_from_anchor_frames frame_selected_for_extraction frame_materialization_status output_frame_path")
    assert sorted(map(tuple, audit.sampling_issues(s, f, text([("",), ("f4",), ("f4",), ("f9",)], "frame_id")).collect())) == sorted(ISSUES)


@pytest.mark.parametrize("at_once", [2, 4096])
def test_repeated_ids_are_counted_once_and_listed_in_lots(spark, monkeypatch, at_once):
    monkeypatch.setattr(audit, "AT_ONCE", at_once, raising=False)
    s = spark.createDataFrame([(1, "s", "1", "9", "5", "5", "5", "0", "0")], "row long, sequence_id string, start_frame_index string, end_frame_index string, anchor_frame_index string, sequence_frames_planned string, sequence_frame_count_expected string, sequence_frames_selected_for_extraction string, sequence_frames_written string")
    f = spark.range(6).selectExpr("id AS row", "CASE WHEN id < 5 THEN 'f' END AS frame_id", "'s' AS sequence_id", "'5' AS source_frame_index", "'5' AS anchor_frame_index", "'0' AS offset_from_anchor_frames", "'no' AS frame_selected_for_extraction", "'' AS frame_materialization_status", "'' AS output_frame_path")
    found = audit.sampling_issues(s, f, spark.range(7).selectExpr("id AS row", "CASE WHEN id < 2 THEN 'f' WHEN id < 6 THEN 'g' END AS frame_id"))
    assert {(r.code, r.id): r["count"] for r in found.groupBy("code", "id").count().collect()} == {
        ("blank_frame_id", "row 5"): 1, ("blank_extracted_frame_id", "row 6"): 1, ("duplicate_frame_id", "f"): 4, ("duplicate_extracted_frame_id", "f"): 1, ("duplicate_extracted_frame_id", "g"): 3, ("extracted_frame_not_in_sampled_frames", "g"): 4,
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("Range (0, 6") + plan.count("Range (0, 7") == 5  # frames: rules, counts per sequence, ids; extracted: ids, blanks


@pytest.mark.parametrize("last", [0, 1000])
def test_merging_apart(spark, monkeypatch, last):
    """In rounds to the end, and with the last edges one after another."""
    monkeypatch.setattr(clusters, "LAST_EDGES", last)
    edges = spark.createDataFrame([(k, *e) for k, e in enumerate(MERGES)], "pair long, a long, b long, score double")
    decided = clusters.constrained(spark.range(10), edges, spark.createDataFrame([(3, 0), (4, 6)], "a long, b long"), 0.65)
    assert [f"{r.decision} {r.root}" for r in decided.orderBy("pair").collect()] == list(MERGES.values())
