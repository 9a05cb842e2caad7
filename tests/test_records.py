"""Records of JSON documents of every layout, and trainer rows from three of them."""

import json

from pyspark.sql import functions as F

from tessera.sources import records

DOCUMENTS = {
    ("species", '[{"a": 1}, 2, {"b": 3}]'): [(0, None, '{"a":1}'), (2, None, '{"b":3}')], ("species", '{"outputs": {"x": {"a": 1}, "y": 2}, "images": [{"c": 1}]}'): [(0, None, '{"a":1}')],
    ("species", '{"p/1.png": {"a": 1}, "p/2.png": {}}'): [(0, "p/1.png", '{"a":1}'), (1, "p/2.png", "{}")], ("species", '{"p": {"a": 1}, "q": 2}'): [], ("species", '{"predictions": [], "images": [{"a": 1}]}'): [],
    ("sampler", '{"records": [], "rows": [{"a": 1}]}'): [(0, None, '{"a":1}')], ("assistant", '{"predictions": null, "items": [{"a": 1}]}'): [(0, None, '{"a":1}')], ("trainer", '{"rows": {"a": {}}}'): [], ("trainer", "no json"): [], ("trainer", None): [], ("trainer", "7"): [],
}
OLD = {"image_path": "d/cam-frame-00000012-t3.5-animal-1.png", "accepted": "Yes", "bill_base_x": 4, "bill_base_y": "5", "bill_base_score": 0.5, "clicked_tip_x": 7, "clicked_tip_y": 8, "bill_length_px": 4.2, "notes": "n"}
NEW = {"image_path": "x.png", "label": records.LABEL_VALID, "bill_base_x": 3, "mmpose_bill_base_y": "", "bill_base_y": 9, "gpt_tip_x": 2, "corrected_bill_base_x": 0, "corrected_bill_base_y": 0, "clicked_tip_x": 3, "clicked_tip_y": 4, "image_index": 7, "source_video_key": "v", "best_bill_frame": True, "created_at": "then"}


def rows(spark, documents, kind):
    df = spark.createDataFrame([(f"d{k}", d) for k, d in enumerate(documents)], "file string, text string")
    return df.select("file", F.inline(records.json_records(F.col("text"), kind)))


def test_records_of_every_layout(spark):
    for (kind, text), wanted in DOCUMENTS.items():
        found = rows(spark, [text], kind).select("n", "key", F.to_json("record")).orderBy("n").collect()
        assert [tuple(r) for r in found] == wanted, (kind, text)


def test_older_and_newer_rows(spark, tmp_path):
    (tmp_path / "t.json").write_text("﻿" + json.dumps({"rows": [OLD, NEW, dict(OLD, accepted=False), dict(NEW, label="bad", clicked_tip_y="?"), {"label": None}]}), encoding="utf-8")
    found = records.trainer_rows(records.read_records(spark, str(tmp_path), "trainer"), ["file"], "now").orderBy("source_row_index").collect()
    old, new, refused, bad, blank = found
    assert found[0].__fields__ == ["file", "layout", *records.TRAINER_FIELDS]
    assert (old.layout, old.mmpose_bill_base_x, old.corrected_bill_base_x, old.clicked_tip_x, old.old_v01_accepted, old.created_at, old.frame_number, old.time_sec, old.source_video_key, old.image_index, old.training_use) == ("v01", 4.0, -1.0, 7.0, True, "now", 12, 3.5, "cam", 0, "unreviewed")
    assert (new.layout, new.mmpose_bill_base_x, new.mmpose_bill_base_y, new.gpt_bill_tip_x, new.corrected_bill_length_px, new.training_use, new.is_premium_training_row, new.image_index, new.best_bill_frame, new.created_at, new.neighbor_count, new.source_video_key) == ("v02", 3.0, -1.0, 2.0, 5.0, "bill_base_and_tip", True, 7, True, "then", 0, "v")
    assert (refused.clicked_tip_x, refused.old_v01_accepted, bad.training_use, bad.corrected_bill_length_px, bad.clicked_tip_y) == (-1.0, False, "exclude", -1.0, -1.0)
    assert (blank.layout, blank.label, blank.source_video_key, blank.image_path, blank.training_use) == ("v02", "", ".", "", "unreviewed")


def test_sampled_rows_by_rank(spark):
    manifest = [{"candidate_path": "b.png", "evidence_rank": 2, "bill_base_x": 9, "evidence_bucket": "Best"}, {"image_path": "a.png", "identity_evidence_score": 0.5}, {"candidate_path": "", "evidence_rank": 0}, {"candidate_path": "c.png", "evidence_rank": 1, "source_key": "s"}, {"image_path": "d.png", "identity_evidence_score": 0.9}]
    found = records.sampled_rows(rows(spark, [json.dumps({"candidates": manifest}), json.dumps(manifest[:1])], "sampler"), "file", "now").orderBy("file", "image_index").collect()
    assert [(r.file, r.image_index, r.image_path) for r in found] == [("d0", 0, "c.png"), ("d0", 1, "b.png"), ("d0", 2, "d.png"), ("d0", 3, "a.png"), ("d1", 0, "b.png")]
    assert (found[1].mmpose_bill_base_x, found[1].best_bill_frame, found[0].source_video_key, found[0].sequence_id) == (-1.0, True, "s", "s")
    assert (found[1].notes, found[3].notes) == ("sampler manifest import; bucket=Best; rank=2; score=", "sampler manifest import; bucket=; rank=; score=0.5")
    assert records.sampled_rows(rows(spark, [], "sampler"), "file", "now").count() == 0


def test_image_rows(spark):
    found = records.image_rows(spark.createDataFrame([("b-frame-000003.png",), ("a.png",), ("a.png",), (None,)], "path string"), "path", "now").orderBy("image_index").collect()
    assert [(r.image_index, r.source_row_index, r.image_path, r.frame_number, r.notes) for r in found] == [(0, 0, "a.png", -1, records.CROP_ONLY_NOTE), (1, 1, "b-frame-000003.png", 3, records.CROP_ONLY_NOTE)]


def test_a_value_is_read_once(spark):
    """However often a rule names it, so that a row takes no longer than its fields."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        found = records.trainer_rows(spark.sql("SELECT 0L AS n, parse_json('{}') AS record"), [], "now")
        plan = found._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("$.gpt_confidence,") == plan.count("$.gpt_bill_base_x,") == 1
