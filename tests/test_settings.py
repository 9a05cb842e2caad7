"""Settings, calibration, snapshots and other sinks."""

import json

import pytest

from tessera.sources import manifests, settings


def test_settings(spark, tmp_path):
    (tmp_path / "s.ini").write_text('﻿stray line\n[Metrics]\n; note\nPX_PER_MM = "12.5"\nbroken\nscale_state = a=b\nscale_state = last\n[other]\nx=\n')
    assert settings.read_settings(spark, str(tmp_path / "s.ini")) == {"metrics": {"px_per_mm": "12.5", "scale_state": "last"}, "other": {"x": ""}}


def test_calibration_order():
    profile = json.dumps({"profile_name": "p1", "status": "draft", "units": "mm", "scale_estimates": {"front_px_per_mm": None, "px_per_mm": 7}, "physical_dimensions_mm": {"a": None, "b": " ", "c": 1}})
    assert settings.calibrate({"px_per_mm": "5"}, profile, 9.0).px_per_mm == 9.0
    assert settings.calibrate({"px_per_mm": "5"}, profile).source == "settings:px_per_mm"
    got = settings.calibrate({"px_per_mm": "-1"}, profile)
    assert (got.px_per_mm, got.source, got.state, got.confidence) == (7.0, "p1", settings.CANDIDATE, "provisional")
    assert got.warnings[:2] == ["physical_dimensions_mm_null_count=2", "profile_status_not_validated status=draft"]
    assert got.warnings[2:] == [f"scale_not_validated state={settings.CANDIDATE}", "scale_confidence_not_validated confidence=provisional"]
    assert settings.calibrate({}, '{"units": "cm", "landmarks_top_image_px": {"a": []}}').warnings == ["landmarks_top_image_px_empty_or_null_count=1", "profile_units_not_mm", "scale_estimates.front_px_per_mm_missing", "profile_status_not_validated status="]
    assert settings.calibrate({}).state == "uncalibrated_px_only"
    assert settings.calibrate({}, '{"profile_name": "p2"}').source == "p2"
    assert settings.calibrate({"px_per_mm": "2", "scale_state": settings.VALIDATED}).confidence == "validated"


def test_millimetres(spark):
    df = spark.createDataFrame([(10.0,)], "length_px double")
    assert settings.in_millimetres(df, ["length_px"], settings.calibrate({"px_per_mm": "4"})).first()["length_mm"] == 2.5
    assert settings.in_millimetres(df, ["length_px"], settings.calibrate({})).first()["length_mm"] is None


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "t")
    for version, n in ((1, 3), (2, 5)):
        manifests.snapshot(spark.range(n), folder, version)
    assert manifests.restore(spark, folder).count() == 5 and manifests.restore(spark, folder, 1).count() == 3
    with pytest.raises(Exception, match="EXISTS"):
        manifests.snapshot(spark.range(1), folder, 2)


def test_carried_and_wide(spark, tmp_path):
    assert manifests.carried(spark.range(1).selectExpr("id", "1 as src_a", "2 as b"), keep=("id",)).columns == ["id", "src_a", "src_b"]
    long = spark.createDataFrame([("i", "tip", "x", 1.0), ("i", "tip", "y", 2.0)], "image string, bodypart string, coord string, value double")
    assert tuple(manifests.wide_landmarks(long, ["base", "tip"]).first()) == ("i", None, None, 1.0, 2.0)
    manifests.write_by_name(spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int"), str(tmp_path / "out"), "name")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
