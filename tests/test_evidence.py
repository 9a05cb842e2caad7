"""Boundary cases of poses, crops, names, labels, review changes and numbering."""

import random

from pyspark.sql import functions as F

from tessera.functions import names, plane, quality
from tessera.operators import curation, frames, identity, lookups, numbering, pose, profiles, species


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_ranks_and_common_names(spark):
    labels = ["x;c;o;f;g;s;bird", "x;c;o;f;;s;", "x;c;o;;;;", "x;c;;;;;", "x;;;;;;thing", ";;;;;;Blank", "", "short", None]
    assert values(spark, species.rank_of(F.col("l")), [(t,) for t in labels], "l string") == ["species", "family", "order", "class", "broad", "blank", "unavailable", "broad", "unavailable"]
    assert values(spark, species.common_name(F.col("l")), [("a;b;c;d;e;f; owl ",), ("plain",), (None,)], "l string") == ["owl", "plain", ""]


def test_best_label(spark):
    genus, family, bird, blank = "x;c;o;f;g;;genus", "x;c;o;f;;;family", "x;c;;;;;bird", ";;;;;;blank"
    rows = [([family, genus], [0.99, 0.01]), ([genus, genus + " b"], [0.5, 0.5]), ([genus, family], [None]), ([blank], [0.9]), ([], [])]
    got = values(spark, species.best_label(F.col("l"), F.col("s")), rows, "l array<string>, s array<double>")
    assert [g and g["label"] for g in got] == [genus, genus, genus, None, None]
    assert values(spark, species.best_label(F.col("l"), F.col("s")), [([blank, bird], [0.9, 0.2])], "l array<string>, s array<double>")[0]["score"] == 0.2


def test_proposals(spark):
    rows = [("proposed", 0.7), ("proposed", 0.3), ("proposed", 0.29), ("proposed", None), ("unknown_bird", 0.9)]
    band = species.confidence_band(F.col("p"), F.col("s"))
    assert values(spark, species.proposal(F.col("s"), band, F.lit(False)), rows, "s string, p double") == ["proposed_candidate_high", "proposed_candidate_low", "weak_outside_group", "proposed_candidate_unscored", "unknown_bird"]


def test_crop_names(spark):
    rows = [("a/20260125_154811_001-CAM2-frame-00001740-t0057.94-animal-002-conf057-pad20.png",), ("dir/plain_head.png",)]
    got = spark.createDataFrame(rows, "p string").select(*(c.alias(n) for n, c in names.crop_name(F.col("p")).items()), names.source_key(F.col("p")).alias("key"), names.frame_number(F.col("p")).alias("number")).collect()
    assert tuple(got[0]) == ("20260125_154811_001-CAM2", 1740, 57.94, 2, 0.57, "20260125_154811_001-CAM2", 1740)
    assert tuple(got[1]) == ("plain_head", -1, -1.0, -1, 0.0, "plain", None)


def test_pair_suppression(spark):
    rows = [("x-frame-000010.png", "x-frame-000040.png"), ("x-frame-000010.png", "x-frame-000041.png"), ("x-frame-000010.png", "y-frame-000010.png"), ("x.png", "x.png")]
    assert values(spark, names.suppressed(F.col("a"), F.col("b"), False, 30), rows, "a string, b string") == ["near_frame", None, None, None]
    assert values(spark, names.suppressed(F.col("a"), F.col("b"), True, 30), rows, "a string, b string") == ["same_source", "same_source", None, "same_source"]


def test_vector_texts(spark):
    texts = ["[1, 2.5]", '{"vector": [1]}', '{"other": [1]}', "[]", '[1, "x"]', "no", "", None]
    assert values(spark, names.vector_text(F.col("t")), [(t,) for t in texts], "t string") == [[1.0, 2.5], [1.0], None, None, None, None, None, None]


def test_crop_boxes(spark):
    box = plane.crop_box(*map(F.col, ("a", "b", "c", "d")), F.lit(100), F.lit(80), F.lit(0.0))
    rows = [(1.5, 2.0, 9.2, 9.0), (0.0, 0.0, 3.0, 9.0), (99.0, 5.0, 140.0, 20.0), (None, 1.0, 2.0, 3.0), (9.0, 9.0, 1.0, 1.0)]
    assert [b and tuple(b) for b in values(spark, box, rows, "a double, b double, c double, d double")] == [(1, 2, 10, 9), None, None, None, (1, 1, 9, 9)]


def test_pose_without_points(spark):
    points = spark.createDataFrame([(1, 4, 50.0, 40.0, 0.9, True), (2, 2, 5.0, 5.0, 0.1, False)], "id int, keypoint int, x double, y double, score double, visible boolean")
    got = {(r["id"], r["region"]): r for r in pose.regions(pose.wide(points, ["id"]), F.lit(200), F.lit(160)).collect()}
    assert [got[1, r]["ok"] for r in ("head", "throat", "body", "tail")] == [False, False, False, True]
    assert abs(got[1, "tail"]["confidence"] - 0.9 * 0.55) < 1e-9 and abs(got[1, "tail"]["scale"] - 35.2) < 1e-9
    assert not any(got[2, r]["ok"] or got[2, r]["box"] for r in ("head", "throat", "body", "tail"))


def test_likelihoods_and_reasons(spark):
    rows = [(1.0, 0.9, None), (None, 0.9, 0.9), (1.0, 0.3, 0.9)]
    found = quality.labeled_length(F.lit(0.0), F.lit(0.0), F.col("p"), F.col("x"), F.lit(1.0), F.col("q"))
    got = spark.createDataFrame(rows, "x double, p double, q double").select(*(c.alias(n) for n, c in found.items())).collect()
    assert [(r["band"], r["present"], r["eligible"], r["review"]) for r in got] == [("strong", True, True, True), ("strong", False, False, False), ("very_weak_review", True, False, False)]
    reason = quality.length_eligibility(F.lit(True), F.lit(quality.EVIDENCE_READY), F.col("x"), F.col("p"), F.col("q"), F.lit(True))
    assert values(spark, reason, [(1.0, None, None), (0.0, 0.9, 0.9), (1.0, 0.09, 0.9), (1.0, 0.1, 0.09)], "x double, p double, q double") == [quality.READY, *(quality.REFUSED[k] for k in ("length", "tip", "base"))]


def test_matches_without_scores(spark):
    empty = F.array().cast("array<double>")
    assert values(spark, quality.match_label(F.col("m"), F.lit(None).cast("double")), [(45,), (20,), (19,)], "m int") == ["possible_local_match", "weak_possible_local_match", "weak_or_no_local_match"]
    assert [c for c in spark.range(1).select(*quality.score_summary(empty).values()).first()] == [None] * 4
    assert list(spark.range(1).select(*quality.descriptor_score(empty, F.lit(9), F.lit(9)).values()).first()) == [0.0, 0, 0.0]


def test_review_changes(spark):
    df = spark.createDataFrame([(1, None, "new", "", None), (2, "sandbox", "auto", "x", "old"), (3, "active", None, "", "")], "id int, identity_status string, review_status string, training_label string, notes string")
    reset = {r["id"]: r["notes"] for r in curation.reset_to_raw(df, F.lit(True), "sandbox").collect()}
    assert reset == {1: "returned to raw from sandbox", 2: "old; returned to raw from sandbox", 3: "returned to raw from sandbox"}
    assert {r["id"]: r["notes"] for r in curation.marked(df, F.col("id") == 2, "junk").collect()}[2] == "old"
    assert [r[0] for r in df.orderBy("id").select(curation.lane(F.col("identity_status"))).collect()] == ["raw", "sandbox", "true_names"]
    assert curation.run_status(df.limit(0).withColumn("state", F.lit("full")), "state", F.lit(True), True, True).first()["status"] == "FAIL_NO_OBSERVATIONS"


def test_lookups(spark):
    staged = spark.createDataFrame([(0, "a/One.png"), (1, "b\\two.PNG"), (2, "c.png")], "place int, path string")
    found = spark.createDataFrame([(0, "x/TWO.png", 5), (1, "one.png", None)], "place int, path string, v int")
    assert [(r["v"], r["matched"]) for r in lookups.by_name_or_place(staged, found, "v").orderBy("place").collect()] == [(None, "name"), (5, "name"), (None, "none")]


def test_frames_of_bursts_and_previews(spark):
    got = frames.burst_frames(spark.createDataFrame([(1, 12), (2, 0)], "video int, frames long"), 10, 5, 1, 0).orderBy("frame").collect()
    assert [(r["frame"], r["burst"], r["role"]) for r in got] == [(0, 0, "base"), (5, 1, "burst"), (10, 1, "base")]
    rows = spark.createDataFrame([("a", k, 6) for k in range(1, 10)], "g string, f int, anchor int")
    assert sorted(r["f"] for r in frames.preview(rows, "g", "f", "anchor", 4).collect()) == [1, 5, 6, 9]
    times = frames.anchor_times(spark.createDataFrame([(1, 0.0), (2, 11.0)], "video int, seconds double"), 4.0, 9).orderBy("video", "anchor").collect()
    assert [(r["video"], round(r["seconds"], 3)) for r in times] == [(1, 0.0), (2, 0.0), (2, 4.0), (2, 8.0), (2, 10.999)]


def test_durations(spark):
    assert values(spark, profiles.duration_text(F.col("s")), [(12.34,), (60.0,), (3725.9,), (None,)], "s double") == ["12.3 sec", "1 min 0 sec", "62 min 5 sec", "TBD"]


def test_numbers_have_no_gaps(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("key"))
    got = numbering.numbered(df, [F.col("key").desc(), "id"], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001)) and [(-r["key"], r["id"]) for r in got] == sorted((-r["key"], r["id"]) for r in got)
    assert numbering.numbered(df.limit(0), ["id"], "n").count() == 0


def test_identities_in_order_match_brute_force(spark):
    dice = random.Random(5)
    rows = [(k, [dice.gauss(0, 1) for _ in range(3)]) for k in dice.sample(range(1000), 120)]
    names_given, store = {}, []
    for k, v in sorted(rows):
        norm = sum(x * x for x in v) ** 0.5
        best = None
        for name, u, length in store:
            sim = round(sum(x * y for x, y in zip(u, v, strict=True)) / norm / length, 6)
            if best is None or sim > best[0]:
                best = (sim, name)
        names_given[k] = best[1] if best and best[0] >= 0.9 else max(names_given.values(), default=0) + 1
        store.append((names_given[k], v, norm))
    got = identity.assign_in_order(spark.createDataFrame(rows, "id long, vec array<double>"), 0.9)
    assert {r["id"]: r["identity"] for r in got.collect()} == names_given
