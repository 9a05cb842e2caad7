"""Operators against brute force and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import audit, clusters, frames, history, identity, species
from tessera.sources import manifests
from tessera.streaming import incremental


def brute_greedy(edges, apart):
    group = {x: {x} for e in edges for x in e[1:3]}
    bad = {frozenset(p) for p in apart}
    out = {}
    for pair, a, b, _ in sorted(edges, key=lambda e: (-e[3], e[0])):
        merged = group[a] | group[b]
        if any(frozenset((x, y)) in bad for x in merged for y in merged if x < y):
            out[pair] = "blocked"
        elif group[a] is group[b]:
            out[pair] = "already_connected"
        else:
            out[pair] = "used"
            for x in merged:
                group[x] = merged
    return out


def test_merging_in_rounds_decides_like_one_edge_after_another(spark):
    dice = random.Random(3)
    edges, apart, n = [], [], 0
    for nodes, links, foes in [(9, 14, 3)] * 25 + [(12, 30, 4), (60, 300, 0)]:
        edges += [(len(edges) + k, *sorted(n + x for x in dice.sample(range(nodes), 2)), dice.choice([0.5, 0.6, 0.7, dice.random() / 2 + 0.5])) for k in range(links)]
        apart += [tuple(sorted(n + x for x in dice.sample(range(nodes), 2))) for _ in range(foes)]
        n += nodes
    falling = [(len(edges) + k, n + k, n + k + 1, 0.9 - k / 100) for k in range(4)]
    edges, apart, n = edges + falling, apart + [(n, n + 4), (n + 1, n + 3)], n + 5
    frame = spark.createDataFrame(edges, "pair long, a long, b long, score double")
    foes = spark.createDataFrame(apart, "a long, b long")
    got = clusters.constrained(spark.range(n), frame, foes, 0.5).collect()
    want = brute_greedy(edges, apart)
    assert len(got) == len(want) and {r["pair"]: r["decision"] for r in got} == want
    used = spark.createDataFrame([e for e in edges if want[e[0]] == "used"], frame.schema)
    roots = {r["id"]: r["root"] for r in clusters.components(spark.range(n), used).collect()}
    assert all(r["root"] == roots[r["a"]] for r in got)


def test_merging_with_nothing_to_merge_and_odd_rows(spark):
    nodes, none = spark.range(4), spark.createDataFrame([], "a long, b long")
    odd = spark.createDataFrame([(1, 0, 1, None), (2, 0, 1, float("nan")), (3, 1, 2, 0.7), (4, 3, 3, 0.9), (5, 0, 3, 0.8), (None, 0, 2, 0.9)], "pair long, a long, b long, score double")
    assert clusters.constrained(nodes, odd.limit(0), none, 0.5).count() == 0
    own = spark.createDataFrame([(0, 0)], "a long, b long")
    got = {r["pair"]: (r["decision"], r["root"]) for r in clusters.constrained(nodes, odd, own, 0.5).collect()}
    assert got == {3: ("used", 1), 4: ("already_connected", 3), 5: ("blocked", 0)}


def test_components_and_constraints(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(1, 0, 1, 0.9), (2, 1, 2, 0.8), (3, 4, 5, 0.7)], "pair long, a long, b long, score double")
    roots = {r["id"]: r["root"] for r in clusters.components(nodes, edges).collect()}
    assert roots == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}
    apart = spark.createDataFrame([(0, 2)], "a long, b long")
    decisions = {r["pair"]: r["decision"] for r in clusters.constrained(nodes, edges, apart, 0.65).collect()}
    assert decisions == {1: "used", 2: "blocked", 3: "used"}


def test_round_robin_tiers(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "b", 2), (5, "c", 2)], "id int, grp string, tier0 int")
    got = frames.tiered_round_robin(rows, [F.col("tier0") == 0, F.col("tier0") <= 1, F.lit(True)], "id", "grp", ["id"], 4)
    assert [r["id"] for r in got.collect()] == [1, 2, 3, 4]


def test_pairs_are_counted_and_not_listed(spark):
    dice = random.Random(5)
    rows = [(dice.choice(["a", "a", "b", None]), dice.choice([None, *range(0, 90, 7)])) for _ in range(120)]
    pairs = [(x, y) for k, x in enumerate(rows) for y in rows[:k] if x[0] and x[0] == y[0]]
    near = sum(x[1] is not None and y[1] is not None and abs(x[1] - y[1]) <= 30 for x, y in pairs)
    crops = spark.createDataFrame(rows, "source string, frame long")
    got = frames.pair_reasons(crops, F.col("source"), F.col("frame"), 30)
    assert {r["reason"]: r["n"] for r in got.collect()} == {"near_frame": near, "kept": len(pairs) - near}
    hot = spark.range(2_000_000).select(F.lit("a").alias("source"), (F.col("id") % 10).alias("frame"))
    assert [(r["reason"], r["n"]) for r in frames.pair_reasons(hot, F.col("source"), F.col("frame"), 30).collect()] == [("near_frame", 2_000_000 * 1_999_999 // 2)]
    assert frames.pair_reasons(crops.limit(0), F.col("source"), F.col("frame"), 30).count() == 0


def test_even_places(spark):
    df = spark.createDataFrame([(5,), (2,), (0,)], "n long")
    assert [r[0] for r in df.select(frames.even_places(F.col("n"), 3)).collect()] == [[0, 2, 4], [0, 1], []]


def test_identity_state(spark):
    assert [r["number"] for r in identity.free_numbers(spark.createDataFrame([(1,), (3,)], "n int"), "n", 2).collect()] == [2, 4]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    assert [r[0] for r in names.select(identity.rename_chain(F.col("n"), [("a", "b"), ("b", "c")])).collect()] == ["c", "c", "c"]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id long, vec array<double>")
    assert [r["identity"] for r in identity.assign_in_order(vectors, 0.79).orderBy("id").collect()] == [1, 2, 1]


def test_species(spark):
    df = spark.createDataFrame([([";;;;;;blank", "x;aves;;fam;;;bird", "x;aves;o;fam;gen;sp;some bird"], [0.9, 0.8, 0.1])], "l array<string>, s array<double>")
    assert df.select(species.best_label(F.col("l"), F.col("s"))["label"]).first()[0].endswith("some bird")


def test_audit(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0, 10.0, 10.0, 100.0), (2, 5.0, 0.0, 4.0, 10.0, 10.0, 10.0, 150.0)], "id int, x1 double, y1 double, x2 double, y2 double, width double, height double, area double")
    found = audit.issues(boxes, F.col("id"), audit.box_rules())
    assert sorted((r["id"], r["rule"]) for r in found.collect()) == [(2, "box_area"), (2, "box_order"), (2, "box_width")]
    assert audit.verdict([found]).first()["status"] == "FAIL"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Frame ID,Bad-Col!\n1,\n2,x\n")
    df = manifests.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["frame_id", "bad_col"] and df.count() == 2
    (tmp_path / "b.json").write_text('{"records": [{"a": 1}, {"a": 2}]}')
    assert [r["a"] for r in manifests.read_json_rows(spark, str(tmp_path / "b.json")).collect()] == [1, 2]
    (tmp_path / "c.csv").write_text("scorer,s,s\nbodyparts,tip,tip\ncoords,x,y\nimg1,1.5,2\n")
    assert sorted(tuple(r) for r in manifests.read_landmarks(spark, str(tmp_path / "c.csv")).collect()) == [("img1", "tip", "x", 1.5), ("img1", "tip", "y", 2.0)]
    assert [r["extension"] for r in manifests.list_files(spark, str(tmp_path), ["csv"]).collect()] == ["csv", "csv"]


def test_incremental_ingest(spark, tmp_path):
    folder, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    for frame in (first, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")):
        frame.coalesce(1).write.mode("append").parquet(folder)
        incremental.ingest(spark, folder, frame.schema, "k", table, mark).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(table).collect()) == [1, 2, 3]


def test_names_that_are_taken_or_blank_are_refused(spark):
    rows = spark.createDataFrame([(1, "p", "Ann"), (2, "q", "Bea"), (3, "r", None)], "id long, crop_path string, identity string")
    for source, target in [("Ann", "Bea "), ("Ann", " "), ("multibird", "Cy"), ("Ann", "multibird")]:
        with pytest.raises(ValueError):
            history.renamed(rows, source, target, "now")
    unknown = history.renamed(rows, "Di", "Cy", "now")
    assert unknown.action.isEmpty() and unknown.history.isEmpty() and unknown.rows.count() == 3
    for source in ("multibird", "Ann"):
        same = history.merged(rows, source, "Ann", "now")
        assert same.action.isEmpty() and same.history.isEmpty() and same.rows.count() == 3
    both = history.merged(rows, "Bea", "Ann", "now")
    assert [r["identity"] for r in both.rows.orderBy("id").collect()] == ["Ann", "Ann", None]
    assert [tuple(r) for r in both.action.collect()] == [("now", "merge_identity", "Bea", "Ann", 1)]
    assert history.known_paths(rows, spark.createDataFrame([("q",), ("q",), ("z",)], "crop_path string")).collect() == [(2,)]


def test_audit_of_empty_samples(spark):
    names = "sequence_id frame_id start_frame_index end_frame_index anchor_frame_index sequence_frames_planned sequence_frame_count_expected sequence_frames_selected_for_extraction sequence_frames_written source_frame_index offset_from_anchor_frames frame_selected_for_extraction frame_materialization_status output_frame_path"
    none = spark.createDataFrame([], "row long, " + ", ".join(f"{n} string" for n in names.split()))
    assert audit.sampling_issues(none, none.drop("start_frame_index", "end_frame_index"), none.select("row", "frame_id")).isEmpty()


def test_names_run_out(spark):
    """All numbers but two are taken: an error, or the first two rows get them and the third waits as it was."""
    taken = spark.range(3, 100_000).select(F.col("id"), F.format_string("Bird%05d", "id").alias("identity"))
    waiting = spark.createDataFrame([(100_001, " "), (100_002, None), (100_003, " ")], "id long, identity string")
    rows = taken.union(waiting).select("*", F.lit("active").alias("identity_status"), F.lit("reviewed").alias("review_status"), F.lit(None).cast("string").alias("reviewed_at"))
    with pytest.raises(ValueError):
        history.autonamed(rows, "now")
    got = history.autonamed(rows, "now", partly=True).where("id > 100000").orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [("Bird00001", "provisional", "auto", "now"), ("Bird00002", "provisional", "auto", "now"), (" ", "active", "reviewed", None)]
