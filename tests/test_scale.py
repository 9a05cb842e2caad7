"""Hot keys, large groups and long chains: the results of plain Python, and no task that holds it all."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clusters, identity, lookups, paths, quantiles, replay, scorers, spread
from tessera.sources import versions


def largest_task(df):
    """Rows of the largest partition, and all rows."""
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes), sum(sizes)


def test_a_hot_key_stays_where_its_rows_are(spark):
    rows = spark.range(0, 60_000, 1, 12).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit(1).alias("heavy"))
    table = spark.range(0, 60_000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(7, 1)], "k long, v long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spread.join_counted(rows, table, ["k"], ["id"])
        assert out.columns == ["id", "k", "heavy", "v"]
        most, total = largest_task(out)
        assert total == 60_000 and most < 2 * total / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = {r.id: r.v for r in out.collect()}
    assert all(got[i] == (1 if i % 3 == 0 or i == 7 else 2 * i if i % 2 == 0 else None) for i in range(60_000))


def test_first_match_with_a_hot_value(spark):
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, " Hot ").otherwise(F.concat(F.lit("v"), "id")).alias("a"), F.concat(F.lit("V"), F.col("id") + 1).alias("b"))
    right = spark.range(0, 9000, 5).select(F.col("id").alias("o"), F.when(F.col("id") == 100, "HOT").otherwise(F.concat(F.lit("v"), "id")).alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("value"))
    got = {r.id: (r.value, r.by_key) for r in identity.first_match(left, "id", ["a", "b"], right, "o", ["k"], "value").collect()}
    for i in range(9000):
        keys = ["hot" if i % 3 == 0 else f"v{i}", f"v{i + 1}"]
        want = next(((o if o % 10 == 0 else None, k) for k, key in enumerate(keys) for o in ([100] if key == "hot" else [int(key[1:])]) if key == "hot" or (o % 5 == 0 and o < 9000 and o != 100)), (None, None))
        assert got[i] == want, i
    both = lookups.by_any_key(left, "id", ["a", "b"], right, "o", ["k", "k"], "value")
    assert both.count() == 9000


def test_quantiles_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 200)
    monkeypatch.setattr(quantiles, "BINS", 32)
    rng = np.random.default_rng(4)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("ties", float(x)) for x in rng.integers(0, 4, 900)] + [("wide", float(10.0**x)) for x in rng.uniform(-200, 200, 700)] + [("same", 2.5)] * 400 + [("few", 1.0), ("few", 4.0), (None, 3.0), ("none", None), ("nan", math.nan), ("huge", -1.7e308), ("huge", 1.7e308)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0, "p0": 0.0}
    got = {r.k: r.asDict() for r in quantiles.exact_quantiles(df, ["k"], F.col("v"), shares).collect()}
    values = defaultdict(list)
    for k, v in rows:
        if v is not None and not math.isnan(v):
            values[k].append(v)
    assert set(got) == set(values)
    assert got["huge"]["p50"] == 0.0
    del values["huge"]  # its range overflows in the plain library
    for k, v in values.items():
        for name, s in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(v, s), rel=1e-12), (k, name)


def test_first_distinct_texts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.choice(["x", " y ", "z", "", None, "w", "y"]), n) for n in range(400)] + [("c", " ", 1), ("c", None, 2)]
    got = {r.k: r.texts for r in quantiles.first_distinct(spark.createDataFrame(rows, "k string, t string, o long").repartition(5), "k", F.col("t"), F.col("o"), 3).collect()}
    want = {}
    for k in "abc":
        seen = list(dict.fromkeys(t.strip() for key, t, _ in rows if key == k and t and t.strip()))
        want[k] = ";".join(seen[:3])
    assert got == want


def replayed_by_hand(rows, log):
    out = {}
    for i, name, since in rows:
        for entry, old, new in sorted(log):
            if (since is None or entry > since) and old == name and old is not None and new is not None:
                name = new
        out[i] = name
    return out


def test_replay_equals_one_entry_after_another(spark, chunk=16):
    rng = random.Random(chunk)
    names = [f"n{k}" for k in range(9)]
    log = [(k * 2, rng.choice(names), rng.choice(names)) for k in range(150)] + [(301, None, "n1"), (303, "n1", None)]
    log += [(400 + k, f"c{k}", f"c{k + 1}") for k in range(70)]  # a long chain
    rows = [(k, rng.choice([*names, "other", None, "c0"]), rng.choice([None, rng.randrange(0, 420)])) for k in range(200)]
    frame = spark.createDataFrame(rows, "id long, name string, since long")
    entries = spark.createDataFrame(log, "entry long, old string, new string").repartition(3)
    for until in (None, 120):
        got = {r.id: r.final for r in replay.replayed(frame, entries, F.col("since"), until=until, chunk=chunk).collect()}
        assert got == replayed_by_hand(rows, [e for e in log if until is None or e[0] <= until])


def test_replay_of_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """A chain of 3000 entries: pointers are only doubled from chunk to chunk, so what is staged doesn't grow with the chain."""
    log = [(e, f"n{e % 5}", f"n{(e + 1) % 5}") for e in range(3000)]
    rows = [(i, f"n{i % 6}", None if i % 4 == 0 else i * 31) for i in range(100)]
    staged, cut = [], replay.cut
    monkeypatch.setattr(replay, "cut", lambda df: staged.append(1) or cut(df))
    got = replay.replayed(spark.createDataFrame(rows, "id long, name string, since long"), spark.createDataFrame(log, "entry long, old string, new string"), F.col("since"), chunk=1000)
    assert {r.id: r.final for r in got.collect()} == replayed_by_hand(rows, log)
    assert len(staged) <= 8


def test_replay_of_a_hot_name(spark):
    """Every third entry gives or takes one name."""
    log = [(k, "hot" if k % 3 == 0 else f"a{k % 50}", f"a{k % 7}" if k % 3 == 0 else "hot") for k in range(3000)]
    rows = [(k, f"a{k % 50}", None) for k in range(50)]
    got = replay.replayed(spark.createDataFrame(rows, "id long, name string, since long"), spark.createDataFrame(log, "entry long, old string, new string"), chunk=64)
    assert {r.id: r.final for r in got.collect()} == replayed_by_hand(rows, log)


def apart_by_hand(nodes, edges, sightings):
    of, out = {n: {n} for n in nodes}, {}
    seen = {i: (f, a) for i, f, a in sightings if f and f.strip()}
    for pair, a, b, _ in sorted(edges, key=lambda e: (-e[3], e[0])):
        x, y = of[a], of[b]
        clash = x is not y and any(i in seen and j in seen and seen[i][0] == seen[j][0] and not (seen[i][1] and seen[i][1].strip() and seen[i][1] == seen[j][1]) for i in x for j in y)
        out[pair] = "already_connected" if x is y else "blocked" if clash else "used"
        if out[pair] == "used":
            for n in y:
                x.add(n)
            for n in y:
                of[n] = x
    return out


@pytest.mark.parametrize("n,last", [(60, 1000), (7, 0)])
def test_membership_decides_as_listed_pairs_do(spark, monkeypatch, n, last):
    """One after another, and for a few rows in rounds of joins to the end."""
    monkeypatch.setattr(clusters, "LAST_EDGES", last)
    rng = random.Random(6)
    nodes = list(range(n))
    sightings = [(i, rng.choice(["f1", "f2", "f3", " ", None]), rng.choice(["x", "y", "", None, "x"])) for i in nodes]
    edges = [(k, *rng.sample(nodes, 2), rng.choice([0.9, 0.8, 0.7, 0.75])) for k in range(2 * n)]
    e = spark.createDataFrame(edges, "pair long, a long, b long, score double")
    frame = spark.createDataFrame(sightings, "id long, frame string, animal string")
    nodes_ = spark.createDataFrame([(n,) for n in nodes], "id long")
    want = apart_by_hand(nodes, edges, sightings)
    assert {"blocked", "used", "already_connected"} <= set(want.values())
    got = {r.pair: r.decision for r in clusters.constrained(nodes_, e, spark.createDataFrame([], "a long, b long"), 0.5, frame).collect()}
    assert got == want
    from tessera.operators.fusion import known_different

    listed = known_different(frame).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    assert {r.pair: r.decision for r in clusters.constrained(nodes_, e, listed, 0.5).collect()} == want


def test_a_crowded_frame_lists_no_pairs(spark):
    """100,000 sightings in one frame have five thousand million pairs; one row each is all there is."""
    n = 100_000
    sightings = spark.range(n).select("id", F.lit("f").alias("frame"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("bird"), (F.col("id") % 10).cast("string"))).alias("animal"))
    edges = spark.createDataFrame([(0, 0, 10, 0.9), (1, 0, 2, 0.8), (2, 10, 20, 0.7), (3, 1, 3, 0.95)], "pair long, a long, b long, score double")
    got = {r.pair: r.decision for r in clusters.constrained(spark.range(n), edges, spark.createDataFrame([], "a long, b long"), 0.5, sightings).collect()}
    assert got == {0: "used", 1: "blocked", 2: "used", 3: "blocked"}


def test_every_pair_gets_decision_and_reason(spark):
    pairs = [(0, 0, 1, 0.9, "review_top_candidate", False), (1, 0, 2, 0.8, "review_top_candidate", False), (2, 1, 2, 0.7, "review_candidate", True), (3, 0, 9, 0.9, "review_top_candidate", False), (4, 3, 4, None, "unranked_missing_recipe_inputs", False), (5, 3, 4, 0.2, "low_priority_candidate", None), (6, 3, 4, 0.45, "low_priority_candidate", False), (7, 0, 1, 0.6, "review_weak_candidate", False)]
    out = clusters.decided(spark.range(5), spark.createDataFrame(pairs, "pair long, a long, b long, score double, bucket string, differ boolean"), 0.4)
    assert {r.pair: (r.decision, r.reason) for r in out.collect()} == {
        0: ("used", "eligible_fusion_edge"), 1: ("blocked", "blocked_would_merge_known_different_members"), 2: ("not_used", "blocked_known_different_copresence"), 3: ("not_used", "missing_row_lookup"), 4: ("not_used", "not_used_missing_fusion_score"),
        5: ("not_used", "not_used_below_cluster_threshold_0.400"), 6: ("not_used", "not_used_bucket_low_priority_candidate"), 7: ("already_connected", "same_existing_cluster"),
    }


def test_buckets_and_edges_speak_alike(spark):
    """What the recipe calls low is what the cluster refuses."""
    from tessera.operators import fusion

    score = F.col("s")
    reason = fusion.edge_reason(score, fusion.review_bucket("fusion", score, F.lit(False)), F.lit(False), 0.4)
    got = spark.createDataFrame([(0.45,), (0.5,), (0.39,), (None,)], "s double").select(reason.alias("r")).collect()
    assert [r.r for r in got] == ["not_used_bucket_low_priority_candidate", "eligible_fusion_edge", "not_used_below_cluster_threshold_0.400", "not_used_missing_fusion_score"]


def test_paths_by_hand(spark):
    files = spark.createDataFrame([("/p/a.png",), ("/m/a.png",), ("/m//sub/./b.png",), ("C:\\x\\c.png",), ("/m/crops/d.png",), (None,)], "path string")
    rows = spark.createDataFrame([(0, "a.png"), (1, " sub/b.png "), (2, "C:/x/c.png"), (3, "gone.png"), (4, "/gone.png"), (5, ""), (6, None), (7, "A.png"), (0, "a.png")], "id long, path string").dropDuplicates()
    got = {r.id: (r.resolved, r.exists, r.source) for r in paths.resolved(rows, "id", "path", paths.manifest_candidates(F.col("path"), F.lit("/p/"), F.lit("/m")), files).collect()}
    assert got == {0: ("/p/a.png", True, "relative_to_project_root"), 1: ("/m/sub/b.png", True, "relative_to_manifest_dir"), 2: ("C:/x/c.png", True, "absolute"), 3: ("/p/gone.png", False, "relative_to_project_root_missing"), 4: ("/gone.png", False, "absolute_missing"), 5: ("", False, "blank"), 6: ("", False, "blank"), 7: ("/p/A.png", False, "relative_to_project_root_missing")}
    crops = paths.resolved(spark.createDataFrame([(1, "old/place/d.png")], "id long, path string"), "id", "path", paths.crop_candidates(F.col("path"), F.lit("/p"), F.lit("/m")), files)
    assert crops.first()[2:] == ("/m/crops/d.png", True, "crops")


def test_versions(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    df = spark.createDataFrame([(1, "a", [1.5]), (2, None, None)], "id long, name string, x array<double>")
    one = store.commit(df, "first")
    two = store.commit(df.where("id = 1"), "second")
    three = store.commit(df.union(df), "third")
    assert [m.version for m in store.manifests()] == [1, 2, 3] and store.read().count() == 4 and store.read(1).count() == 2
    assert store.undo().version == 4 and store.read().count() == 1  # what was before the third
    assert store.undo().version == 5 and store.read().count() == 2
    with pytest.raises(ValueError):
        store.undo()
    assert store.restore(3).version == 6 and store.read().count() == 4
    with pytest.raises(versions.VersionExists):
        store.commit(df, version=2)
    assert one.digest != two.digest and three.rows == 4


def test_torn_versions_are_passed_over(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/store")
    whole = store.commit(spark.range(1000).repartition(4), "whole")
    torn = store.commit(spark.range(2000).repartition(4), "torn")
    parts = sorted((tmp_path / "store" / torn.data).glob("part-*"))
    parts[0].unlink()  # a file that was never written
    assert store.current() == whole and store.read().count() == 1000
    with pytest.raises(ValueError):
        store.read(2)
    cut = store.commit(spark.range(3000).repartition(2), "cut")
    part = next((tmp_path / "store" / cut.data).glob("part-*"))
    part.write_bytes(part.read_bytes()[:100])
    for crc in (tmp_path / "store" / cut.data).glob(".part-*"):
        crc.unlink()
    assert store.current() == whole
    (tmp_path / "store" / "manifests" / "00000004.json").write_text('{"version": 4, "da')  # a half-written manifest
    assert store.current() == whole and store.commit(spark.range(5)).version == 5 and store.read().count() == 5
    assert store.undo().version == 6 and store.read().count() == 1000


def test_scorers_fall_back(spark):
    def missing():
        import no_such_library  # noqa: F401

    plain = scorers.Scorer("sum", lambda: 2.0, lambda model, a, b: model * (a + b))
    best = scorers.Scorer("network", missing, lambda model, a, b: a, fallback=plain)
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (1e308, 1e308)], "a double, b double")
    got = [tuple(r.s) for r in df.select(scorers.scored(best, F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == (6.0, "sum") and got[1] == (None, "sum") and got[2] == (None, "sum")
    with pytest.raises(Exception, match="no_such_library"):
        df.select(scorers.scored(scorers.Scorer("alone", missing, lambda model, a, b: a), F.col("a"), F.col("b")).alias("s")).collect()


def test_next_entry_reads_no_partition_twice(spark):
    """A frame up to the partition's end is summed up anew for every row: quadratic in the rows of a name."""
    log = spark.range(100).select(F.col("id").alias("entry"), F.lit("a").alias("old"))
    plan = replay.next_leave(spark.range(100).select("id", F.lit("a").alias("name"), F.col("id").alias("since")), log, "name", "since")
    assert "unboundedfollowing" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("most,marks", [(24, 10_000), (24, 12)])
def test_edges_taken_in_several_batches(spark, monkeypatch, most, marks):
    """Batches of the best open edges, one after another; with little room for what is apart, rounds of joins in between."""
    monkeypatch.setattr(clusters, "LAST_EDGES", most)
    monkeypatch.setattr(clusters, "LAST_MARKS", marks)
    taken, whole = [], clusters._first_edges

    def counted(*args):
        taken.append(whole(*args))
        return taken[-1]

    monkeypatch.setattr(clusters, "_first_edges", counted)
    rng = random.Random(8)
    nodes = list(range(40))
    sightings = [(i, f"f{i % 9}", rng.choice(["x", "y", "", None, "x"])) for i in nodes]
    edges = [(k, *rng.sample(nodes, 2), rng.choice([0.9, 0.8, 0.7, 0.75])) for k in range(160)]
    got = clusters.constrained(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "pair long, a long, b long, score double"), spark.createDataFrame([], "a long, b long"), 0.5, spark.createDataFrame(sightings, "id long, frame string, animal string"))
    assert {r.pair: r.decision for r in got.collect()} == apart_by_hand(nodes, edges, sightings)
    assert len(taken) > 1 and any(t is not None for t in taken)


def test_edges_in_slices(spark, monkeypatch):
    """A slice's edges are looked up when its turn comes; the decisions are those of one edge after another."""
    monkeypatch.setattr(clusters, "FIRST_SLICE", 12)
    monkeypatch.setattr(clusters, "SENT_NODES", 0)
    rng = random.Random(3)
    nodes = list(range(30))
    edges = [(k, *rng.sample(nodes, 2), rng.choice([0.9, 0.8, 0.7, 0.6, 0.75])) for k in range(100)]
    sightings = [(i, f"f{i % 5}", "xy"[i % 2]) for i in nodes if i % 3 == 0]
    got = clusters.constrained(spark.range(30), spark.createDataFrame(edges, "pair long, a long, b long, score double"), spark.createDataFrame([], "a long, b long"), 0.5, spark.createDataFrame(sightings, "id long, frame string, animal string"))
    assert {r.pair: r.decision for r in got.collect()} == apart_by_hand(nodes, edges, sightings)


def test_a_task_keeps_few_edges(spark, monkeypatch):
    """Ends of 20,000 edges among 50 nodes leave their task as 50 edges a piece, connected as before."""
    monkeypatch.setattr(clusters, "HELD_EDGES", 1000)
    edges = spark.range(0, 20_000, 1, 2).select((F.col("id") % 25 * 2).alias("a"), ((F.col("id") + 1) % 25 * 2).alias("b")).union(spark.createDataFrame([(1, 3), (None, 4)], "a long, b long"))
    thin = edges.dropna().mapInArrow(clusters._thinned, "a long, b long")
    assert thin.count() < 200
    roots = {r.id: r.root for r in clusters.components(spark.range(50), edges).collect()}
    assert all(roots[i] == (0 if i % 2 == 0 else 1 if i in (1, 3) else i) for i in range(50))


def test_scores_are_not_written_out_in_each_other(spark):
    """Written out in every recipe and bucket, the three inputs made code that the JVM no longer compiles."""
    from tessera.plans import catalog

    plan = catalog.fusion_counts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest(") <= 10


def test_vectors_are_compared_once(spark, monkeypatch):
    """What was found for the roots is not found again for the rows given back."""
    found, whole = [], identity.best_before
    monkeypatch.setattr(identity, "best_before", lambda *args, **kw: found.append(whole(*args, **kw)) or found[-1])
    rows = spark.createDataFrame([(0, [1.0, 0.0], "Bird00001", "v", None), (1, [0.9, 0.1], None, "v", None), (2, [0.0, 1.0], None, "v", None)], "id long, vec array<double>, identity string, version string, status string")
    out = identity.assign_against_store(rows, 0.5, "v")
    assert {r.id: r.identity for r in out.collect()} == {1: "Bird00001", 2: "Bird00002"}
    assert len(found) == 1 and "cogroup" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
