"""Tiles of packed blocks give what plain loops give, and what is shuffled grows with the table."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import fusion, similarity, tiles


def table(spark, x, **others):
    names = list(others)
    rows = [(k, v.tolist(), *(others[n][k] for n in names)) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>" + "".join(f", {n} long" for n in names))


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(similarity, "FEW_BLOCKS", 0)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(tiles, "MOST_ROWS", 40)


def odd_vectors(n=190, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 7)) * rng.choice([1e-3, 1.0, 1e5], (n, 1))
    x[5] = 0
    x[60] = x[61] = x[9]
    x[33] = np.nan
    return x


def cosines(x):
    """Vectors without length, or with what is no number, have cosine 0 with all."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return np.round(u @ u.T, 6)


def test_against_plain_loops(spark, small):
    x = odd_vectors()
    n, c = len(x), cosines(x)
    v = table(spark, x, tag=[k * 10 for k in range(n)])
    pairs = {(a, b): c[a, b] for a in range(n) for b in range(a + 1, n) if c[a, b] >= 0.3}
    got = similarity.pairs_above(v, 0.3).collect()
    assert {(r.a, r.b): r.cosine for r in got} == pytest.approx(pairs) and len(got) == len(pairs)
    assert all(r.tag_a == 10 * r.a and r.tag_b == 10 * r.b for r in got)
    fine = range(n)
    near = {(q, i) for q in fine for i in sorted((k for k in fine if k != q), key=lambda k: (-c[q, k], k))[:4]}
    assert {(r.query, r.id) for r in similarity.nearest(v.select("id", "vec"), 4).collect()} == near
    before = {q: min((k for k in fine if k < q), key=lambda k: (-c[q, k], k)) for q in fine if q}
    assert {r.id: r.match for r in similarity.best_before(v.select("id", "vec"), -1.0).collect() if r.match is not None} == before
    best = sorted(((-c[a, b], a, b) for a in fine for b in fine if a < b and a // 5 != b // 5))[:20]
    assert [(r.a, r.b) for r in similarity.best_pairs(v.select("id", "vec"), 20, differ=5).orderBy("rank").collect()] == [(a, b) for _, a, b in best]


def test_what_is_dealt_grows_with_the_table(spark, monkeypatch):
    """Blocks grow with the table, so four times the rows are packed into as many blocks, and no block meets more of them."""
    monkeypatch.setattr(tiles, "MOST_ROWS", 4096)
    counts = []
    for n in (2000, 8000):
        v = table(spark, np.random.default_rng(1).normal(size=(n, 4)))
        blocks = tiles.packed(v, n, 4, 64)
        assert blocks.agg(F.sum(F.length("vecs"))).first()[0] == n * 4 * 8
        counts.append(blocks.count())
    assert counts == [16, 16]


def test_pairs_of_recipes_are_not_shuffled(spark):
    """Prices and sizes come with the vectors; joining them to the pairs shuffled each pair twice."""
    plan = entry.queries()["fusion_recipes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") > plan.index("FlatMapCoGroups") and plan.count("FlatMapCoGroups") == 1
    assert "Join" not in plan[: plan.index("FlatMapCoGroups")]


@pytest.mark.parametrize("name", ["fusion_recipes", "fusion_counts"])
def test_code_of_recipes_is_compiled(spark, name):
    """HotSpot interprets methods of more than 8000 bytes; the one of these plans had 18632."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:\s*(\d+)", code)]
    assert sizes and 0 < max(sizes) < 8000


def test_scores_in_steps_are_those_of_recipes(spark):
    """Scores and sources worked out step by step are what recipe_score, recipe_source and round give one by one."""
    some = [None, float("nan"), -0.5, 0.0, 0.05, 0.0500001, 0.1234565, 0.25, 0.3, 0.4999994, 0.5, 0.65, 0.8, 1.0, 1.7]
    pairs = spark.createDataFrame([(v, p, m, d) for v in some for p in some for m in some for d in (False, True, None)], "v double, p double, m double, d boolean")
    given = [F.col(c) for c in "vpmd"]
    for c in "vpm":  # a number that is none counts as missing
        pairs = pairs.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    got = fusion.recipe_scores(pairs, *given, "source")
    same = [fusion.rounded(F.col(n.replace("-", "_"))).eqNullSafe(F.round(fusion.recipe_score(n, *given) + 1e-9, 6)) for n in fusion.RECIPES]
    same.append(F.col("source").eqNullSafe(fusion.recipe_source("fusion-metrics", *given)))
    assert got.count() == 3 * len(some) ** 3
    assert got.select(*(F.sum(F.when(s, 0).otherwise(1)) for s in same)).first() == (0,) * len(same)


@pytest.mark.parametrize("shape", [(0, 5), (1, 1), (3, 5), (5, 7), (8, 8), (17, 100)])
def test_places_of_what_is_true(shape):
    for share in (0, 0.01, 0.5, 1):
        mask = np.random.default_rng(2).random(shape) < share
        assert all((got == there).all() and len(got) == len(there) for got, there in zip(tiles.pairs_of(mask), np.nonzero(mask), strict=True))
