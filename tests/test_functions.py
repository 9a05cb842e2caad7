"""Boundary values of cleaning, ladders and geometry."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import clean, ladders, plane
from tessera.operators import fusion, measures


def values(spark, expression, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_numbers(spark):
    texts = ["", " ", "nan", "inf", "-0", "1e3", "1_000", "2.5d", " 7 ", "x", None]
    got = values(spark, clean.to_number(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [None, None, None, None, 0.0, 1000.0, 1000.0, None, 7.0, None, None]
    assert values(spark, clean.to_number(F.col("t"), infinite=True, default=0.0), [("inf",), ("",)], "t string") == [math.inf, 0.0]
    assert values(spark, clean.to_whole(F.col("t"), half_even=True), [("2.5",), ("3.5",)], "t string") == [2, 4]


def test_flags(spark):
    got = values(spark, clean.to_flag(F.col("t")), [(t,) for t in ("TRUE", "y", "0", "on", "maybe", None)], "t string")
    assert got == [True, True, False, None, None, None]
    assert values(spark, clean.to_flag(F.col("t"), on_off=True, default=False), [("on",), ("",)], "t string") == [True, False]


def test_first_filled(spark):
    df = spark.createDataFrame([(" ", "b"), ("a", "b"), ("", None)], "x string, y string")
    value, name = clean.first_filled(df, ["missing", "x", "y"])
    assert [tuple(r) for r in df.select(value, name).collect()] == [("b", "y"), ("a", "x"), (None, None)]


def test_paths_and_names(spark):
    assert values(spark, clean.path_key(F.col("t")), [("A/b\\\\C.png",)], "t string") == ["a\\b\\c.png"]
    assert values(spark, clean.safe_name(F.col("t")), [("--a b!c..",), ("...",)], "t string") == ["a_b_c", "unnamed"]
    assert values(spark, clean.auto_number(F.col("t")), [("Bird00042",), ("Bird123",), ("x",)], "t string") == [42, None, None]
    stamps = values(spark, clean.name_time(F.col("t")).cast("string"), [("a_20240131_101112.mp4",), ("a_20241331_101112.mp4",)], "t string")
    assert stamps == ["2024-01-31 10:11:12", None]


def test_decisions(spark):
    scores = [75.0, 74.99, 55.0, 30.0, 29.9]
    assert values(spark, ladders.retention_decision(F.col("s")), [(s,) for s in scores], "s double") == ["best", "usable", "usable", "weak_debug", "discardable"]
    assert values(spark, ladders.reaches(F.col("d"), "usable"), [("best",), ("weak_debug",), ("odd",)], "d string") == [True, False, False]
    assert values(spark, ladders.likelihood_band(F.col("p"), 0.2), [(None,), (0.1,), (0.2,), (0.3,), (0.7,)], "p double") == ["missing_likelihood", "below_minimum", "low", "medium", "high"]


def test_plane(spark):
    box = (F.lit(10.0), F.lit(8.0))
    assert values(spark, plane.inside(F.col("x"), F.col("y"), *box), [(10.0, 0.0), (10.1, 0.0), (None, 1.0)], "x double, y double") == [True, False, None]
    assert values(spark, plane.outside_by(F.col("x"), F.col("y"), *box), [(13.0, 12.0), (5.0, 5.0)], "x double, y double") == [5.0, 0.0]
    share = plane.visible_share(F.lit(5.0), F.lit(4.0), F.col("x"), F.col("y"), *box)
    assert values(spark, share, [(15.0, 4.0), (5.0, 4.0), (9.0, 4.0)], "x double, y double") == [0.5, None, 1.0]


@pytest.mark.parametrize("vision,points,measure,fused,with_measure", [(0.5, 0.9, None, 0.78, 0.78), (0.5, None, 0.8, 0.5, 0.55), (None, None, 0.4, None, 0.4), (1.0, 1.0, 0.9, 1.0, 1.0), (0.5, None, 0.05, 0.5, 0.38), (0.5, None, 0.25, 0.5, 0.44)])
def test_recipes(spark, vision, points, measure, fused, with_measure):
    df = spark.createDataFrame([(vision, points, measure)], "v double, p double, m double")
    of = lambda r, d=False: fusion.recipe_score(r, F.col("v"), F.col("p"), F.col("m"), F.lit(d))
    row = df.select(of("fusion"), of("fusion-metrics"), of("fusion", True)).first()
    assert row[0] == (None if fused is None else pytest.approx(fused)) and row[1] == pytest.approx(with_measure) and row[2] is None


def test_length_states(spark):
    rows = [(10.0, 10.0, 1.0, 1.0, 5.0, 5.0, 0.9, False), (10.0, 10.0, 1.0, 1.0, 15.0, 1.0, 0.9, False), (10.0, 10.0, -1.0, 1.0, 15.0, 1.0, 0.01, True), (10.0, 10.0, 1.0, 1.0, 5.0, 5.0, 0.1, False), (10.0, 10.0, 1.0, 1.0, 1.0, 1.0, 0.9, False), (10.0, 10.0, None, 1.0, 1.0, 1.0, 0.9, False)]
    df = spark.createDataFrame(rows, "width double, height double, base_x double, base_y double, tip_x double, tip_y double, likelihood double, blocked boolean")
    got = measures.length_observation(df).collect()
    assert [r["state"] for r in got] == ["full_length_px_ready", "partial_length_lower_bound", "diagnostic_predicted_extension", "rejected_geometry", "rejected_geometry", "rejected_geometry"]
    assert got[1]["visible_px"] == pytest.approx(9.0)
