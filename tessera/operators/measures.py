"""Retention scores of detections, bill-length observations, and ranges per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import plane
from tessera.functions.ladders import ladder
from tessera.operators.quantiles import exact_quantiles, with_quantiles

#: Rungs of the additive score as (least value, points).
CONFIDENCE, CONFIDENCE_LAST = [(0.70, 30), (0.40, 24), (0.15, 16)], 8
SIDE, SIDE_LAST = [(160, 18), (80, 14), (40, 8)], 2
AREA, AREA_LAST = [(30000, 10), (8000, 7), (1500, 3)], 0
ROLE, AVAILABLE, READABLE, USABLE_SIDE, SMALL_SIDE, SHARP, DULL, PERSON = 18, 16, 4, 5, 2, 4, 1, 12


def retention_score(role: Column, confidence: Column, width: Column, height: Column, area: Column, available: Column, readable: Column, least_side: Column, sharp: Column, person: Column) -> Column:
    on = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(role == "animal", ROLE).otherwise(0)
        + ladder(confidence, CONFIDENCE, CONFIDENCE_LAST)
        + ladder(F.greatest(width, height), SIDE, SIDE_LAST)
        + ladder(area, AREA, AREA_LAST)
        + F.when(on(available), AVAILABLE).otherwise(0)
        + F.when(on(readable), READABLE + F.when(on(least_side), USABLE_SIDE).otherwise(SMALL_SIDE) + F.when(on(sharp), SHARP).otherwise(DULL)).otherwise(0)
        - F.when(on(person), PERSON).otherwise(0)
    ).cast("double")


def legacy_animals(detections: DataFrame, class_id: str, confidence: str, animal: int, least: float) -> DataFrame:
    """Detections of the animal class with enough confidence."""
    return detections.where((F.col(class_id) == animal) & (F.col(confidence) >= least))


def legacy_score(score: Column) -> Column:
    """The earlier form of the score: within 0 to 100, two digits, halves to the even one."""
    return F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2)


def retention_reasons(role: Column, confidence: Column, width: Column, height: Column, area: Column) -> Column:
    """Why the score is what it is, in the order of its parts, joined by bars."""
    parts = [
        F.when(role == "animal", "animal_role"),
        ladder(confidence, [(0.70, "high_confidence"), (0.40, "medium_confidence"), (0.15, "low_confidence")], "very_low_confidence"),
        ladder(F.greatest(width, height), [(160, "large_bbox"), (80, "medium_bbox"), (40, "small_bbox")], "very_small_bbox"),
        ladder(area, [(30000, "large_bbox_area"), (8000, "moderate_bbox_area"), (1500, "small_bbox_area")], None),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "|")


def role_of(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.contains("animal") | low.contains("bird"), "animal").when(low.contains("person") | low.contains("human"), "person").when(low.rlike("vehicle|car|truck|bus"), "vehicle").otherwise("other")


def length_observation(df: DataFrame, least_likelihood: float = 0.3) -> DataFrame:
    """State and lengths of a base-to-tip length in an image; df: width, height, base_x, base_y, tip_x, tip_y, likelihood, blocked.

    With both points outside, blockers are not asked: the observation is diagnostic. Otherwise any blocker rejects it.
    """
    w, h, bx, by, tx, ty, p = (F.col(c) for c in ("width", "height", "base_x", "base_y", "tip_x", "tip_y", "likelihood"))
    base, tip = plane.inside(bx, by, w, h), plane.inside(tx, ty, w, h)
    length = F.hypot(tx - bx, ty - by)
    blocked = F.coalesce(F.col("blocked"), F.lit(False)) | p.isNull() | (p < least_likelihood) | ~F.coalesce((w > 0) & (h > 0), F.lit(False)) | F.coalesce(length <= 0, F.lit(True))
    share = F.when(base & ~tip, plane.visible_share(bx, by, tx, ty, w, h)).when(~base & tip, plane.visible_share(tx, ty, bx, by, w, h))
    state = (
        F.when(base.isNull() | tip.isNull(), "rejected_geometry")
        .when(~base & ~tip, "diagnostic_predicted_extension")
        .when(blocked, "rejected_geometry")
        .when(base & tip, "full_length_px_ready")
        .when(share.isNotNull(), "partial_length_lower_bound")
        .otherwise("diagnostic_predicted_extension")
    )
    visible = F.when(state == "partial_length_lower_bound", share * length)
    return df.withColumns({"state": state, "length_px": length, "visible_px": visible, "base_out_px": plane.outside_by(bx, by, w, h), "tip_out_px": plane.outside_by(tx, ty, w, h)})


def range_summary(observations: DataFrame, keys: list[str], state: str, value: str) -> DataFrame:
    """Counts by state, statistics of full and partial lengths, and the range they support, per group.

    Floor: the largest partial length, without any the smallest full one. Ceiling: the largest full length. The floor may lie above the ceiling.
    """
    v, s = F.col(value), F.col(state)
    full, part = F.when(s == "full", v), F.when(s == "partial", v)
    of = lambda name: F.count(F.when(s == name, 1)).alias(f"n_{name}")
    stats = [of(n) for n in ("full", "partial", "diagnostic", "rejected")]
    stats += [F.min(full).alias("full_min"), F.avg(full).alias("full_mean"), F.max(full).alias("full_max")]
    stats += [F.min(part).alias("partial_min"), F.avg(part).alias("partial_mean"), F.max(part).alias("partial_max")]
    high = exact_quantiles(observations, keys, full, {"full_p90": 0.9})
    grouped = with_quantiles(observations.groupBy(*keys).agg(*stats), high, keys)
    return grouped.withColumns({"range_floor": F.coalesce("partial_max", "full_min"), "range_ceiling": F.col("full_max")})
