"""Scores of images and of local matches, and the words for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least matches and least mean score of each label, from the top.
MATCH_LABELS = [("strong_local_match", 45, 0.50), ("possible_local_match", 20, 0.30), ("weak_possible_local_match", 8, 0.15)]


def image_evidence(sharpness: Column, mean: Column, deviation: Column, edge: Column, center: Column, digits: int | None = 4) -> dict[str, Column]:
    """Parts and sum of an image's evidence from its grey values: Laplacian variance, mean, deviation, and the deviations at the edges and inside."""
    zero = F.lit(0.0)
    sharp = F.least(F.log1p(F.greatest(sharpness, zero)) / 8, F.lit(1.5))
    bright = F.greatest(zero, 1 - F.abs(mean - 128) / 128)
    contrast = F.least(deviation / 64, F.lit(1.5))
    penalty = F.least(F.greatest((edge - center) / 128, zero), F.lit(0.5))
    total = F.greatest(zero, F.least(0.55 * sharp + 0.15 * bright + 0.25 * contrast - 0.20 * penalty, F.lit(1.5)))
    parts = {"sharp": sharp, "bright": bright, "contrast": contrast, "edge_penalty": penalty, "evidence": total}
    return {name: F.round(c, digits) if digits is not None else c for name, c in parts.items()}


def match_label(matches: Column, mean: Column) -> Column:
    """Matches without scores rise no higher than possible."""
    unscored = F.when(matches >= 45, "possible_local_match").when(matches >= 20, "weak_possible_local_match").otherwise("weak_or_no_local_match")
    scored = F.lit("weak_or_no_local_match")
    for name, least, least_mean in reversed(MATCH_LABELS):
        scored = F.when((matches >= least) & (mean >= least_mean), name).otherwise(scored)
    return F.when(mean.isNull(), unscored).otherwise(scored)


def score_summary(scores: Column) -> dict[str, Column]:
    """Mean, median, least and largest of a list; null if it is empty."""
    ordered, n = F.array_sort(scores), F.size(scores)
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda s, x: s + x), n)
    return {"mean_score": mean, "median_score": median, "min_score": F.array_min(scores), "max_score": F.array_max(scores)}


def first_scores(lists: list[Column], matches: Column) -> Column:
    """The first list that has scores, cut to the number of matches."""
    return F.slice(F.coalesce(*(F.when(F.size(x) > 0, x) for x in lists), F.array().cast("array<double>")), F.lit(1), matches)


def descriptor_score(distances: Column, points_a: Column, points_b: Column) -> dict[str, Column]:
    """Fallback score of a pair from the distances of its binary descriptors: closeness, and how many points have a near partner."""
    n = F.size(distances)
    usable = (n > 0) & (points_a >= 4) & (points_b >= 4)
    near = F.size(F.filter(distances, lambda d: d <= 64))
    mean = F.aggregate(distances, F.lit(0.0), lambda s, d: s + d) / F.greatest(n, F.lit(1))
    closeness = F.greatest(F.lit(0.0), 1 - mean / 96)
    coverage = F.least(F.lit(1.0), 4.0 * near / F.greatest(F.lit(1), F.least(points_a, points_b)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * closeness + 0.35 * coverage))
    return {"score": F.when(usable, score).otherwise(0.0), "matches": F.when(usable, near).otherwise(0), "closeness": F.when(usable, closeness).otherwise(0.0)}


def decision_hint(score: Column, matches: Column) -> Column:
    none = (matches <= 0) | (score <= 0.05)
    return F.when(none, "no_local_evidence").when(score >= 0.72, "strong_candidate").when(score >= 0.50, "medium_candidate").when(score >= 0.30, "weak_candidate").otherwise("low_candidate")


def review_band(least: Column) -> Column:
    return F.when(least.isNull(), "missing").when(least >= 0.80, "strong").when(least >= 0.60, "usable_review").when(least >= 0.40, "weak_review").otherwise("very_weak_review")


def labeled_length(base_x: Column, base_y: Column, base_p: Column, tip_x: Column, tip_y: Column, tip_p: Column) -> dict[str, Column]:
    """Vector, length and angle of a labelled bill, the band of its less certain end, and what it may be used for. Of two likelihoods a missing one is passed over."""
    dx, dy, least = tip_x - base_x, tip_y - base_y, F.least(base_p, tip_p)
    there = base_x.isNotNull() & base_y.isNotNull() & tip_x.isNotNull() & tip_y.isNotNull()
    on = lambda c: F.coalesce(there & c, F.lit(False))
    return {
        "length_px": F.hypot(dx, dy), "degrees": F.degrees(F.atan2(dy, dx)), "least_likelihood": least, "band": review_band(least),
        "present": there, "eligible": on(least >= 0.80), "review": on(least >= 0.35),
    }


#: The decision that a length needs, and what is said of lengths.
EVIDENCE_READY, READY = "dlc_billtip_evidence_ready", "metric-ready debug bill length"
REFUSED = {
    "ok": "dlc_prediction_ok is false", "decision": "dlc_billtip_decision=", "length": "missing or non-positive dlc_bill_length_px", "tip": "bill_tip_likelihood below 0.10",
    "base": "bill_base_likelihood below 0.10", "crop": "head_bill_crop not written",
}


def length_eligibility(ok: Column, decision: Column, length: Column, tip_p: Column, base_p: Column, cropped: Column) -> Column:
    """Why a length may not be measured (the first reason), or ready. A missing likelihood is no reason."""
    state = F.trim(F.coalesce(decision, F.lit("")))
    return (
        F.when(~F.coalesce(ok, F.lit(False)), REFUSED["ok"])
        .when(state != EVIDENCE_READY, F.concat(F.lit(REFUSED["decision"]), state))
        .when(length.isNull() | (length <= 0), REFUSED["length"])
        .when(tip_p < 0.10, REFUSED["tip"])
        .when(base_p < 0.10, REFUSED["base"])
        .when(~F.coalesce(cropped, F.lit(False)), REFUSED["crop"])
        .otherwise(READY)
    )
