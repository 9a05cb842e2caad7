"""Keypoints of animals: records, what a pose is good for, its scale, and boxes of body regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import plane

#: Names of the points in their order, and which of them show what.
POINTS = [
    "L_Eye", "R_Eye", "Nose", "Neck", "Tail_Root", "L_Shoulder", "L_Elbow", "L_F_Paw", "R_Shoulder", "R_Elbow", "R_F_Paw",
    "L_Hip", "L_Knee", "L_B_Paw", "R_Hip", "R_Knee", "R_B_Paw",
]
HEAD, BODY, REAR = [0, 1, 2, 3], [3, 4, 5, 8, 11, 14], [4, 11, 14, 12, 15]
NOSE, NECK, TAIL, SHOULDERS = 2, 3, 4, [5, 8]
#: What a pose is a candidate for.
DECISIONS = ("dlc_billtip_and_smart_cropper_candidate", "dlc_billtip_candidate", "smart_cropper_candidate", "mmpose_ok_but_low_pose_utility", "mmpose_failed")
#: Distances between these tell the scale.
SPANS = [(0, 1), (2, 3), (3, 4), (5, 8), (11, 14), (5, 11), (8, 14)]


def keypoint_records(df: DataFrame, points: str, scores: str, threshold: float) -> DataFrame:
    """One row for each [x, y] of a list, with its name and whether it is seen. Points beyond the list of scores count 1; points without two numbers go."""
    each = df.select("*", F.posexplode(points).alias("keypoint", "xy")).where(F.size("xy") >= 2)
    score = F.coalesce(F.get(scores, F.col("keypoint")), F.lit(1.0))
    name = F.coalesce(F.get(F.array(*map(F.lit, POINTS)), F.col("keypoint")), F.concat(F.lit("kp"), F.col("keypoint").cast("string")))
    found = each.withColumns({"point": name, "x": F.get("xy", F.lit(0)), "y": F.get("xy", F.lit(1)), "score": score})
    return found.withColumn("visible", F.col("score") >= threshold).drop("xy", points, scores)


def pose_decision(points: DataFrame, key: str, ok: str) -> DataFrame:
    """What each pose is a candidate for, from its visible points (keypoint, visible) and whether the model succeeded."""
    k, seen = F.col("keypoint"), F.col("visible")
    has = lambda i: F.coalesce(F.bool_or(seen & (k == i)), F.lit(False))
    counts = points.groupBy(key).agg(
        F.count_if(seen & k.isin(HEAD)).alias("n_head"), F.count_if(seen & k.isin(BODY)).alias("n_body"), F.bool_or(ok).alias("ok"),
        has(NOSE).alias("nose"), has(NECK).alias("neck"), has(TAIL).alias("tail"),
    )
    head = F.col("ok") & (F.col("nose") | (F.col("n_head") >= 2))
    body = F.col("ok") & ((F.col("n_body") >= 2) | (F.col("neck") & F.col("tail")))
    decision = F.when(head & body, DECISIONS[0]).when(head, DECISIONS[1]).when(body, DECISIONS[2]).when(F.col("ok"), DECISIONS[3]).otherwise(DECISIONS[4])
    return counts.withColumn("decision", decision)


def wide(points: DataFrame, key: list[str]) -> DataFrame:
    """One row per pose, p: a list of (x, y, score) by keypoint, null where the point is not seen."""
    at = lambda i: F.max(F.when((F.col("keypoint") == i) & F.col("visible"), F.struct("x", "y", "score")))
    return points.groupBy(*key).agg(F.array(*map(at, range(len(POINTS)))).alias("p"))


def pose_scale(p: Column, width: Column, height: Column) -> Column:
    """Median of the spans that both ends are seen of and that aren't 0, without any a share of the image; 24 px at least."""
    spans = [F.hypot(p[a]["x"] - p[b]["x"], p[a]["y"] - p[b]["y"]) for a, b in SPANS]
    there = F.array_sort(F.filter(F.array_compact(F.array(*spans)), lambda d: d > 0))
    n = F.size(there)
    middle = (F.get(there, F.floor((n - 1) / 2).cast("int")) + F.get(there, F.floor(n / 2).cast("int"))) / 2
    return F.greatest(F.lit(24.0), F.coalesce(middle, 0.22 * F.least(width, height)))


def _seen(p: Column, which: list[int]) -> Column:
    return F.array_compact(F.array(*(p[i] for i in which)))


def _over(points: Column, field: str, how: str) -> Column:
    values = F.transform(points, lambda x: x[field])
    if how == "mean":
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)
    return F.array_min(values) if how == "min" else F.array_max(values)


def _around(points: Column, pad: float, least: Column, width: Column, height: Column) -> Column:
    low_x, high_x, low_y, high_y = (_over(points, c, how) for c in "xy" for how in ("min", "max"))
    side = lambda low, high: F.greatest(F.greatest(F.lit(1.0), high - low) * (1 + 2 * pad), F.floor(least).cast("double"))
    return plane.centered_box((low_x + high_x) / 2, (low_y + high_y) / 2, side(low_x, high_x), side(low_y, high_y), width, height)


def regions(poses: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes of head, throat, body and tail of poses (from `wide`): region, ok, confidence, box; null where the points don't carry it."""
    sized = poses.withColumn("scale", pose_scale(F.col("p"), width, height))
    p, scale = F.col("p"), F.col("scale")
    head, body, rear, shoulders = _seen(p, HEAD), _seen(p, BODY), _seen(p, REAR), _seen(p, SHOULDERS)
    neck, nose, tail = p[NECK], p[NOSE], p[TAIL]
    throat = F.array_compact(F.array(neck, nose, p[SHOULDERS[0]], p[SHOULDERS[1]]))
    toward = lambda c: F.when(F.size(shoulders) > 0, 0.55 * neck[c] + 0.45 * _over(shoulders, c, "mean")).otherwise(0.70 * neck[c] + 0.30 * nose[c])
    square = lambda x, y, share: plane.centered_box(x, y, share * scale, share * scale, width, height)
    several = F.size(rear) >= 2

    def region(name: str, there: Column, confidence: Column, box: Column) -> Column:
        there = F.coalesce(there, F.lit(False))
        sure = F.when(there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(0.0)
        return F.struct(F.lit(name).alias("region"), there.alias("ok"), sure.alias("confidence"), F.when(there, box).alias("box"))

    each = F.array(
        region("head", F.size(head) >= 2, _over(head, "score", "mean"), _around(head, 0.75, 1.15 * scale, width, height)),
        region("throat", neck.isNotNull() & (nose.isNotNull() | (F.size(shoulders) > 0)), _over(throat, "score", "mean"), square(toward("x"), toward("y"), 1.15)),
        region("body", F.size(body) >= 3, _over(body, "score", "mean"), _around(body, 0.45, 1.85 * scale, width, height)),
        region(
            "tail", tail.isNotNull(), F.when(several, 0.85 * _over(rear, "score", "min")).otherwise(0.55 * tail["score"]),
            F.when(several, _around(rear, 0.90, 1.35 * scale, width, height)).otherwise(square(tail["x"], tail["y"], 1.25)),
        ),
    )
    return sized.withColumn("r", F.explode(each)).select("*", "r.*").drop("r", "p")
