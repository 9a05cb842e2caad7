"""Plans over poses, crops, labels and scores, bound to the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names, plane, quality
from tessera.operators import frames, pose, profiles, species
from tessera.plans.registry import query, read

SEEN = 0.05


def element(k: int) -> Column:
    return F.get(F.col("embedding"), F.lit(k)).cast("double")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """17 points of every embedding, in an image of 200 x 160; scores for the first twelve only."""
    at = lambda i: F.get(F.col("embedding"), i).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda k: F.array(100 + 200 * at(2 * k), 80 + 150 * at(2 * k + 1)))
    scores = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: 2 * F.abs(at(k + 34)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5 != 0).alias("ok"), points.alias("points"), scores.alias("scores"))
    return pose.keypoint_records(rows, "points", "scores", 2 * SEEN)


POINTS_SQL = """k AS (SELECT vec_id, label % 5 <> 0 AS ok, unnest(range(17))::INT AS keypoint, embedding::DOUBLE[] AS e FROM embeddings),
    points AS (SELECT vec_id, ok, keypoint, 100 + 200 * e[2 * keypoint + 1] AS x, 80 + 150 * e[2 * keypoint + 2] AS y, CASE WHEN keypoint < 12 THEN 2 * abs(e[keypoint + 35]) ELSE 1.0 END AS score FROM k),
    seen AS (SELECT *, score >= 0.1 AS visible FROM points)"""


@query(f"WITH {POINTS_SQL} SELECT vec_id, ok, keypoint, {pose.POINTS}[keypoint + 1] AS point, round(x, 6) AS x, round(y, 6) AS y, round(score, 6) AS score, visible FROM seen")
def keypoint_records(spark, sf_dir):
    return rounded(poses(spark, sf_dir), "x", "y", "score")


@query(f"""WITH {POINTS_SQL}, c AS (SELECT vec_id, count(*) FILTER (visible AND keypoint IN (0, 1, 2, 3)) AS n_head, count(*) FILTER (visible AND keypoint IN (3, 4, 5, 8, 11, 14)) AS n_body, bool_or(ok) AS ok,
      bool_or(visible AND keypoint = 2) AS nose, bool_or(visible AND keypoint = 3) AS neck, bool_or(visible AND keypoint = 4) AS tail FROM seen GROUP BY vec_id)
    SELECT *, CASE WHEN NOT ok THEN 'mmpose_failed' WHEN (nose OR n_head >= 2) AND (n_body >= 2 OR (neck AND tail)) THEN 'dlc_billtip_and_smart_cropper_candidate' WHEN nose OR n_head >= 2 THEN 'dlc_billtip_candidate'
      WHEN n_body >= 2 OR (neck AND tail) THEN 'smart_cropper_candidate' ELSE 'mmpose_ok_but_low_pose_utility' END AS decision FROM c""")
def pose_decision(spark, sf_dir):
    return pose.pose_decision(poses(spark, sf_dir), "vec_id", "ok")


SCALE_SQL = """d AS (SELECT a.vec_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM seen a JOIN seen b USING (vec_id)
      JOIN (VALUES (0, 1), (2, 3), (3, 4), (5, 8), (11, 14), (5, 11), (8, 14)) s(i, j) ON a.keypoint = s.i AND b.keypoint = s.j WHERE a.visible AND b.visible),
    scales AS (SELECT vec_id, greatest(24.0, coalesce(median(d) FILTER (d > 0), 0.22 * 160)) AS scale FROM embeddings LEFT JOIN d USING (vec_id) GROUP BY vec_id)"""


@query(f"WITH {POINTS_SQL}, {SCALE_SQL} SELECT vec_id, round(scale, 6) AS scale FROM scales")
def pose_scale(spark, sf_dir):
    wide = pose.wide(poses(spark, sf_dir), ["vec_id"])
    return wide.select("vec_id", F.round(pose.pose_scale(F.col("p"), F.lit(200), F.lit(160)), 6).alias("scale"))


@query(f"""WITH {POINTS_SQL}, {SCALE_SQL},
    h AS (SELECT vec_id, count(*) AS n, avg(score) AS mean, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM seen WHERE visible AND keypoint IN (0, 1, 2, 3) GROUP BY vec_id HAVING count(*) >= 2),
    s AS (SELECT vec_id, mean, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(greatest(1.0, x2 - x1) * 2.5, floor(1.15 * scale)) AS w, greatest(greatest(1.0, y2 - y1) * 2.5, floor(1.15 * scale)) AS h FROM h JOIN scales USING (vec_id)),
    b AS (SELECT vec_id, mean, greatest(0, least(199, round_even(cx - w / 2, 0)::INT)) AS x1, greatest(0, least(159, round_even(cy - h / 2, 0)::INT)) AS y1, greatest(1, least(200, round_even(cx + w / 2, 0)::INT)) AS x2, greatest(1, least(160, round_even(cy + h / 2, 0)::INT)) AS y2 FROM s)
    SELECT e.vec_id, mean IS NOT NULL AS ok, round(least(1.0, coalesce(mean, 0)), 6) AS confidence, x1, y1, CASE WHEN x2 <= x1 THEN least(200, x1 + 1) ELSE x2 END AS x2, CASE WHEN y2 <= y1 THEN least(160, y1 + 1) ELSE y2 END AS y2
    FROM embeddings e LEFT JOIN b USING (vec_id)""")
def head_regions(spark, sf_dir):
    found = pose.regions(pose.wide(poses(spark, sf_dir), ["vec_id"]), F.lit(200), F.lit(160)).where("region = 'head'")
    return rounded(found, "confidence").select("vec_id", "ok", "confidence", "box.*")


@query(f"""WITH {POINTS_SQL}, r AS (SELECT unnest(['head', 'throat', 'body', 'tail']) AS region),
    f AS (SELECT vec_id, count(*) FILTER (visible AND keypoint IN (0, 1, 2, 3)) AS head, count(*) FILTER (visible AND keypoint IN (3, 4, 5, 8, 11, 14)) AS body, bool_or(visible AND keypoint = 2) AS nose, bool_or(visible AND keypoint = 3) AS neck,
      bool_or(visible AND keypoint = 4) AS tail, bool_or(visible AND keypoint IN (5, 8)) AS shoulder FROM seen GROUP BY vec_id)
    SELECT region, CASE region WHEN 'head' THEN head >= 2 WHEN 'throat' THEN neck AND (nose OR shoulder) WHEN 'body' THEN body >= 3 ELSE tail END AS ok, count(*) AS n FROM f, r GROUP BY ALL""")
def region_counts(spark, sf_dir):
    return pose.regions(pose.wide(poses(spark, sf_dir), ["vec_id"]), F.lit(200), F.lit(160)).groupBy("region", "ok").agg(F.count("*").alias("n"))


ENDS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT vec_id, 100 + 300 * e[1] AS bx, 80 + 300 * e[2] AS b_y, CASE WHEN vec_id % 7 <> 0 THEN 100 + 300 * e[3] END AS tx, 80 + 300 * e[4] AS ty, 8 * abs(e[5]) AS bp, CASE WHEN vec_id % 3 <> 0 THEN 8 * abs(e[6]) END AS tp,
      90 + 200 * e[7] AS hx, 70 + 200 * e[8] AS hy, vec_id % 5 <> 0 AS roi FROM e)"""


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda k, c: F.when(F.col("vec_id") % k != 0, c)
    x, y = 90 + 200 * element(6), 70 + 200 * element(7)
    roi = F.struct(x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 16).alias("y2"))
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", (100 + 300 * element(0)).alias("bx"), (80 + 300 * element(1)).alias("by"), some(7, 100 + 300 * element(2)).alias("tx"), (80 + 300 * element(3)).alias("ty"),
        (8 * F.abs(element(4))).alias("bp"), some(3, 8 * F.abs(element(5))).alias("tp"), some(5, roi).alias("roi"),
    )


CROP_SQL = """{0} AS (SELECT *, greatest(0, floor(l - pad))::BIGINT AS x1, greatest(0, floor(t - pad))::BIGINT AS y1, least(200, ceil(r + pad))::BIGINT AS x2, least(160, ceil(u + pad))::BIGINT AS y2 FROM {1})"""


@query(f"""WITH {ENDS},
    b AS (SELECT vec_id, list_min(xs) AS l, list_max(xs) AS r, list_min(ys) AS t, list_max(ys) AS u, CASE WHEN tx IS NOT NULL THEN sqrt((tx - bx) ** 2 + (ty - b_y) ** 2) END AS length FROM
      (SELECT *, list_filter([CASE WHEN roi THEN hx END, CASE WHEN roi THEN hx + 20 END, bx, tx], lambda x: x IS NOT NULL) AS xs, list_filter([CASE WHEN roi THEN hy END, CASE WHEN roi THEN hy + 16 END, b_y, CASE WHEN tx IS NOT NULL THEN ty END], lambda x: x IS NOT NULL) AS ys FROM p)),
    q AS (SELECT *, greatest(6.0, 24.0, 0.25 * greatest(r - l, u - t), coalesce(0.35 * length, 0)) AS pad FROM b), {CROP_SQL.format("c", "q")}
    SELECT vec_id, CASE WHEN x2 - x1 >= 4 AND y2 - y1 >= 4 THEN x1 END AS x1, CASE WHEN x2 - x1 >= 4 AND y2 - y1 >= 4 THEN y1 END AS y1, CASE WHEN x2 - x1 >= 4 AND y2 - y1 >= 4 THEN x2 END AS x2, CASE WHEN x2 - x1 >= 4 AND y2 - y1 >= 4 THEN y2 END AS y2 FROM c""")
def head_boxes(spark, sf_dir):
    bx, by, tx, ty = (F.col(c) for c in ("bx", "by", "tx", "ty"))
    box = plane.head_box(F.col("roi"), bx, by, tx, ty, F.hypot(tx - bx, ty - by), F.lit(200), F.lit(160))
    return ends(spark, sf_dir).select("vec_id", box.alias("box")).select("vec_id", "box.*")


@query(f"""WITH {ENDS}, q AS (SELECT vec_id, hx AS l, hy AS t, hx + 20 AS r, hy + 16 AS u, 10.0 AS pad FROM p WHERE roi), {CROP_SQL.format("c", "q")}
    SELECT vec_id, x1, y1, x2, y2 FROM p LEFT JOIN (SELECT * FROM c WHERE x2 - x1 >= 4 AND y2 - y1 >= 4) USING (vec_id)""")
def body_boxes(spark, sf_dir):
    return ends(spark, sf_dir).select("vec_id", plane.body_box(F.col("roi"), F.lit(200), F.lit(160)).alias("box")).select("vec_id", "box.*")


LABELED = f"""WITH {ENDS}, d AS (SELECT vec_id, sqrt((tx - bx) ** 2 + (ty - b_y) ** 2) AS length_px, degrees(atan2(ty - b_y, tx - bx)) AS degrees, least(bp, tp) AS least_likelihood, tx IS NOT NULL AS present FROM p),
    o AS (SELECT *, CASE WHEN least_likelihood >= 0.8 THEN 'strong' WHEN least_likelihood >= 0.6 THEN 'usable_review' WHEN least_likelihood >= 0.4 THEN 'weak_review' ELSE 'very_weak_review' END AS band,
      present AND least_likelihood >= 0.8 AS eligible, present AND least_likelihood >= 0.35 AS review FROM d)"""


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.labeled_length(*map(F.col, ("bx", "by", "bp", "tx", "ty", "tp")))
    return ends(spark, sf_dir).select("vec_id", *(c.alias(n) for n, c in found.items()))


@query(LABELED + " SELECT vec_id, round(length_px, 6) AS length_px, round(degrees, 6) AS degrees, round(least_likelihood, 6) AS least_likelihood, band, present, eligible, review FROM o")
def labeled_lengths(spark, sf_dir):
    return rounded(labeled(spark, sf_dir), "length_px", "degrees", "least_likelihood")


@query(LABELED + """ SELECT band, count(*) AS n, count(*) FILTER (present) AS n_present, count(*) FILTER (eligible) AS n_eligible, round(min(least_likelihood), 6) AS lowest, round(max(least_likelihood), 6) AS highest FROM o GROUP BY band""")
def quality_summary(spark, sf_dir):
    out = labeled(spark, sf_dir).groupBy("band").agg(
        F.count("*").alias("n"), F.count_if("present").alias("n_present"), F.count_if("eligible").alias("n_eligible"), F.min("least_likelihood").alias("lowest"), F.max("least_likelihood").alias("highest")
    )
    return rounded(out, "lowest", "highest")


@query(f"""WITH {ENDS} SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'dlc_prediction_ok is false' WHEN vec_id % 13 = 0 THEN 'dlc_billtip_decision=waiting' WHEN tx IS NULL THEN 'missing or non-positive dlc_bill_length_px' WHEN tp < 0.1 THEN 'bill_tip_likelihood below 0.10' WHEN bp < 0.1 THEN 'bill_base_likelihood below 0.10'
    WHEN vec_id % 17 = 0 THEN 'head_bill_crop not written' ELSE 'metric-ready debug bill length' END AS reason FROM p""")
def length_eligibility(spark, sf_dir):
    v, length = F.col("vec_id"), F.hypot(F.col("tx") - F.col("bx"), F.col("ty") - F.col("by"))
    reason = quality.length_eligibility(v % 11 != 0, F.when(v % 13 == 0, "waiting").otherwise(quality.EVIDENCE_READY), length, F.col("tp"), F.col("bp"), v % 17 != 0)
    return ends(spark, sf_dir).select("vec_id", reason.alias("reason"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: least(1.0, 4 * abs(x))) AS a, (vec_id % 60)::INT AS matches FROM embeddings),
    s AS (SELECT vec_id, matches, CASE WHEN vec_id % 4 = 0 THEN []::DOUBLE[] ELSE a[1:matches] END AS s FROM e),
    m AS (SELECT vec_id, matches, len(s) AS n, CASE WHEN len(s) > 0 THEN list_sum(s) / len(s) END AS mean, list_median(s) AS median, list_min(s) AS low, list_max(s) AS high FROM s)
    SELECT vec_id, matches, n, round(mean, 6) AS mean_score, round(median, 6) AS median_score, round(low, 6) AS min_score, round(high, 6) AS max_score,
      CASE WHEN mean IS NULL THEN CASE WHEN matches >= 45 THEN 'possible_local_match' WHEN matches >= 20 THEN 'weak_possible_local_match' ELSE 'weak_or_no_local_match' END
        WHEN matches >= 45 AND mean >= 0.5 THEN 'strong_local_match' WHEN matches >= 20 AND mean >= 0.3 THEN 'possible_local_match' WHEN matches >= 8 AND mean >= 0.15 THEN 'weak_possible_local_match' ELSE 'weak_or_no_local_match' END AS label FROM m""")
def match_summary(spark, sf_dir):
    scores = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.lit(1.0), 4 * F.abs(x)))
    pairs = read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 60).cast("int").alias("matches"), F.when(F.col("vec_id") % 4 != 0, scores).otherwise(F.array().cast("array<double>")).alias("scores"))
    cut = pairs.select("vec_id", "matches", quality.first_scores([F.array().cast("array<double>"), F.col("scores")], F.col("matches")).alias("s"))
    out = cut.select("vec_id", "matches", F.size("s").alias("n"), *(c.alias(n) for n, c in quality.score_summary(F.col("s")).items()))
    return rounded(out.withColumn("label", quality.match_label(F.col("matches"), F.col("mean_score"))), "mean_score", "median_score", "min_score", "max_score")


@query("""WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity * 20 AS sharp, l_extendedprice / 400 AS mean, l_quantity * 2 AS dev, l_linenumber * 9.0 AS edge, l_linenumber * 5.0 AS center FROM lineitem),
    s AS (SELECT *, least(ln(1 + sharp) / 8, 1.5) AS a, greatest(0, 1 - abs(mean - 128) / 128) AS b, least(dev / 64, 1.5) AS c, least(greatest((edge - center) / 128, 0), 0.5) AS d FROM v)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(a + 1e-9, 4) AS sharp, round(b + 1e-9, 4) AS bright, round(c + 1e-9, 4) AS contrast, round(d + 1e-9, 4) AS edge_penalty, round(greatest(0, least(0.55 * a + 0.15 * b + 0.25 * c - 0.20 * d, 1.5)) + 1e-9, 4) AS evidence FROM s""")
def image_evidence(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    parts = quality.image_evidence(q * 20, F.col("l_extendedprice") / 400, q * 2, n * 9.0, n * 5.0, digits=None)
    even = {k: F.round(c + 1e-9, 4) for k, c in parts.items()}  # ties would hang on the last bits
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *(c.alias(k) for k, c in even.items()))


@query("""WITH d AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 500 * abs(x)) AS d, 20 + vec_id % 90 AS a, vec_id % 100 AS b FROM embeddings),
    s AS (SELECT vec_id, len(list_filter(d, lambda x: x <= 64)) AS m, greatest(0, 1 - list_sum(d) / 64 / 96) AS closeness, a, b FROM d),
    t AS (SELECT vec_id, a >= 4 AND b >= 4 AS ok, m, closeness, greatest(0, least(1, 0.65 * closeness + 0.35 * least(1, 4.0 * m / greatest(1, least(a, b))))) AS score FROM s),
    u AS (SELECT vec_id, CASE WHEN ok THEN score ELSE 0 END AS score, CASE WHEN ok THEN m ELSE 0 END AS matches, CASE WHEN ok THEN closeness ELSE 0 END AS closeness FROM t)
    SELECT vec_id, round(score, 6) AS score, matches, round(closeness, 6) AS closeness, CASE WHEN matches <= 0 OR score <= 0.05 THEN 'no_local_evidence' WHEN score >= 0.72 THEN 'strong_candidate' WHEN score >= 0.5 THEN 'medium_candidate' WHEN score >= 0.3 THEN 'weak_candidate' ELSE 'low_candidate' END AS hint FROM u""")
def descriptor_scores(spark, sf_dir):
    distances = F.transform(F.col("embedding").cast("array<double>"), lambda x: 500 * F.abs(x))
    pairs = read(spark, sf_dir, "embeddings").select("vec_id", distances.alias("d"))
    found = quality.descriptor_score(F.col("d"), 20 + F.col("vec_id") % 90, F.col("vec_id") % 100)
    scored = pairs.select("vec_id", *(c.alias(n) for n, c in found.items()))
    return rounded(scored.withColumn("hint", quality.decision_hint(F.col("score"), F.col("matches"))), "score", "closeness")


LABELS = ["a;aves;caprimulgiformes;trochilidae;calypte;anna;anna's hummingbird", "a;aves;caprimulgiformes;trochilidae;;;hummingbird", "a;aves;;;;;bird", ";;;;;;blank", "a;aves;passeriformes;;;;perching bird", "a;;;;;;animal", "a;aves;x;y;genus;;some genus"]
#: What the labels are, as the SQL sees them: rank, priority, may be proposed.
KNOWN = [("species", 80, True), ("family", 60, True), ("class", 40, True), ("blank", 0, False), ("order", 50, True), ("animal", 0, False), ("genus", 70, True)]
KNOWN_SQL = "known AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}', '{}', {}, {})".format(i, t.replace("'", "''"), t.rpartition(";")[2].replace("'", "''"), r, p, ok) for i, (t, (r, p, ok)) in enumerate(zip(LABELS, KNOWN, strict=True))) + ") v(i, label, name, rank, priority, ok))"
PICKS_SQL = f"""{KNOWN_SQL}, picks AS (SELECT event_id, k, ((event_id * (k + 3) + k) % 7) AS i, CASE WHEN k < 2 THEN (event_id * (k + 7)) % 100 / 100.0 END AS score FROM events, (SELECT unnest([0, 1, 2]) AS k)),
    all_picks AS (SELECT event_id, k, label, name, rank, priority, ok, score::DOUBLE AS score FROM picks JOIN known USING (i))"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labels of every event, and scores for two of them."""
    e, every = F.col("event_id"), F.array(*map(F.lit, LABELS))
    labels = F.array(*(F.get(every, ((e * (k + 3) + k) % 7).cast("int")) for k in range(3)))
    return read(spark, sf_dir, "events").select("event_id", labels.alias("labels"), F.array(*((e * (k + 7)) % 100 / 100.0 for k in range(2))).alias("scores"))


@query(f"""WITH {PICKS_SQL}, best AS (SELECT event_id, label, name, rank, score FROM all_picks WHERE ok QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY priority + coalesce(score, 0) DESC, k) = 1),
    b AS (SELECT event_id, label, coalesce(name, '') AS common_name, coalesce(rank, 'unavailable') AS rank, score, CASE WHEN label IS NULL THEN 'unknown' WHEN name = 'bird' THEN 'unknown_bird' ELSE 'proposed' END AS status FROM events LEFT JOIN best USING (event_id)),
    c AS (SELECT *, CASE WHEN status <> 'proposed' THEN status WHEN score IS NULL THEN 'confidence_unknown' WHEN score >= 0.7 THEN 'proposed_high' WHEN score >= 0.3 THEN 'proposed_low' ELSE 'weak_guess' END AS band FROM b)
    SELECT *, CASE WHEN band = 'weak_guess' AND NOT contains(label, 'trochil') THEN 'weak_outside_group' WHEN status <> 'proposed' THEN status WHEN band = 'proposed_high' THEN 'proposed_candidate_high' WHEN band = 'proposed_low' THEN 'proposed_candidate_low'
      WHEN band = 'weak_guess' THEN 'weak_guess' ELSE 'proposed_candidate_unscored' END AS proposal FROM c""")
def species_proposals(spark, sf_dir):
    best = picks(spark, sf_dir).withColumn("b", species.best_label(F.col("labels"), F.col("scores"))).select("event_id", "b.label", "b.score")
    label = F.coalesce("label", F.lit(""))
    known = best.withColumns({"common_name": species.common_name(label), "rank": species.rank_of(label), "status": species.review_status(label)})
    banded = known.withColumn("band", species.confidence_band(F.col("score"), F.col("status")))
    return banded.withColumn("proposal", species.proposal(F.col("status"), F.col("band"), species.mentions(label, ("hummingbird", "trochil"))))


@query(f"WITH {PICKS_SQL} SELECT event_id, k AS place, label, score, name AS common_name, rank, NOT ok AS rejectable FROM all_picks WHERE k < 2")
def species_candidates(spark, sf_dir):
    return species.candidates(picks(spark, sf_dir), "labels", "scores", 2).drop("labels", "scores")


@query(f"WITH {PICKS_SQL} SELECT name, count(*) AS n FROM all_picks GROUP BY name ORDER BY n DESC, name LIMIT 5")
def top_common_names(spark, sf_dir):
    return species.top_names(picks(spark, sf_dir), "labels", "scores", first=5, most=5)


CROPS_SQL = "c AS (SELECT event_id, user_id, event_id * 3 % 500 AS frame FROM events)"


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    frame = F.lpad((e * 3 % 500).cast("string"), 8, "0")
    seconds = F.concat(F.lpad((e % 90).cast("string"), 4, "0"), F.lit(".50"))
    name = F.concat(F.lit("D:\\out/cam"), F.col("user_id"), F.lit("-frame-"), frame, F.lit("-t"), seconds, F.lit("-animal-"), F.lpad((e % 4).cast("string"), 3, "0"), F.lit("-conf0"), F.lpad((e % 100).cast("string"), 2, "0"), F.lit("-pad20-HEAD.png"))
    return read(spark, sf_dir, "events").select("event_id", F.when(e % 10 == 9, F.concat(F.lit("x/plain"), e, F.lit(".png"))).otherwise(name).alias("path"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'plain' || event_id ELSE 'cam' || user_id END AS source, CASE WHEN event_id % 10 = 9 THEN -1 ELSE event_id * 3 % 500 END AS frame, CASE WHEN event_id % 10 = 9 THEN -1.0 ELSE event_id % 90 + 0.5 END::DOUBLE AS seconds,
      CASE WHEN event_id % 10 = 9 THEN -1 ELSE event_id % 4 END AS animal, CASE WHEN event_id % 10 = 9 THEN 0.0 ELSE event_id % 100 / 100.0 END::DOUBLE AS confidence, CASE WHEN event_id % 10 = 9 THEN 'plain' || event_id ELSE 'cam' || user_id END AS source_key FROM events""")
def crop_names(spark, sf_dir):
    path = F.col("path")
    return crops(spark, sf_dir).select("event_id", *(c.alias(n) for n, c in names.crop_name(path).items()), names.source_key(path).alias("source_key"))


@query("""WITH c AS (SELECT event_id, user_id, event_id * 3 % 500 AS frame FROM events WHERE event_id % 10 <> 9), p AS (SELECT a.event_id AS a, b.event_id AS b, abs(a.frame - b.frame) AS gap FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_id < b.event_id)
    SELECT CASE WHEN gap <= 30 THEN 'near_frame' ELSE 'kept' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def near_frame_pairs(spark, sf_dir):
    path = F.col("path")
    return frames.pair_reasons(crops(spark, sf_dir), names.source_key(path), names.frame_number(path), near=30)


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 4 THEN NULL ELSE 3 END AS n, CASE WHEN vec_id % 5 = 4 THEN NULL ELSE (label + vec_id + 0.5)::DOUBLE END AS total FROM embeddings""")
def vector_texts(spark, sf_dir):
    v, k = F.col("vec_id").cast("string"), F.col("vec_id") % 5
    inner = F.concat(F.lit("["), F.col("label"), F.lit(", "), v, F.lit(", 0.5]"))
    text = F.when(k == 4, F.concat(F.lit('[1, "x", '), v, F.lit("]"))).when(k == 3, F.concat(F.lit('{"values": '), inner, F.lit("}"))).when(k == 2, F.concat(F.lit('{"vector": '), inner, F.lit("}"))).when(k == 1, F.concat(F.lit('{"embedding": '), inner, F.lit("}"))).otherwise(inner)
    parsed = read(spark, sf_dir, "embeddings").select("vec_id", names.vector_text(text).alias("x"))
    return parsed.select("vec_id", F.when(F.col("x").isNotNull(), F.size("x")).alias("n"), F.aggregate("x", F.lit(0.0), lambda s, y: s + y).alias("total"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'TBD' WHEN o_orderkey % 4000 < 60 THEN o_orderkey % 4000 || '.0 sec' ELSE (o_orderkey % 4000) // 60 || ' min ' || o_orderkey % 4000 % 60 || ' sec' END AS shown FROM orders""")
def durations_shown(spark, sf_dir):
    seconds = F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 4000).cast("double"))
    return read(spark, sf_dir, "orders").select("o_orderkey", profiles.duration_text(seconds).alias("shown"))
