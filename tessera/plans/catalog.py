"""Each operator bound to the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean, ladders, plane
from tessera.operators import audit, clusters, frames, fusion, identity, measures, profiles, similarity, species
from tessera.plans.registry import query, read

PAIRS, EDGE, CLUSTER = 1000, 0.30, 0.40  # PAIRS: rows of the report of best pairs
TAXA = ["a;aves;caprimulgiformes;trochilidae;calypte;anna;anna's hummingbird", "a;aves;caprimulgiformes;trochilidae;;;hummingbird", "a;aves;;;;;bird", ";;;;;;blank"]
TAXA_SQL = "(VALUES " + ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in enumerate(TAXA)) + ") x(k, label)"
COSINES = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
    p AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a, e b WHERE a.id <> b.id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("long").alias("name"))


@query(f"""{COSINES} SELECT a, b, cosine, row_number() OVER (ORDER BY cosine DESC, a, b) AS rank FROM p WHERE a < b ORDER BY rank LIMIT {PAIRS}""")
def pair_rank(spark, sf_dir):
    return similarity.best_pairs(vectors(spark, sf_dir).drop("name"), PAIRS)


@query("""WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id),
    p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.id < b.id ORDER BY a.id, b.id LIMIT 3000),
    q AS (SELECT *, row_number() OVER (ORDER BY a, b) AS pair FROM p)
    SELECT pair, a, b, cosine, row_number() OVER (ORDER BY cosine DESC, pair) AS rank FROM q""")
def first_pairs(spark, sf_dir):
    """The listing with a work bound, which is its feature."""
    return similarity.ordered_pairs(vectors(spark, sf_dir).drop("name"), 3000)


@query(f"{COSINES} SELECT a AS query, b AS id, cosine, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM p QUALIFY rank <= 8")
def knn_topk(spark, sf_dir):
    return similarity.nearest(vectors(spark, sf_dir).drop("name"))


@query(f"""{COSINES}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS n FROM p WHERE b < a)
    SELECT e.id, CASE WHEN cosine >= {EDGE} THEN b END AS match, cosine, CASE WHEN cosine >= {EDGE} THEN 'match' ELSE 'new' END AS decision
    FROM e LEFT JOIN r ON r.a = e.id AND n = 1""")
def best_prior_match(spark, sf_dir):
    return similarity.best_before(vectors(spark, sf_dir).drop("name"), EDGE)


BETWEEN = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::BIGINT AS name FROM embeddings),
    p AS (SELECT a.name AS name_a, b.name AS name_b, a.id AS id_a, b.id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a, e b WHERE {0}),
    r AS (SELECT * FROM p WHERE cosine >= 0.3 QUALIFY row_number() OVER (PARTITION BY name_a, name_b ORDER BY cosine DESC, id_a, id_b) = 1)
    SELECT * FROM r ORDER BY cosine DESC, name_a, name_b LIMIT 200"""


@query(BETWEEN.format("a.name < b.name"))
def identity_pair_best(spark, sf_dir):
    return similarity.best_between(vectors(spark, sf_dir), EDGE)


@query(BETWEEN.format("a.name = 0 AND a.name <> b.name"))
def identity_pair_best_anchor(spark, sf_dir):
    return similarity.best_between(vectors(spark, sf_dir), EDGE, anchor=0)


@query(f"""{COSINES} SELECT a, b, cosine FROM p WHERE a < b AND a // 5 <> b // 5 ORDER BY cosine DESC, a, b LIMIT 15""")
def cascade_verify_select(spark, sf_dir):
    return similarity.best_pairs(vectors(spark, sf_dir).drop("name"), 15, differ=5).drop("rank")


RECIPES_SQL = f"""{COSINES}, q AS (SELECT a, b, cosine, a * 10000000 + b AS pair FROM p WHERE a < b AND cosine >= {EDGE}),
    s AS (SELECT pair, a, b, a // 5 = b // 5 AS differ, CASE WHEN pair % 7 <> 0 THEN greatest(0, least(1, cosine)) END AS vision,
        CASE WHEN pair % 3 <> 0 THEN greatest(0, least(1, 1 - abs(x.p_retailprice - y.p_retailprice) / 400)) END AS points,
        CASE WHEN pair % 4 <> 0 THEN greatest(0, least(1, 1 - abs(x.p_size - y.p_size) / 15.0)) END AS measure
      FROM q JOIN part x ON x.p_partkey = a + 1 JOIN part y ON y.p_partkey = b + 1),
    f AS (SELECT *, coalesce(0.7 * points + 0.3 * vision, points, vision) AS base FROM s),
    h AS (SELECT *, CASE WHEN base IS NULL THEN measure ELSE greatest(0, least(1, base + CASE WHEN measure >= 0.8 THEN 0.05 WHEN measure >= 0.5 THEN 0.02 WHEN measure <= 0.05 THEN -0.12 WHEN measure <= 0.25 THEN -0.06 ELSE 0 END)) END AS adjusted FROM f),
    g AS (SELECT pair, a, b, differ, {", ".join(f"CASE WHEN NOT differ THEN round({c} + 1e-9, 6) END AS {n}" for n, c in (("dino", "vision"), ("lightglue", "points"), ("metrics", "measure"), ("fusion", "base"), ("fusion_metrics", "adjusted")))},
      CASE WHEN differ THEN 'blocked_by_known_different_copresence' WHEN base IS NOT NULL THEN 'recipe_fusion_metrics:' || CASE WHEN points IS NOT NULL AND vision IS NOT NULL THEN 'base_0_70_lightglue_0_30_dino' WHEN points IS NOT NULL THEN 'base_lightglue_only' ELSE 'base_dino_only' END || ':' ||
        CASE WHEN measure IS NULL THEN 'no_metric_adjustment_missing_or_partial' WHEN measure >= 0.8 THEN 'small_metric_boost_compatible' WHEN measure >= 0.5 THEN 'tiny_metric_boost_moderately_compatible' WHEN measure <= 0.05 THEN 'metric_penalty_large_bill_px_difference'
          WHEN measure <= 0.25 THEN 'metric_penalty_low_bill_px_similarity' ELSE 'no_metric_adjustment_ambiguous' END
        WHEN measure IS NOT NULL THEN 'recipe_fusion_metrics_metric_only_fallback_provisional' ELSE 'recipe_fusion_metrics_missing_all_scores' END AS source FROM h),
    k AS (SELECT *, {", ".join(f"CASE WHEN differ THEN 'blocked_known_different_copresence' WHEN {n} IS NULL THEN 'unranked_missing_recipe_inputs' WHEN {n} >= 0.8 THEN 'review_top_candidate' WHEN {n} >= 0.65 THEN 'review_candidate' WHEN {n} >= 0.5 THEN 'review_weak_candidate' ELSE 'low_priority_candidate' END AS {b}" for n, b in (("fusion", "bucket"), ("fusion_metrics", "adjusted_bucket")))},
      CASE WHEN differ THEN 'blocked_known_different_copresence' WHEN metrics IS NULL THEN 'unranked_missing_recipe_inputs' WHEN metrics >= 0.8 THEN 'metrics_review_top_candidate' WHEN metrics >= 0.5 THEN 'metrics_review_candidate' WHEN metrics > 2e-9 THEN 'metrics_review_weak_candidate' ELSE 'metrics_low_priority_candidate' END AS metrics_bucket FROM g)"""


@query(f"{RECIPES_SQL} SELECT pair, a, b, dino, lightglue, metrics, fusion, fusion_metrics, source, bucket, adjusted_bucket, metrics_bucket FROM k")
def fusion_recipes(spark, sf_dir):
    """All five recipes, with every kind of missing evidence."""
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    both = similarity.pairs_above(vectors(spark, sf_dir).drop("name").join(part, "id"), EDGE).withColumn("pair", F.col("a") * 10_000_000 + F.col("b"))  # pairs are never shuffled
    differ = F.floor(F.col("a") / 5) == F.floor(F.col("b") / 5)
    vision = F.when(F.col("pair") % 7 != 0, F.col("cosine"))
    points = F.when(F.col("pair") % 3 != 0, 1 - F.abs(F.col("price_a") - F.col("price_b")) / 400)
    measure = F.when(F.col("pair") % 4 != 0, fusion.measure_likeness(F.abs(F.col("size_a") - F.col("size_b"))))
    scored = fusion.recipe_scores(both.withColumn("differ", differ), vision, points, measure, F.col("differ"), "source")
    names = [r.replace("-", "_") for r in fusion.RECIPES]
    scored = scored.withColumns({n: fusion.rounded(F.col(n)) for n in names})
    buckets = {b: fusion.review_bucket(r, F.col(r.replace("-", "_")), F.col("differ")) for b, r in (("bucket", "fusion"), ("adjusted_bucket", "fusion-metrics"), ("metrics_bucket", "metrics"))}
    return scored.withColumns(buckets).select("pair", "a", "b", *names, "source", *buckets)


@query(f"""{RECIPES_SQL}, c AS (SELECT adjusted_bucket AS b, count(*) AS n FROM k GROUP BY 1) SELECT count(fusion_metrics) AS ranked, max(fusion_metrics) AS top_score, (SELECT string_agg(b || ':' || n, ';' ORDER BY b) FROM c) AS buckets FROM k""")
def fusion_counts(spark, sf_dir):
    return fusion.bucket_counts(fusion_recipes(spark, sf_dir), "adjusted_bucket", "fusion_metrics")


#: The least score of an edge: low enough that buckets refuse some.
LEAST_EDGE = 0.45


@query(f"""{RECIPES_SQL.replace("WITH e", "WITH RECURSIVE e")}, d AS MATERIALIZED (SELECT pair, a, b, differ, fusion_metrics AS score, CASE WHEN differ THEN 'blocked_known_different_copresence' WHEN fusion_metrics IS NULL THEN 'not_used_missing_fusion_score' WHEN fusion_metrics < {LEAST_EDGE} THEN 'not_used_below_cluster_threshold_{LEAST_EDGE:.3f}'
      WHEN adjusted_bucket = 'low_priority_candidate' THEN 'not_used_bucket_low_priority_candidate' ELSE 'eligible_fusion_edge' END AS reason FROM k),
    l AS MATERIALIZED (SELECT a, b, pair, row_number() OVER (ORDER BY score DESC, pair) AS n FROM d WHERE reason = 'eligible_fusion_edge'), kd AS MATERIALIZED (SELECT coalesce(list({{'a': a, 'b': b}}), []) AS l FROM d WHERE differ),
    r(n, pair, a, decision, roots) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, range(0, (SELECT max(id) + 1 FROM e)) UNION ALL
      SELECT n, pair, a, decision, CASE WHEN decision = 'used' THEN list_transform(roots, lambda x: CASE WHEN x = high THEN low ELSE x END) ELSE roots END FROM (
        SELECT *, CASE WHEN len(list_filter(apart, lambda p: roots[p.a + 1] IN (low, high) AND roots[p.b + 1] IN (low, high))) > 0 THEN 'blocked' WHEN low = high THEN 'already_connected' ELSE 'used' END AS decision FROM (
          SELECT l.n, l.pair, l.a, roots, kd.l AS apart, least(roots[l.a + 1], roots[l.b + 1]) AS low, greatest(roots[l.a + 1], roots[l.b + 1]) AS high FROM r JOIN l ON l.n = r.n + 1, kd)))
    SELECT d.pair, d.a, d.b, coalesce(r.decision, 'not_used') AS decision, CASE r.decision WHEN 'blocked' THEN 'blocked_would_merge_known_different_members' WHEN 'already_connected' THEN 'same_existing_cluster' ELSE d.reason END AS reason,
      CASE WHEN r.decision IS NOT NULL THEN (SELECT roots FROM r ORDER BY n DESC LIMIT 1)[d.a + 1] END AS root FROM d LEFT JOIN r ON r.pair = d.pair""")
def cluster_decisions(spark, sf_dir):
    """From recipe to cluster: every pair gets its decision and the reason for it."""
    scored = fusion_recipes(spark, sf_dir).withColumns({"score": F.col("fusion_metrics"), "differ": F.floor(F.col("a") / 5) == F.floor(F.col("b") / 5)}).withColumnRenamed("bucket", "plain").withColumnRenamed("adjusted_bucket", "bucket")
    return clusters.decided(vectors(spark, sf_dir).select("id"), scored, LEAST_EDGE)


LINES = "SELECT l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 13 + l_linenumber AS id, l_orderkey::VARCHAR AS frame, l_linenumber::VARCHAR AS animal FROM lineitem"


@query(f"""WITH s AS ({LINES}) SELECT a.id AS id_a, b.id AS id_b, a.frame, 'same_frame_other_animal' AS reason
    FROM s a JOIN s b ON a.frame = b.frame AND a.id < b.id AND a.animal <> b.animal""")
def known_different(spark, sf_dir):
    key = F.expr("l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 13 + l_linenumber")
    lines = read(spark, sf_dir, "lineitem").select(key.alias("id"), F.col("l_orderkey").cast("string").alias("frame"), F.col("l_linenumber").cast("string").alias("animal"))
    return fusion.known_different(lines)


def _edges(spark, sf_dir, least):
    v = vectors(spark, sf_dir).drop("name")
    return v, similarity.pairs_above(v, least).withColumnRenamed("cosine", "score")


@query(f"""WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    l AS (SELECT a.id AS a, b.id AS b FROM e a, e b WHERE a.id <> b.id AND round(list_cosine_similarity(a.v, b.v), 6) >= {CLUSTER}),
    r(id, other) AS (SELECT id, id FROM e UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a),
    c AS (SELECT id, min(other) AS root FROM r GROUP BY id), s AS (SELECT root, count(*) AS size FROM c GROUP BY root),
    n AS (SELECT root, size, printf('Cluster%05d', row_number() OVER (ORDER BY size DESC, root)) AS cluster FROM s)
    SELECT id, root, size, cluster FROM c JOIN n USING (root)""")
def clusters_unconstrained(spark, sf_dir):
    v, edges = _edges(spark, sf_dir, CLUSTER)
    return clusters.named(clusters.components(v.select("id"), edges))


@query(f"""{COSINES.replace("WITH e", "WITH RECURSIVE e")}, l AS (SELECT a, b, a * 10000000 + b AS pair, row_number() OVER (ORDER BY cosine DESC, a, b) AS n FROM p WHERE a < b AND cosine >= {CLUSTER}),
    s(n, pair, a, decision, roots) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, range(0, (SELECT max(id) + 1 FROM e)) UNION ALL
      SELECT n, pair, a, decision, CASE WHEN decision = 'used' THEN list_transform(roots, lambda r: CASE WHEN r = high THEN low ELSE r END) ELSE roots END FROM (
        SELECT *, CASE WHEN len(list_filter(range(1, len(roots) - 4), lambda i: roots[i] IN (low, high) AND roots[i + 5] IN (low, high))) > 0 THEN 'blocked' WHEN low = high THEN 'already_connected' ELSE 'used' END AS decision FROM (
          SELECT l.n, l.pair, l.a, roots, least(roots[l.a + 1], roots[l.b + 1]) AS low, greatest(roots[l.a + 1], roots[l.b + 1]) AS high FROM s JOIN l ON l.n = s.n + 1)))
    SELECT s.pair, s.a, l.b, s.decision, (SELECT roots FROM s ORDER BY n DESC LIMIT 1)[s.a + 1] AS root FROM s JOIN l USING (pair)""")
def clusters_constrained(spark, sf_dir):
    """SQL takes one edge after another; ids run from 0, and each is apart from the fifth after it."""
    v, edges = _edges(spark, sf_dir, CLUSTER)
    apart = v.select(F.col("id").alias("a"), (F.col("id") + 5).alias("b"))
    pairs = edges.withColumn("pair", F.col("a") * 10_000_000 + F.col("b"))
    return clusters.constrained(v.select("id"), pairs, apart, CLUSTER)


@query(f"""{COSINES.replace("WITH e", "WITH RECURSIVE e")}, r AS (SELECT * FROM p WHERE b < a QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) = 1), walk(id, spot) AS (SELECT id, id FROM e UNION SELECT walk.id, r.b FROM walk JOIN r ON r.a = walk.spot AND r.cosine >= {CLUSTER}),
    roots AS (SELECT id, min(spot) AS root FROM walk GROUP BY id) SELECT id, dense_rank() OVER (ORDER BY root) AS identity FROM roots""")
def sequential_identity(spark, sf_dir):
    return identity.assign_in_order(vectors(spark, sf_dir).drop("name"), CLUSTER)


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_unlabeled(spark, sf_dir):
    return audit.orphans(read(spark, sf_dir, "documents"), "doc_id", read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


STATUSES = ["error", "click", "view", "signup", "purchase"]


@query("SELECT user_id, count(*) AS n, " + ", ".join(f"count(*) FILTER (event_type = '{s}') AS n_{s}" for s in STATUSES) + ", round(avg(value), 6) AS mean_score FROM events GROUP BY user_id HAVING n_error < n")
def status_pivot(spark, sf_dir):
    pivot = identity.status_pivot(read(spark, sf_dir, "events"), "user_id", "event_type", STATUSES, "value")
    return identity.without_lane(pivot, "error").withColumn("mean_score", F.round("mean_score", 6))


@query("""SELECT coalesce(nullif(trim(c_mktsegment), ''), 'unnamed') AS name, c_nationkey, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_negative
    FROM customer GROUP BY ALL""")
def named_groups(spark, sf_dir):
    name = F.coalesce(clean.blank_to_null(F.col("c_mktsegment")), F.lit("unnamed")).alias("name")
    return read(spark, sf_dir, "customer").groupBy(name, "c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))


@query("""SELECT user_id, count(*) AS n, count(DISTINCT event_id) AS visits, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
    round(sum(value), 4) AS total_s, round(avg(value) + 1e-9, 6) AS mean_s, max(value) AS max_s FROM events GROUP BY user_id""")
def profile_stats(spark, sf_dir):
    stats = profiles.profile_stats(read(spark, sf_dir, "events"), "user_id", "event_id", "ts", "value")
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_seen", "last_seen")}
    return stats.withColumns(text | {"total_s": F.round("total_s", 4), "mean_s": F.round(F.col("mean_s") + 1e-9, 6)})


@query("""WITH o AS (SELECT user_id, value, CASE event_type WHEN 'purchase' THEN 'full' WHEN 'view' THEN 'partial' WHEN 'click' THEN 'diagnostic' ELSE 'rejected' END AS state FROM events)
    SELECT user_id, count(*) FILTER (state = 'full') AS n_full, count(*) FILTER (state = 'partial') AS n_partial, count(*) FILTER (state = 'diagnostic') AS n_diagnostic, count(*) FILTER (state = 'rejected') AS n_rejected,
      min(value) FILTER (state = 'full') AS full_min, round(avg(value) FILTER (state = 'full'), 6) AS full_mean, max(value) FILTER (state = 'full') AS full_max,
      round(quantile_cont(value, 0.9) FILTER (state = 'full'), 6) AS full_p90, min(value) FILTER (state = 'partial') AS partial_min, round(avg(value) FILTER (state = 'partial'), 6) AS partial_mean, max(value) FILTER (state = 'partial') AS partial_max,
      coalesce(max(value) FILTER (state = 'partial'), min(value) FILTER (state = 'full')) AS range_floor, max(value) FILTER (state = 'full') AS range_ceiling
    FROM o GROUP BY user_id""")
def range_summary(spark, sf_dir):
    t = F.col("event_type")
    state = F.when(t == "purchase", "full").when(t == "view", "partial").when(t == "click", "diagnostic").otherwise("rejected")
    out = measures.range_summary(read(spark, sf_dir, "events").withColumn("state", state), ["user_id"], "state", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("full_mean", "full_p90", "partial_mean")})


@query("""WITH f AS (SELECT unnest(string_split(CASE WHEN n_chars < 500 THEN 'short;' ELSE '' END || CASE WHEN lang = 'en' THEN 'english;' ELSE '' END || CASE WHEN n_chars % 2 = 0 THEN 'even' ELSE '' END, ';')) AS flag FROM documents)
    SELECT flag, count(*) AS n FROM f WHERE trim(flag) <> '' GROUP BY flag""")
def exploded_flag_counts(spark, sf_dir):
    n = F.col("n_chars")
    flags = F.concat(F.when(n < 500, "short;").otherwise(""), F.when(F.col("lang") == "en", "english;").otherwise(""), F.when(n % 2 == 0, "even").otherwise(""))
    return profiles.flag_counts(read(spark, sf_dir, "documents").select(flags.alias("flags")), "flags")


def _case(value, rungs, last):
    return "CASE " + " ".join(f"WHEN {value} >= {t} THEN {p}" for t, p in rungs) + f" ELSE {last} END"


@query(f"""WITH c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'person' ELSE 'animal' END AS role,
      l_discount * 8 AS confidence, l_quantity * 4 AS width, l_quantity * 3 AS height, l_extendedprice AS area, l_linenumber > 1 AS available, l_quantity > 5 AS readable FROM lineitem),
    s AS (SELECT *, ((CASE WHEN role = 'animal' THEN 18 ELSE 0 END) + {_case("confidence", measures.CONFIDENCE, 8)} + {_case("greatest(width, height)", measures.SIDE, 2)} + {_case("area", measures.AREA, 0)}
      + (CASE WHEN available THEN 16 ELSE 0 END) + (CASE WHEN readable THEN 4 + (CASE WHEN least(width, height) >= 60 THEN 5 ELSE 2 END) + (CASE WHEN area >= 5000 THEN 4 ELSE 1 END) ELSE 0 END))::DOUBLE AS score FROM c)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, score, {_case("score", [(75, "'best'"), (55, "'usable'"), (30, "'weak_debug'")], "'discardable'")} AS decision, score >= 55 AS candidate FROM s""")
def retention_score(spark, sf_dir):
    c = F.col
    role = F.when(c("l_returnflag") == "R", "person").otherwise("animal")
    width, height, area = c("l_quantity") * 4, c("l_quantity") * 3, c("l_extendedprice")
    score = measures.retention_score(role, c("l_discount") * 8, width, height, area, c("l_linenumber") > 1, c("l_quantity") > 5, F.least(width, height) >= 60, area >= 5000, F.lit(False))
    scored = read(spark, sf_dir, "lineitem").withColumn("score", score)
    decision = ladders.retention_decision(c("score"))
    return scored.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "score", decision.alias("decision"), ladders.reaches(decision, "usable").alias("candidate"))


@query("""SELECT CASE WHEN l_tax < 0.02 THEN 'below_minimum' WHEN l_tax * 12 >= 0.7 THEN 'high' WHEN l_tax * 12 >= 0.3 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM
    (SELECT l_tax + 0.0 AS l_tax FROM lineitem) GROUP BY 1""")
def likelihood_bands(spark, sf_dir):
    band = F.when(F.col("l_tax") < 0.02, "below_minimum").otherwise(ladders.likelihood_band(F.col("l_tax") * 12, -1.0))
    return read(spark, sf_dir, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT vec_id, 100.0 AS width, 80.0 AS height, 50 + 300 * embedding[1]::DOUBLE AS bx, 40 + 300 * embedding[2]::DOUBLE AS b_y, 50 + 300 * embedding[3]::DOUBLE AS tx, 40 + 300 * embedding[4]::DOUBLE AS ty, abs(embedding[5]::DOUBLE) * 8 AS likelihood FROM embeddings),
    i AS (SELECT *, bx >= 0 AND b_y >= 0 AND bx <= width AND b_y <= height AS base, tx >= 0 AND ty >= 0 AND tx <= width AND ty <= height AS tip FROM p)
    SELECT vec_id, CASE WHEN NOT base AND NOT tip THEN 'diagnostic_predicted_extension' WHEN likelihood < 0.3 THEN 'rejected_geometry' WHEN base AND tip THEN 'full_length_px_ready' ELSE 'partial_length_lower_bound' END AS state,
      round(sqrt((tx - bx) ** 2 + (ty - b_y) ** 2), 6) AS length_px,
      round(sqrt(greatest(-bx, bx - width, 0) ** 2 + greatest(-b_y, b_y - height, 0) ** 2), 6) AS base_out_px,
      round(degrees(atan2(ty - b_y, tx - bx)), 6) AS degrees FROM i""")
def bill_classifier(spark, sf_dir):
    e = lambda k: F.get(F.col("embedding"), F.lit(k)).cast("double")
    points = read(spark, sf_dir, "embeddings").select("vec_id", F.lit(100.0).alias("width"), F.lit(80.0).alias("height"), (50 + 300 * e(0)).alias("base_x"), (40 + 300 * e(1)).alias("base_y"), (50 + 300 * e(2)).alias("tip_x"), (40 + 300 * e(3)).alias("tip_y"), (F.abs(e(4)) * 8).alias("likelihood"), F.lit(False).alias("blocked"))
    seen = measures.length_observation(points)
    angle = plane.axis_degrees(*map(F.col, ("base_x", "base_y", "tip_x", "tip_y")))
    return seen.select("vec_id", "state", F.round("length_px", 6).alias("length_px"), F.round("base_out_px", 6).alias("base_out_px"), F.round(angle, 6).alias("degrees"))


@query("""WITH k AS (SELECT vec_id, (i - 1) % 17 AS kp, v::DOUBLE AS v, i FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
    q AS (SELECT vec_id, 100 + 200 * v AS x, 80 + 150 * v AS y FROM k WHERE abs(v) >= 0.05 AND kp IN (0, 1, 2, 3)),
    b AS (SELECT vec_id, count(*) AS n, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM q GROUP BY vec_id),
    d AS (SELECT *, greatest(24.0, 0.35 * greatest(x2 - x1, y2 - y1)) AS pad FROM b)
    SELECT vec_id, n, round(greatest(x1 - pad, 0), 6) AS x1, round(greatest(y1 - pad, 0), 6) AS y1, round(least(x2 + pad, 200), 6) AS x2, round(least(y2 + pad, 160), 6) AS y2 FROM d""")
def roi_from_points(spark, sf_dir):
    points = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f")).withColumn("v", F.col("f").cast("double"))
    head = points.where((F.abs("v") >= 0.05) & (F.col("i") % 17).isin(0, 1, 2, 3)).select("vec_id", (100 + 200 * F.col("v")).alias("x"), (80 + 150 * F.col("v")).alias("y"))
    box = head.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d"))
    region = plane.padded_region(*map(F.col, "abcd"), F.lit(200.0), F.lit(160.0))
    return box.select("vec_id", "n", *(F.round(c, 6).alias(n) for c, n in zip(region, ("x1", "y1", "x2", "y2"), strict=True)))


@query("""WITH b AS (SELECT vec_id, 50 + 200 * embedding[1]::DOUBLE AS a, 40 + 200 * embedding[2]::DOUBLE AS b, 50 + 200 * embedding[1]::DOUBLE + 60 * abs(embedding[3]::DOUBLE) AS c, 40 + 200 * embedding[2]::DOUBLE + 60 * abs(embedding[4]::DOUBLE) AS d FROM embeddings),
    f AS (SELECT vec_id, greatest(floor(a), 0) AS l, greatest(floor(b), 0) AS t, least(ceil(c), 100) AS r, least(ceil(d), 80) AS u FROM b),
    g AS (SELECT vec_id, l, t, least(greatest(r, l + 4), 100) AS r, least(greatest(u, t + 4), 80) AS u FROM f)
    SELECT vec_id, greatest(least(l, r - 4), 0)::BIGINT AS x1, greatest(least(t, u - 4), 0)::BIGINT AS y1, r::BIGINT AS x2, u::BIGINT AS y2 FROM g""")
def clamp_boxes(spark, sf_dir):
    e = lambda k: F.get(F.col("embedding"), F.lit(k)).cast("double")
    x, y = 50 + 200 * e(0), 40 + 200 * e(1)
    box = plane.whole_box(x, y, x + 60 * F.abs(e(2)), y + 60 * F.abs(e(3)), F.lit(100), F.lit(80))
    return read(spark, sf_dir, "embeddings").select("vec_id", *(c.cast("long").alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)))


@query("""WITH t AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)
    SELECT event_id, user_id, turn, row_number() OVER (ORDER BY turn, user_id) AS pick FROM t ORDER BY turn, user_id LIMIT 24""")
def round_robin(spark, sf_dir):
    return frames.round_robin(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], 24).drop("ts")


@query("""WITH v AS (SELECT o_orderkey AS video, (o_orderkey % 40 + 1)::DOUBLE AS seconds FROM orders),
    a AS (SELECT video, seconds, i AS anchor, i * 7.0 AS secs FROM (SELECT *, unnest(range(0, floor(seconds / 7.0)::INT + 1)) AS i FROM v)),
    s AS (SELECT *, k - 1 AS shot, [-0.25, 0.0, 0.25][k] AS o FROM a, (SELECT unnest([1, 2, 3]) AS k)),
    f AS (SELECT video, anchor, shot, least(greatest(round_even((secs + o) * 10, 0)::BIGINT, 0), greatest(floor(seconds * 10)::BIGINT - 1, 0)) AS frame FROM s),
    u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY anchor, shot) = 1),
    p AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY anchor, shot) AS place, anchor, shot, frame FROM u)
    SELECT * FROM p WHERE place <= 12""")
def frame_plan(spark, sf_dir):
    videos = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.col("o_orderkey") % 40 + 1).cast("double").alias("seconds"))
    return frames.frame_plan(videos, 7.0, (-0.25, 0.0, 0.25), 10.0, 12)


@query("""SELECT p_partkey AS video, p_size::BIGINT AS anchor, unnest(range(greatest(p_size - 6, 0)::BIGINT, least(p_size + 9, 50)::BIGINT + 1, 3)) AS frame FROM part""")
def anchor_windows(spark, sf_dir):
    anchors = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("video"), F.lit(51).cast("long").alias("frames"), F.col("p_size").cast("long").alias("anchor"))
    return frames.anchor_windows(anchors, 6, 9, 3)


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS neighbours FROM conversations""")
def sequence_positions(spark, sf_dir):
    return frames.positions(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"])


@query("""SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, CASE WHEN rank <= 80 THEN 'best' WHEN rank > count(*) OVER () - 40 THEN 'weak' ELSE 'middle' END AS bucket FROM documents""")
def evidence_buckets(spark, sf_dir):
    return frames.evidence_bucket(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 80, 40).drop("n_chars")


@query("""WITH s AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent, row_number() OVER (ORDER BY doc_id) AS place FROM documents)
    SELECT * FROM s WHERE spent < 1000000 AND place <= 500""")
def running_budget(spark, sf_dir):
    return frames.within_budget(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], "n_chars", 1_000_000, 500).drop("n_chars")


@query("""SELECT i AS number, printf('Bird%05d', i) AS name FROM range(1, 100000) t(i) WHERE i NOT IN (SELECT doc_id FROM labels) ORDER BY i LIMIT 50""")
def autoname_gaps(spark, sf_dir):
    return identity.free_numbers(read(spark, sf_dir, "labels"), "doc_id", 50)


@query("""WITH r AS (SELECT doc_id::VARCHAR AS v, doc_id AS o, 0 AS k, quality FROM labels UNION ALL SELECT 'src' || doc_id % 10, doc_id, 1, quality FROM labels),
    l AS (SELECT v, arg_min(quality, o * 2 + k) AS quality FROM r GROUP BY v),
    a AS (SELECT doc_id, doc_id::VARCHAR AS v, 0 AS k FROM documents UNION ALL SELECT doc_id, source, 1 FROM documents),
    h AS (SELECT doc_id, arg_min(quality, k) AS quality, min(k) AS by_key FROM a JOIN l USING (v) GROUP BY doc_id)
    SELECT doc_id, quality, by_key FROM documents LEFT JOIN h USING (doc_id)""")
def multi_key_first_match(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").withColumn("k2", F.concat(F.lit("src"), (F.col("doc_id") % 10).cast("string")))
    return identity.first_match(read(spark, sf_dir, "documents"), "doc_id", ["doc_id", "source"], labels, "doc_id", ["doc_id", "k2"], "quality")


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING copies > 1")
def duplicate_keys(spark, sf_dir):
    return audit.duplicates(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched_orphans(spark, sf_dir):
    return audit.orphans(read(spark, sf_dir, "orders"), "o_orderkey", read(spark, sf_dir, "lineitem"), "l_orderkey").select("o_orderkey")


@query("""WITH b AS (SELECT l_orderkey AS id, l_quantity * 2 - 5 AS dx, l_quantity * 2 - 5 + l_linenumber % 3 - 0.5 AS width, 20.0 AS height, (l_quantity * 2 - 5 + l_linenumber % 3 - 0.5) * 20 + l_suppkey % 50 AS area FROM lineitem),
    i AS (SELECT id, unnest([CASE WHEN dx <= 0 THEN 'box_order' END, CASE WHEN abs(dx - width) > 1.01 THEN 'box_width' END, CASE WHEN abs(area - width * height) > greatest(2.0, 0.02 * width * height) THEN 'box_area' END]) AS rule FROM b)
    SELECT rule, count(*) AS n FROM i WHERE rule IS NOT NULL GROUP BY rule""")
def bbox_audit(spark, sf_dir):
    dx = F.col("l_quantity") * 2 - 5
    width = dx + F.col("l_linenumber") % 3 - 0.5
    boxes = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), dx.alias("x2"), F.lit(20.0).alias("y2"), width.alias("width"), F.lit(20.0).alias("height"), (width * 20 + F.col("l_suppkey") % 50).alias("area"))
    return audit.issues(boxes, F.col("id"), audit.box_rules()).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, (props->>'k')::INT AS k, value FROM events), j AS (SELECT event_id, e.k AS k, x.label, value FROM e JOIN {TAXA_SQL} ON x.k = e.k % 4)
    SELECT event_id, k, string_split(label, ';')[-1] AS common_name,
      CASE k % 4 WHEN 0 THEN 'species' WHEN 1 THEN 'family' WHEN 2 THEN 'class' ELSE 'blank' END AS rank,
      CASE WHEN k % 4 = 3 THEN 'unknown' WHEN k % 4 = 2 THEN 'unknown_bird' WHEN value / 100 >= 0.7 THEN 'proposed_high' WHEN value / 100 >= 0.3 THEN 'proposed_low' ELSE 'weak_guess' END AS band FROM j""")
def json_label_parse(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    taxa = spark.createDataFrame(list(enumerate(TAXA)), "t int, label string")
    joined = events.join(F.broadcast(taxa), F.col("k") % 4 == F.col("t"))  # four rows
    label = F.col("label")
    return joined.select("event_id", "k", species.common_name(label).alias("common_name"), species.rank_of(label).alias("rank"), species.confidence_band(F.col("value") / 100, species.review_status(label)).alias("band"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events""")
def filename_timestamp(spark, sf_dir):
    forms = ["yyyy-MM-dd_HH-mm-ss", "yyyyMMdd_HHmmss", "yyyy_MM_dd_HH_mm_ss", "yyyyMMddHHmmss"]
    text = F.lit("")
    for k, form in enumerate(forms):
        text = F.when(F.col("event_id") % 4 == k, F.date_format("ts", form)).otherwise(text)
    named = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("D:\\clips/cam1_"), text, F.lit("_x.mp4")).alias("path"))
    return named.select("event_id", F.date_format(clean.name_time(F.col("path")), "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("SELECT doc_id, 'doc-' || substr(sha1(doc_id::VARCHAR || '|' || coalesce(source, 'None')), 1, 12) AS stable FROM documents")
def deterministic_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", clean.stable_id("doc", F.col("doc_id"), F.col("source")).alias("stable"))


@query("""SELECT user_id, count(*) AS actions, arg_max(event_type, event_id) FILTER (event_type IN ('signup', 'purchase')) AS status, arg_max(value, event_id) FILTER (event_type = 'view') AS score FROM events GROUP BY user_id""")
def action_log_fold(spark, sf_dir):
    t = F.col("event_type")
    return identity.fold_actions(read(spark, sf_dir, "events"), "user_id", "event_id", {"status": F.when(t.isin("signup", "purchase"), t), "score": F.when(t == "view", F.col("value"))})


@query("""SELECT user_id, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return identity.latest(events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("SELECT lang, source, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ALL")
def ext_inventory(spark, sf_dir):
    return profiles.inventory(read(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")
