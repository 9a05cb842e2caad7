"""Rules of single values, bound to values that are made of the tables' columns, and listings; the SQL works them out by itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean
from tessera.operators import clusters, fusion, measures, paths, quantiles, replay, scorers, similarity
from tessera.plans.catalog import CLUSTER, COSINES, vectors
from tessera.plans.registry import query, read


def derived(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    """Columns made of a table's own by expressions that read the same in both engines."""
    return read(spark, sf_dir, table).selectExpr(*(f"{e} AS {name}" for name, e in columns.items()))


def as_sql(table: str, columns: dict[str, str]) -> str:
    return f"x AS (SELECT {', '.join(f'{e} AS {name}' for name, e in columns.items())} FROM {table})"


def pick(number: str, *values: str) -> str:
    """The value whose place the number has, modulo how many there are."""
    return f"CASE ({number}) % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


#: Digits of dates and times, some of them none: month 13 and 14, day 31 of short months, hours from 24.
DIGITS = "CAST(2019 + user_id % 8 AS INT), CAST(1 + event_id % 14 AS INT), CAST(1 + event_id % 31 AS INT)"
CLOCK = "CAST(event_id % 26 AS INT), CAST(event_id % 60 AS INT), CAST(event_id * 7 % 60 AS INT)"
PATH = pick(
    "event_id", f"'D:/clips/cam_' || printf('%04d%02d%02d_%02d%02d%02d.mp4', {DIGITS}, {CLOCK})", f"printf('%04d-%02d-%02d_%02d-%02d-%02d.mp4', {DIGITS}, {CLOCK})", f"printf('cam_%04d-%02d-%02d.mp4', {DIGITS})",
    f"printf('%04d%02d%02d.mp4', {DIGITS})", f"printf('x%04d%02d%02d%02d%02d%02dy', {DIGITS}, {CLOCK})", "event_type || '.mp4'", f"printf('a/%04d%02d%02d/', {DIGITS}) || event_type || '.mp4'", f"printf('%04d_%02d_%02d %02d_%02d_%02d', {DIGITS}, {CLOCK})", "NULL",
)


def _name_time_sql(v: str) -> str:
    base = f"regexp_extract(regexp_replace({v}, '[/\\\\]+$', ''), '[^/\\\\]*$')"
    part = lambda p, k: f"regexp_extract({base}, '{p}', {k})"
    tries = []
    for p in clean.NAME_TIMES:
        clock = " || ':' || ".join(part(p, k) for k in (4, 5, 6)) if p.count("(") == 6 else "'00:00:00'"
        tries.append(f"try_strptime({part(p, 1)} || '-' || {part(p, 2)} || '-' || {part(p, 3)} || ' ' || {clock}, '%Y-%m-%d %H:%M:%S')")
    return f"coalesce({', '.join(tries)})"


NAMED = {"id": "event_id", "path": PATH}


@query(f"WITH {as_sql('events', NAMED)} SELECT id, strftime({_name_time_sql('path')}, '%Y-%m-%d %H:%M:%S') AS seen FROM x")
def name_times(spark, sf_dir):
    return derived(spark, sf_dir, "events", NAMED).select("id", F.date_format(clean.name_time(F.col("path")), "yyyy-MM-dd HH:mm:ss").alias("seen"))


CAPTURED = NAMED | {"captured": pick("user_id", f"printf('%04d-%02d-%02dT%02d:%02d:%02d', {DIGITS}, {CLOCK})", f"printf('%04d-%02d-%02d %02d:%02d', {DIGITS}, CAST(event_id % 26 AS INT), CAST(event_id % 60 AS INT))", f"printf('%04d-%02d-%02d', {DIGITS})", "''", f"printf('%04d-%02d-%02dT%02d:%02d:%02d-05:00', {DIGITS}, {CLOCK})", "event_type", "NULL", f"printf('%04d-%02d-%02dT%02d:%02d:%02d.987Z', {DIGITS}, {CLOCK})")}


def _iso_sql(v: str) -> str:
    part = lambda k, other: f"coalesce(nullif(regexp_extract({v}, '{clean.ISO_TIME}', {k}), ''), '{other}')"
    time = f"try_strptime({part(1, '')} || ' ' || {part(2, '00:00')} || {part(3, ':00')}, '%Y-%m-%d %H:%M:%S')"
    return f"strftime({time}, '%Y-%m-%dT%H:%M:%S') || replace({part(4, '')}, 'Z', '+00:00')"


@query(f"""WITH {as_sql('events', CAPTURED)} SELECT id, coalesce({', '.join(f"{_iso_sql(v)}, strftime({_name_time_sql(v)}, '%Y-%m-%dT%H:%M:%S')" for v in ('captured', 'path'))}) AS seen FROM x""")
def observation_times(spark, sf_dir):
    return derived(spark, sf_dir, "events", CAPTURED).select("id", clean.any_time(F.col("captured"), F.col("path")).alias("seen"))


HEADED = {"id": "event_id", "header": pick("event_id", "' Row ' || upper(event_type) || ' '", "'_' || event_type || '_'", "event_type || ' -'", "event_type || '--' || CAST(user_id AS VARCHAR(20)) || '  c'", "'Größe (' || event_type || ')'", "'--' || substr(event_type, 9)", "'x__' || event_type || '.Y'")}


@query(f"""WITH {as_sql('events', HEADED)} SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(header), '^\\s+|\\s+$', '', 'g'), '[\\s-]+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS name FROM x""")
def header_names(spark, sf_dir):
    return derived(spark, sf_dir, "events", HEADED).select("id", clean.header_name(F.col("header")).alias("name"))


CLASSED = {"id": "event_id", "class": pick("user_id + event_id", "'Animal'", "'hummingbird'", "'person'", "' HUMAN ' || event_type", "'vehicle'", "'car'", "'Truck ' || event_type", "'bus'", "'bird in car'", "event_type", "''")}


@query(f"""WITH {as_sql('events', CLASSED)} SELECT id, CASE WHEN regexp_matches(lower(class), 'animal|bird') THEN 'animal' WHEN regexp_matches(lower(class), 'person|human') THEN 'person' WHEN regexp_matches(lower(class), 'vehicle|car|truck|bus') THEN 'vehicle' ELSE 'other' END AS role FROM x""")
def detection_roles(spark, sf_dir):
    return derived(spark, sf_dir, "events", CLASSED).select("id", measures.role_of(F.col("class")).alias("role"))


RANKED = {"id": "event_id", "mean": "CASE WHEN event_id % 5 > 0 THEN value / 40 - 0.2 END", "matches": "user_id % 60", "points_a": "CASE WHEN event_id % 7 > 0 THEN event_id % 100 END", "points_b": "event_id * 3 % 80"}


@query(f"""WITH {as_sql('events', RANKED)} SELECT id, round(greatest(0, least(1, 0.7 * greatest(0, least(1, coalesce(mean, 0))) + 0.3 * least(1, 6.0 * matches / least(greatest(1, coalesce(points_a, 1)), greatest(1, points_b))))) + 1e-9, 6) AS rank FROM x""")
def keypoint_ranks(spark, sf_dir):
    rank = fusion.keypoint_rank(*map(F.col, ("mean", "matches", "points_a", "points_b")))
    return derived(spark, sf_dir, "events", RANKED).select("id", F.round(rank + 1e-9, 6).alias("rank"))


NUMBERED = {"id": "event_id", "n": "event_id * 1237 + 1", "alias": "CASE WHEN event_id % 3 = 0 THEN event_type END"}


@query(f"""WITH {as_sql('events', NUMBERED)} SELECT id, coalesce(alias, 'row-' || lpad(n::VARCHAR, greatest(6, length(n::VARCHAR))::INT, '0')) || ' Bird' || lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INT, '0') AS names FROM x""")
def numbered_names(spark, sf_dir):
    n = F.col("n")
    return derived(spark, sf_dir, "events", NUMBERED).select("id", F.concat_ws(" ", clean.row_id(F.col("alias"), n), clean.auto_name(n)).alias("names"))


SHOWN = {"id": "event_id", "v": pick("event_id", "value / 3 - 10", "CAST('NaN' AS DOUBLE)", "value", "CAST('Infinity' AS DOUBLE)", "NULL", "-value / 7")}


@query(f"""WITH {as_sql('events', SHOWN)} SELECT id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN '' ELSE printf('%.8f', v) END AS shown FROM x""")
def fixed_digits(spark, sf_dir):
    return derived(spark, sf_dir, "events", SHOWN).select("id", clean.fixed_digits(F.col("v"), 8).alias("shown"))


LISTED = {"id": "event_id", "t": pick("event_id", "CAST(event_id % 9 AS VARCHAR(20)) || ',' || CAST(user_id AS VARCHAR(20)) || ';'", "' ; '", "''", "NULL", "' ' || CAST(user_id AS VARCHAR(20))", "'-' || CAST(user_id AS VARCHAR(20)) || ',,0.25; 2'")}


@query(f"""WITH {as_sql('events', LISTED)}, n AS (SELECT id, list_transform(list_filter(regexp_split_to_array(t, '[;,]'), lambda p: trim(p) <> ''), lambda p: trim(p)::DOUBLE) AS n FROM x)
    SELECT id, array_to_string(CASE WHEN len(n) > 0 THEN n ELSE [9.0::DOUBLE] END, '|') AS offsets FROM n""")
def offset_lists(spark, sf_dir):
    numbers = F.transform(clean.number_list(F.col("t"), [9.0]), lambda x: x.cast("string"))
    return derived(spark, sf_dir, "events", LISTED).select("id", F.array_join(numbers, "|").alias("offsets"))


GUARDED = {"id": "event_id", "path": "'C:/Data' || " + pick("event_id", "'/' || event_type || '/a.png'", "'X/a'", "''", "'//b/' || event_type"), "root": pick("user_id", "'c:/data/'", "'C:/Data/' || event_type", "'D:/Data'", "'C:/Data//B'")}
_KEY = "lower(regexp_replace(replace(trim({}), '/', chr(92)), '[\\\\]+', chr(92) || chr(92), 'g'))"


@query(f"""WITH {as_sql('events', GUARDED)}, k AS (SELECT id, {_KEY.format('path')} AS p, rtrim({_KEY.format('root')}, chr(92)) AS r FROM x) SELECT id, (p = r OR starts_with(p, r || chr(92)))::INT AS inside FROM k""")
def path_guard(spark, sf_dir):
    return derived(spark, sf_dir, "events", GUARDED).select("id", clean.under_folder(F.col("path"), F.col("root")).cast("int").alias("inside"))


RAW = {"id": "event_id", "raw": "event_id % 1000 / CAST(8 AS DOUBLE) - 5"}


@query(f"WITH {as_sql('events', RAW)} SELECT id, round_even(least(greatest(raw, 0), 100), 2) AS score FROM x")
def legacy_scores(spark, sf_dir):
    return derived(spark, sf_dir, "events", RAW).select("id", measures.legacy_score(F.col("raw")).alias("score"))


@query("""WITH f AS (SELECT user_id, event_type AS t, min(event_id) AS o FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) AS n FROM f)
    SELECT user_id, string_agg(t, ';' ORDER BY o) FILTER (n <= 3) AS kinds FROM r GROUP BY user_id""")
def compact_kinds(spark, sf_dir):
    return read(spark, sf_dir, "events").transform(quantiles.first_distinct, "user_id", F.col("event_type"), F.col("event_id"), 3).withColumnRenamed("texts", "kinds")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 100 END AS score, ['high_priority_candidate', 'low_priority_candidate', 'unranked_missing_fusion_inputs', 'review_candidate'][event_id % 4 + 1] AS bucket, event_id % 11 = 0 AS differ FROM events)
    SELECT event_id, CASE WHEN differ THEN 'blocked_known_different_copresence' WHEN score IS NULL THEN 'not_used_missing_fusion_score' WHEN score < 0.65 THEN 'not_used_below_cluster_threshold_0.650'
      WHEN bucket IN ('low_priority_candidate', 'unranked_missing_fusion_inputs') THEN 'not_used_bucket_' || bucket ELSE 'eligible_fusion_edge' END AS reason FROM e""")
def edge_reasons(spark, sf_dir):
    e = F.col("event_id")
    buckets = F.array(*map(F.lit, ("high_priority_candidate", "low_priority_candidate", "unranked_missing_fusion_inputs", "review_candidate")))
    score, bucket = F.when(e % 7 != 0, F.col("value") / 100), F.get(buckets, (e % 4).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", fusion.edge_reason(score, bucket, e % 11 == 0, 0.65).alias("reason"))


@query(f"""{COSINES.replace("WITH e", "WITH RECURSIVE e")}, l AS (SELECT a, b, cosine FROM p WHERE a < b AND cosine >= {CLUSTER}), s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(id, other) AS (SELECT id, id FROM e UNION SELECT r.id, s.b FROM r JOIN s ON r.other = s.a), c AS (SELECT id, min(other) AS root FROM r GROUP BY id),
    n AS (SELECT root, count(*) AS size FROM c GROUP BY root),
    i AS (SELECT root, count(*) AS pairs, count(*) FILTER (a % 3 <> 0) AS used, arg_min(a * 10000000 + b, (-cosine, a * 10000000 + b)) AS best_pair, max(cosine) AS best_score FROM l JOIN c ON c.id = l.a GROUP BY root)
    SELECT root, size, CASE WHEN size = 1 THEN 'singleton_review_candidate' ELSE 'multirow_review_candidate' END AS status, coalesce(used, 0) AS used, coalesce(pairs, 0) AS pairs, best_pair, best_score FROM n LEFT JOIN i USING (root)""")
def cluster_summary(spark, sf_dir):
    v = vectors(spark, sf_dir).drop("name")
    edges = similarity.pairs_above(v, CLUSTER).withColumnRenamed("cosine", "score")
    groups = clusters.components(v.select("id"), edges)
    decided = edges.withColumns({"pair": F.col("a") * 10_000_000 + F.col("b"), "decision": F.when(F.col("a") % 3 == 0, "not_used").otherwise("used")})
    return clusters.summary(groups, decided)


@query(f"""{COSINES.replace("WITH e", "WITH RECURSIVE e")}, l AS (SELECT a, b, a * 10000000 + b AS pair, row_number() OVER (ORDER BY cosine DESC, a, b) AS n FROM p WHERE a < b AND cosine >= {CLUSTER}),
    s(n, pair, a, decision, roots) AS (SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, range(0, (SELECT max(id) + 1 FROM e)) UNION ALL
      SELECT n, pair, a, decision, CASE WHEN decision = 'used' THEN list_transform(roots, lambda r: CASE WHEN r = high THEN low ELSE r END) ELSE roots END FROM (
        SELECT *, CASE WHEN len(list_filter(range(1, len(roots) + 1), lambda i: roots[i] = low AND len(list_filter(range(1, 8), lambda k: (i - 1) // 7 * 7 + k <= len(roots) AND roots[(i - 1) // 7 * 7 + k] = high
            AND ((i - 1) % 3 = 2 OR ((i - 1) // 7 * 7 + k - 1) % 3 = 2 OR (i - 1) % 3 <> ((i - 1) // 7 * 7 + k - 1) % 3))) > 0)) > 0 AND low <> high THEN 'blocked' WHEN low = high THEN 'already_connected' ELSE 'used' END AS decision FROM (
          SELECT l.n, l.pair, l.a, roots, least(roots[l.a + 1], roots[l.b + 1]) AS low, greatest(roots[l.a + 1], roots[l.b + 1]) AS high FROM s JOIN l ON l.n = s.n + 1)))
    SELECT s.pair AS id, s.decision || ' ' || (SELECT roots FROM s ORDER BY n DESC LIMIT 1)[s.a + 1] AS decision FROM s JOIN l USING (pair)""")
def merges_apart(spark, sf_dir):
    """Seven vectors in a row share a frame; every third is unknown there, the others are two animals by turns."""
    v, i = vectors(spark, sf_dir).drop("name"), F.col("id")
    seen = v.select("id", F.floor(i / 7).cast("string").alias("frame"), F.when(i % 3 == 2, " ").otherwise(F.concat(F.lit("bird"), (i % 3).cast("string"))).alias("animal"))
    edges = similarity.pairs_above(v, CLUSTER).withColumnRenamed("cosine", "score").withColumn("pair", F.col("a") * 10_000_000 + F.col("b"))
    nothing = spark.createDataFrame([], "a long, b long")
    decided = clusters.constrained(v.select("id"), edges, nothing, CLUSTER, seen)
    return decided.select(F.col("pair").alias("id"), F.concat_ws(" ", "decision", F.col("root").cast("string")).alias("decision"))


#: The events as a log: each names the birds of one number by another; one in nine by their own.
LOG = {"entry": "event_id", "old": "'bird' || CAST(user_id AS VARCHAR(20))", "new": "'bird' || CAST((user_id * 31 + event_id * 7) % 120 AS VARCHAR(20))"}
SIGHTED = {"id": "event_id", "name": "'bird' || CAST(event_id * 13 % 130 AS VARCHAR(20))", "since": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END"}


def _replay_sql(until: str) -> str:
    return f"""WITH RECURSIVE {as_sql('events', LOG).replace('x AS', 'g AS')}, l AS (SELECT * FROM g WHERE old <> new AND {until}), {as_sql('events', SIGHTED)},
      s AS (SELECT l.entry AS entry, l.new AS new, n.entry AS next FROM l ASOF LEFT JOIN l n ON l.new = n.old AND l.entry < n.entry),
      f AS (SELECT x.id AS id, x.name AS name, n.entry AS entry FROM (SELECT id, name, coalesce(since, -1) AS since FROM x) x ASOF LEFT JOIN l n ON x.name = n.old AND x.since < n.entry),
      w(id, entry) AS (SELECT id, entry FROM f WHERE entry IS NOT NULL UNION ALL SELECT w.id, s.next FROM w JOIN s USING (entry) WHERE s.next IS NOT NULL),
      z AS (SELECT id, arg_max(new, entry) AS final FROM w JOIN s USING (entry) GROUP BY id) SELECT id, name, coalesce(final, name) AS final FROM f LEFT JOIN z USING (id)"""


@query(_replay_sql("TRUE"))
def replayed_names(spark, sf_dir):
    return replay.replayed(derived(spark, sf_dir, "events", SIGHTED), derived(spark, sf_dir, "events", LOG), F.col("since")).drop("since")


@query(_replay_sql("entry <= 400"))
def names_at_a_time(spark, sf_dir):
    """The state after an entry in the middle of the log: later ones don't count, for rows that came later either."""
    return replay.replayed(derived(spark, sf_dir, "events", SIGHTED), derived(spark, sf_dir, "events", LOG), F.col("since"), until=400).drop("since")


#: Documents stand for files, pages for records that name them in many ways.
INVENTORY = {"path": pick("doc_id", "'/data/project/crops/c' || CAST(doc_id AS VARCHAR(20)) || '.png'", "'/data/run/c' || CAST(doc_id AS VARCHAR(20)) || '.png'", "'/data/run/crops/c' || CAST(doc_id AS VARCHAR(20)) || '.png'", "'D:/clips/c' || CAST(doc_id AS VARCHAR(20)) || '.png'", "'/data/project//./run/c' || CAST(doc_id AS VARCHAR(20)) || '.png'")}
_C = "'c' || CAST(event_id % 400 AS VARCHAR(20)) || '.png'"
ASKED = {"id": "event_id", "profile": "user_id", "path": pick("event_id + user_id", f"'crops/' || {_C}", f"' ' || {_C} || ' '", f"'/data/run/' || {_C}", f"'D:/clips/' || {_C}", f"'run/' || {_C}", "'  '", "NULL", f"'elsewhere/' || {_C}")}
_TIDY = "regexp_replace(regexp_replace(regexp_replace(replace({}, chr(92), '/'), '/+', '/', 'g'), '/(\\./)+', '/', 'g'), '^$', '')"


def _candidates_sql(candidates: list[str]) -> str:
    tried = ", ".join(f"{{'k': {k}, 'source': {source}, 'path': {c}}}" for k, (source, c) in enumerate(candidates))
    return f"""{as_sql('documents', INVENTORY).replace('x AS', 'f AS')}, {as_sql('events', ASKED)}, t AS (SELECT id, trim(path) AS p FROM x WHERE trim(path) <> ''),
      c AS (SELECT id, unnest([{tried}]) AS c FROM t), h AS (SELECT id, c.k AS k, c.source AS source, c.path AS path, {_TIDY.format('c.path')} IN (SELECT {_TIDY.format('f.path')} FROM f) AS there FROM c WHERE c.path IS NOT NULL),
      b AS (SELECT id, first(path ORDER BY NOT there, k) AS resolved, bool_or(there) AS exists, first(CASE WHEN there THEN source ELSE source || '_missing' END ORDER BY NOT there, k) AS source FROM h GROUP BY id),
      r AS (SELECT x.id, x.profile, coalesce(resolved, '') AS resolved, coalesce(exists, FALSE) AS exists, coalesce(source, 'blank') AS source FROM x LEFT JOIN b USING (id))"""


_WHOLE = "regexp_matches(p, '^([/' || chr(92) || chr(92) || ']|[A-Za-z]:[/' || chr(92) || chr(92) || '])')"


@query("WITH " + _candidates_sql([("'absolute'", f"CASE WHEN {_WHOLE} THEN p END"), ("'relative_to_project_root'", f"CASE WHEN NOT {_WHOLE} THEN '/data/project/' || p END"), ("'relative_to_manifest_dir'", f"CASE WHEN NOT {_WHOLE} THEN '/data/run/' || p END")]) + " SELECT id, resolved, exists, source FROM r")
def resolved_paths(spark, sf_dir):
    c = paths.manifest_candidates(F.col("path"), F.lit("/data/project/"), F.lit("/data/run"))
    return paths.resolved(derived(spark, sf_dir, "events", ASKED), "id", "path", c, derived(spark, sf_dir, "documents", INVENTORY)).select("id", "resolved", "exists", "source")


@query("WITH " + _candidates_sql([("'as_is'", "p"), ("'project'", "'/data/project/' || p"), ("'output'", "'/data/run/' || p"), ("'crops'", "'/data/run/crops/' || regexp_extract(p, '[^/]*$')")]) + """,
    n AS (SELECT id, profile, resolved, source, row_number() OVER (PARTITION BY profile ORDER BY id DESC) AS place FROM r WHERE exists) SELECT id, profile, resolved, source, place, place = 1 AS hero FROM n WHERE place <= 300""")
def profile_crops(spark, sf_dir):
    """The first 300 crops of a profile that exist, newest first; the limit is the listing's own."""
    c = paths.crop_candidates(F.col("path"), F.lit("/data/project"), F.lit("/data/run"))
    rows = paths.resolved(derived(spark, sf_dir, "events", ASKED), "id", "path", c, derived(spark, sf_dir, "documents", INVENTORY))
    return paths.shown_per_profile(rows, "profile", [F.col("id").desc()]).select("id", "profile", "resolved", "source", "place", "hero")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 80")
def latest_rows(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy(F.col("event_id").desc()).limit(80)


@query("""SELECT event_id, row_number() OVER (ORDER BY user_id, value DESC, event_id) AS place FROM events ORDER BY place LIMIT 120""")
def scored_crop_order(spark, sf_dir):
    order = [F.col("user_id"), F.col("value").desc(), F.col("event_id")]
    first = read(spark, sf_dir, "events").select("event_id", "user_id", "value").orderBy(*order).limit(120)
    return similarity.with_place(first, order).select("event_id", "place")


@query("""SELECT event_id, row_number() OVER (ORDER BY (event_type = 'error')::INT, value DESC, event_id) AS place FROM events ORDER BY place LIMIT 100""")
def candidate_order(spark, sf_dir):
    order = [(F.col("event_type") == "error").cast("int"), F.col("value").desc(), F.col("event_id")]
    first = read(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(*order).limit(100)
    return similarity.with_place(first, order).select("event_id", "place")


@query("""SELECT source, count(*) AS rows, count(*) FILTER (n_chars > 1000) AS long_rows, count(DISTINCT lang) AS langs FROM documents GROUP BY source""")
def export_counters(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("n_chars") > 1000).alias("long_rows"), F.countDistinct("lang").alias("langs"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount * 4 >= 0.20""")
def legacy_detections(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumns({"class_id": F.when(F.col("l_returnflag") == "A", 1).otherwise(2), "confidence": F.col("l_discount") * 4})
    return measures.legacy_animals(rows, "class_id", "confidence", 1, 0.20).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _network():
    import tessera_network_scorer  # noqa: F401 - a library that most clusters lack


def _logistic(weights, value, user):
    return 1 / (1 + np.exp(-(value * weights[0] + user * weights[1])))


#: A scorer whose model can't be had here, so that its declared fallback runs.
LOGISTIC = scorers.Scorer("logistic", lambda: np.array([0.02, -0.05]), _logistic)
NETWORK = scorers.Scorer("network", _network, lambda model, value, user: value, fallback=LOGISTIC)


@query("""SELECT event_id, CASE WHEN event_id % 9 > 0 THEN round(1 / (1 + exp(-(value * 0.02 - user_id * 0.05))) + 1e-9, 6) END AS score, 'logistic' AS scorer FROM events""")
def scored_events(spark, sf_dir):
    found = scorers.scored(NETWORK, F.when(F.col("event_id") % 9 > 0, F.col("value")), F.col("user_id"))
    return read(spark, sf_dir, "events").select("event_id", found.alias("s")).select("event_id", F.round(F.col("s.score") + 1e-9, 6).alias("score"), "s.scorer")
