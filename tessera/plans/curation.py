"""Plans over review decisions, listings, lookups and samples, bound to the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean
from tessera.operators import curation, frames, identity, lookups, profiles
from tessera.operators.numbering import numbered
from tessera.plans.registry import query, read

#: A review queue made of events: identity by user, five states and none, notes on some.
QUEUE_SQL = """q AS (SELECT event_id AS id, printf('Bird%05d', user_id) AS identity, ['sandbox', 'active', 'multibird', 'low_quality', 'false_positive', NULL, 'provisional'][event_id % 7 + 1] AS identity_status,
    ['auto', 'new', NULL][event_id % 3 + 1] AS review_status, '' AS training_label, CASE event_id % 4 WHEN 0 THEN 'seen' WHEN 1 THEN '' END AS notes, CASE WHEN event_id % 6 <> 0 THEN value END AS score, 'crop' || event_id AS path FROM events)"""
STATES = ["sandbox", "active", "multibird", "low_quality", "false_positive", None, "provisional"]


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    of = lambda values: F.get(F.array(*map(F.lit, values)), (e % len(values)).cast("int"))
    return read(spark, sf_dir, "events").select(
        e.alias("id"), clean.auto_name(F.col("user_id")).alias("identity"), of(STATES).alias("identity_status"), of(["auto", "new", None]).alias("review_status"), F.lit("").alias("training_label"),
        F.when(e % 4 == 0, "seen").when(e % 4 == 1, "").alias("notes"), F.when(e % 6 != 0, F.col("value")).alias("score"), F.concat(F.lit("crop"), e).alias("path"),
    )


@query(f"""WITH {QUEUE_SQL} SELECT id, row_number() OVER (ORDER BY identity, CASE identity_status WHEN 'multibird' THEN 0 WHEN 'low_quality' THEN 1 WHEN 'false_positive' THEN 3 ELSE 2 END, coalesce(score, 999), path) AS place FROM q""")
def listing_order(spark, sf_dir):
    return numbered(queue(spark, sf_dir), curation.listing_order("identity", "identity_status", "score", "path"), "place").select("id", "place")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN user_id % 4 = 0 THEN 'Zed ' || user_id ELSE printf('Bird%05d', user_id) END AS name, user_id FROM events)
    SELECT name, row_number() OVER (ORDER BY user_id % 4 = 0, CASE WHEN user_id % 4 <> 0 THEN user_id END, lower(name)) AS place FROM n""")
def natural_name_order(spark, sf_dir):
    user = F.col("user_id")
    names = read(spark, sf_dir, "events").select(F.when(user % 4 == 0, F.concat(F.lit("Zed "), user)).otherwise(clean.auto_name(user)).alias("name")).distinct()
    return numbered(names, curation.natural_order(F.col("name")), "place")


@query(f"""WITH {QUEUE_SQL} SELECT CASE WHEN identity_status IN ('sandbox', 'active') THEN replace(identity_status, 'active', 'true_names') WHEN identity_status IS NULL OR identity_status = 'provisional' THEN 'raw' END AS lane,
    count(*) AS n, count(*) FILTER (coalesce(identity_status, '') NOT IN ('false_positive', 'multibird')) AS n_counted FROM q GROUP BY 1""")
def review_lanes(spark, sf_dir):
    status = F.col("identity_status")
    taking_part = curation.counted(status, ("false_positive", "multibird"))
    return queue(spark, sf_dir).groupBy(curation.lane(status).alias("lane")).agg(F.count("*").alias("n"), F.count_if(taking_part).alias("n_counted"))


@query(f"""WITH {QUEUE_SQL}, a AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'Bird99999' ELSE identity END AS identity, CASE WHEN id % 5 = 0 THEN 'provisional' ELSE identity_status END AS identity_status, CASE WHEN id % 5 = 0 THEN 'auto' ELSE review_status END AS review_status, training_label, notes FROM q),
    b AS (SELECT id, identity, CASE WHEN id % 8 = 3 THEN 'low_quality' ELSE identity_status END AS identity_status, review_status, CASE WHEN id % 8 = 3 THEN 'blurred' ELSE training_label END AS training_label, CASE WHEN id % 8 = 3 THEN 'out of focus' ELSE notes END AS notes FROM a),
    c AS (SELECT *, identity_status = 'sandbox' AS r FROM b)
    SELECT id, identity, CASE WHEN r THEN 'provisional' ELSE identity_status END AS identity_status, CASE WHEN r THEN 'auto' ELSE review_status END AS review_status, CASE WHEN r THEN '' ELSE training_label END AS training_label,
      CASE WHEN r THEN coalesce(nullif(notes, '') || '; ', '') || 'returned to raw from sandbox' ELSE notes END AS notes FROM c""")
def moved_marked_reset(spark, sf_dir):
    rows = queue(spark, sf_dir).drop("score", "path")
    rows = curation.moved(rows, F.col("id") % 5 == 0, "Bird99999")
    rows = curation.marked(rows, F.col("id") % 8 == 3, "low_quality", "blurred", "out of focus")
    return curation.reset_to_raw(rows, F.coalesce(F.col("identity_status") == "sandbox", F.lit(False)), "sandbox")


@query(f"""WITH {QUEUE_SQL} SELECT id, coalesce(nullif(identity_status, ''), CASE WHEN coalesce(review_status, 'new') = 'new' THEN 'provisional' END) AS identity_status, coalesce(nullif(review_status, 'new'), 'auto') AS review_status,
    CASE WHEN id % 2 = 0 THEN 'before' WHEN coalesce(review_status, 'new') = 'new' THEN 'now' END AS reviewed_at FROM q""")
def settled_new_rows(spark, sf_dir):
    rows = queue(spark, sf_dir).withColumn("reviewed_at", F.when(F.col("id") % 2 == 0, "before"))
    return curation.settle_new(rows, F.lit("now")).select("id", "identity_status", "review_status", "reviewed_at")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_rows(spark, sf_dir):
    kept = curation.deleted([read(spark, sf_dir, "documents")], "doc_id", read(spark, sf_dir, "labels").where("toxic = 1"))
    return kept[0].select("doc_id", "source")


@query("""SELECT doc_id, CASE WHEN quality <> 1 THEN 'label' WHEN doc_id % 3 = 0 THEN 'not_premium' WHEN doc_id % 10 = 1 THEN 'no_path' WHEN doc_id % 7 = 0 THEN 'coordinates' END AS reason FROM labels""")
def training_gate(spark, sf_dir):
    d = F.col("doc_id")
    label = F.when(F.col("quality") == 1, "good").otherwise("bad")
    point = F.when(d % 7 == 0, F.when(d % 2 == 0, -1.0)).otherwise(d.cast("double"))
    reason = curation.training_gate(label, d % 3 != 0, F.when(d % 10 == 1, " ").otherwise("x.png"), [point, d.cast("double")], "good")
    return read(spark, sf_dir, "labels").select("doc_id", reason.alias("reason"))


@query("""WITH r AS (SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50) SELECT * FROM r WHERE event_type NOT IN ('error', 'click') AND event_id % 3 = 0 ORDER BY event_id DESC LIMIT 1""")
def latest_action(spark, sf_dir):
    kind = F.col("event_type")
    name = F.when(kind == "error", "undo_error").when(kind == "click", "pre_undo").otherwise(kind)
    actions = read(spark, sf_dir, "events").select("event_id", "event_type", name.alias("action"), F.when(F.col("event_id") % 3 == 0, "b").alias("backup"))
    return curation.last_with_backup(actions, "event_id", "action", "backup").select("event_id", "event_type")


@query("""SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_recorded, count(*) FILTER (event_type = 'purchase') AS n_full, count(*) FILTER (event_type = 'view') AS n_partial, 'PASS_READY_PROVISIONAL_SCALE' AS status FROM events""")
def run_status(spark, sf_dir):
    kind = F.col("event_type")
    rows = read(spark, sf_dir, "events").withColumn("state", F.when(kind == "purchase", "full").when(kind == "view", "partial").otherwise("other"))
    return curation.run_status(rows, "state", kind != "error", scale_ready=True, validated=False)


@query("""SELECT o_orderkey, o_custkey, l.l_partkey, l.l_quantity FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_partkey, l_linenumber * 1000000 + l_partkey) AS l_partkey, arg_max(l_quantity, l_linenumber * 1000000 + l_partkey) AS l_quantity
    FROM (SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) = 1) GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey""")
def last_wins_join(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    single = lines.join(lines.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n")).where("n = 1").drop("n"), ["l_orderkey", "l_linenumber", "l_partkey"])
    right = single.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"))
    return lookups.with_last(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), right, "o_orderkey", "at", ["l_partkey", "l_quantity"])


@query("""WITH f AS (SELECT doc_id AS place, 'img' || doc_id * 2 || '.png' AS name, quality * 10 + toxic AS score FROM labels)
    SELECT d.doc_id AS place, coalesce(a.score, b.score) AS score, CASE WHEN a.place IS NOT NULL THEN 'name' WHEN b.place IS NOT NULL THEN 'place' ELSE 'none' END AS matched
    FROM documents d LEFT JOIN f a ON a.name = 'img' || d.doc_id || '.png' LEFT JOIN f b ON b.place = d.doc_id""")
def predictions_by_name_or_place(spark, sf_dir):
    staged = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.concat(F.lit("a/IMG"), "doc_id", F.lit(".PNG")).alias("path"))
    found = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("place"), F.concat(F.lit("b\\img"), F.col("doc_id") * 2, F.lit(".png")).alias("path"), (F.col("quality") * 10 + F.col("toxic")).alias("score"))
    return lookups.by_name_or_place(staged, found, "score").drop("path")


@query("""WITH p AS (SELECT l_orderkey, max(l_extendedprice) AS largest FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, largest AS largest_other, coalesce(largest / greatest(1.0, l_extendedprice) >= 1.5, false) AS dominated FROM lineitem LEFT JOIN p USING (l_orderkey) WHERE l_returnflag <> 'R'""")
def dominated_boxes(spark, sf_dir):
    role = F.when(F.col("l_returnflag") == "R", "person").otherwise("animal")
    boxes = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", role.alias("role"))
    return lookups.largest_in_frame(boxes, "l_orderkey", "role", "animal", "person", "l_extendedprice", 1.5).drop("role", "l_extendedprice")


@query("""WITH f AS (SELECT doc_id AS o, 'p' || doc_id AS k0, 'n' || doc_id % 40 AS k1, 's' || doc_id % 7 AS k2, quality * 2 + toxic AS v FROM labels), n1 AS (SELECT k1, arg_min(v, o) AS v FROM f GROUP BY k1), n2 AS (SELECT k2, arg_min(v, o) AS v FROM f GROUP BY k2)
    SELECT doc_id, coalesce(f.v, n1.v, n2.v) AS v, CASE WHEN f.v IS NOT NULL THEN 0 WHEN n1.v IS NOT NULL THEN 1 WHEN n2.v IS NOT NULL THEN 2 END AS kind
    FROM documents LEFT JOIN f ON f.k0 = 'p' || doc_id LEFT JOIN n1 ON n1.k1 = 'n' || doc_id % 80 LEFT JOIN n2 ON n2.k2 = 's' || doc_id % 9""")
def imported_by_any_key(spark, sf_dir):
    d = F.col("doc_id")
    key = lambda letter, c: F.concat(F.lit(letter), c)
    rows = read(spark, sf_dir, "documents").select("doc_id", key("P", d).alias("a"), key(" n", d % 80).alias("b"), key("s", d % 9).alias("c"))
    found = read(spark, sf_dir, "labels").select("doc_id", key("p", d).alias("a"), key("n", d % 40).alias("b"), key("S", d % 7).alias("c"), (F.col("quality") * 2 + F.col("toxic")).alias("v"))
    return lookups.by_any_key(rows, "doc_id", ["a", "b", "c"], found, "doc_id", ["a", "b", "c"], "v")


@query("""WITH v AS (SELECT o_orderkey AS video, o_orderkey % 90 AS frames FROM orders WHERE o_orderkey % 90 > 0), b AS (SELECT video, frames, range(0, frames, 10) AS bases FROM v),
    f AS (SELECT video, frames, CASE WHEN len(bases) > 6 THEN list_transform(range(6), lambda i: bases[floor(i * (len(bases) / 6.0))::INT + 1]) ELSE bases END AS bases FROM b),
    s AS (SELECT video, frames, i - 1 AS burst, bases[i] AS base, unnest(range(-2, 3)) AS shot FROM (SELECT *, unnest(range(1, len(bases) + 1)) AS i FROM f)),
    t AS (SELECT video, base + shot * 5 AS frame, burst, shot FROM s WHERE base + shot * 5 >= 0 AND base + shot * 5 < frames)
    SELECT video, frame, burst, CASE WHEN shot = 0 THEN 'base' ELSE 'burst' END AS role FROM t QUALIFY row_number() OVER (PARTITION BY video, frame ORDER BY burst DESC, shot DESC) = 1""")
def burst_frames(spark, sf_dir):
    videos = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.col("o_orderkey") % 90).alias("frames"))
    return frames.burst_frames(videos, stride=10, step=5, radius=2, most=6)


@query("""WITH p AS (SELECT user_id, event_id, user_id % 3 = 0 AND event_id % 11 = 0 AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT *, min(event_id) FILTER (event_id % 11 = 0) OVER (PARTITION BY user_id) AS anchor FROM p),
    r AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN event_id = anchor THEN 1 WHEN i = n - 1 THEN 2 WHEN i = n // 2 THEN 3 ELSE 4 END AS r FROM f)
    SELECT user_id, event_id FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r, event_id) <= 5""")
def preview_frames(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id")
    anchors = events.where("event_id % 11 = 0").groupBy("user_id").agg(F.min("event_id").alias("anchor"))
    return frames.preview(events.join(anchors, "user_id", "left"), "user_id", "event_id", "anchor", 5).drop("anchor")


@query("""WITH v AS (SELECT o_orderkey AS video, (o_orderkey % 70)::DOUBLE AS s FROM orders), r AS (SELECT video, s, list_transform(range(0, greatest(ceil(s / 4.0), 1)::INT), lambda i: i * 4.0::DOUBLE) AS t FROM v),
    e AS (SELECT video, CASE WHEN s <= 0 THEN [0.0::DOUBLE] WHEN greatest(0, s - 0.001) - t[-1] >= 2 THEN list_append(t, greatest(0, s - 0.001)) ELSE t END AS t FROM r),
    p AS (SELECT video, CASE WHEN len(t) > 8 THEN list_transform(range(8), lambda i: t[round_even(i * (len(t) - 1) / 7.0, 0)::INT + 1]) ELSE t END AS t FROM e)
    SELECT video, i - 1 AS anchor, round(t[i], 6) AS seconds FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM p)""")
def anchor_times(spark, sf_dir):
    videos = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), (F.col("o_orderkey") % 70).cast("double").alias("seconds"))
    return frames.anchor_times(videos, 4.0, 8).withColumn("seconds", F.round("seconds", 6))


@query("""WITH t AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS tier FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY tier, user_id ORDER BY event_id) AS turn FROM t)
    SELECT event_id, user_id, tier, turn FROM n ORDER BY tier, turn, user_id LIMIT 700""")
def tiered_round_robin(spark, sf_dir):
    kind = F.col("event_type")
    tiers = [kind == "purchase", kind.isin("purchase", "view"), F.lit(True)]
    return frames.tiered_round_robin(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), tiers, "event_id", "user_id", ["event_id"], 700).drop("event_type")


@query("""SELECT DISTINCT number FROM (SELECT user_id AS number FROM events UNION ALL SELECT doc_id FROM labels) WHERE number BETWEEN 1 AND 99999""")
def used_numbers(spark, sf_dir):
    names = read(spark, sf_dir, "events").select(clean.auto_name(F.col("user_id")).alias("name")).union(read(spark, sf_dir, "labels").select(clean.auto_name(F.col("doc_id"))))
    number = clean.auto_number(F.col("name"))
    return names.select(number.cast("long").alias("number")).where("number > 0").distinct()


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'row' || doc_id END AS a, CASE doc_id % 3 WHEN 0 THEN 'Vids/' || doc_id || '/F.PNG' END AS p, source FROM documents)
    SELECT doc_id, coalesce(a, printf('row-%06d', doc_id)) AS row_id, CASE WHEN a IS NULL THEN NULL ELSE 'name' END AS came_from,
      coalesce(replace(lower(p), '/', chr(92)), CASE WHEN doc_id % 3 = 1 THEN source || '::frame::' || doc_id % 50 WHEN doc_id % 3 = 2 THEN source || '::time::' || doc_id % 9 || '.5' END, '') AS frame_key FROM d""")
def normalised_manifest(spark, sf_dir):
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        "doc_id", F.lit("  ").alias("id"), F.when(d % 5 != 0, F.concat(F.lit(" row"), d)).alias("name"), F.when(d % 3 == 0, F.concat(F.lit("Vids//"), d, F.lit("/F.PNG"))).alias("path"), "source",
        F.when(d % 3 == 1, d % 50).alias("index"), F.when(d % 3 == 2, d % 9 + 0.5).alias("seconds"),
    )
    found, came = clean.first_filled(rows, ["missing", "id", "name"])
    key = clean.frame_key(*map(F.col, ("path", "source", "index", "seconds")))
    return rows.select("doc_id", clean.row_id(found, d).alias("row_id"), came.alias("came_from"), key.alias("frame_key"))


@query("""WITH c AS (SELECT c_mktsegment AS name, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS n_negative FROM customer GROUP BY 1) SELECT name, n, n_negative FROM c UNION ALL SELECT 'all' AS name, sum(n)::BIGINT, sum(n_negative)::BIGINT FROM c""")
def groups_with_total(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    by = customers.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"))
    return by.unionByName(by.agg(F.lit("all").alias("name"), F.sum("n").alias("n"), F.sum("n_negative").alias("n_negative")))


@query("""WITH b AS (SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source) SELECT source, files, bytes, bytes > 20000 AS over_budget, row_number() OVER (ORDER BY bytes DESC, source) AS place FROM b""")
def folder_budgets(spark, sf_dir):
    by = profiles.inventory(read(spark, sf_dir, "documents"), ["source"], "n_chars").withColumn("over_budget", F.col("bytes") > 20_000)
    return numbered(by, [F.col("bytes").desc(), "source"], "place")


@query("""SELECT user_id, event_id, event_type FROM events WHERE event_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
    UNION ALL SELECT user_id, NULL, 'kept' FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 3 <> 0)""")
def upserted_state(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    base = events.select("user_id").distinct().select("user_id", F.lit(None).cast("long").alias("event_id"), F.lit("kept").alias("event_type"))
    changes = identity.latest(events.where("event_id % 3 <> 0"), "user_id", [F.col("event_id").desc()])
    return identity.upsert(base, changes, "user_id")
