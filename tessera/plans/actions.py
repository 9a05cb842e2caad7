"""Identity actions, labels in nested JSON and the audit of samples, over rows made of the tables' columns; the SQL works the results out by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.operators import audit, history, identity
from tessera.plans.catalog import CLUSTER, COSINES, vectors
from tessera.plans.registry import query, read
from tessera.plans.rules import as_sql, derived, pick

TYPE, AMOUNT, USER = "event_type", "CAST(value AS VARCHAR(20))", "CAST(user_id AS VARCHAR(20))"
RECORDS = {"id": "event_id", "record": pick(
    "event_id", f"'{{\"prediction\": {{\"label\": \" ' || {TYPE} || ' \", \"score\": ' || {AMOUNT} || '}}}}'", f"'{{\"prediction\": {{\"label\": \"\", \"class\": \"' || {TYPE} || '\", \"prob\": \"' || {AMOUNT} || '\"}}}}'",
    f"'{{\"prediction\": {{\"predictions\": [{{\"name\": \"' || {TYPE} || '\", \"p\": ' || {AMOUNT} || '}}, {{\"name\": \"other\", \"p\": ' || {USER} || '}}, \"d\"]}}}}'",
    f"'{{\"prediction\": {{\"classes\": [], \"top\": {{\"taxon\": \"' || {TYPE} || '\", \"confidence\": ' || {AMOUNT} || '}}}}}}'", f"'{{\"prediction\": [\"x\", {{\"label\": \"' || {TYPE} || '\", \"score\": ' || {AMOUNT} || '}}, \"w\"]}}'",
    f"'{{\"prediction\": \"' || {TYPE} || '\", \"classifications\": [{{\"label\": \"late\"}}]}}'", f"'{{\"prediction\": {{\"other\": 1}}, \"classifications\": [{{\"label\": \"' || {TYPE} || '\", \"score\": \"soon\"}}]}}'", "'{}'", TYPE, "NULL")}


@query(f"""WITH {as_sql('events', RECORDS)}, j AS (SELECT id, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM x), c AS (SELECT id, j, json_type(j, '$.prediction') AS kind FROM j),
    l AS (SELECT id, unnest([{{'place': 1, 'items': CASE WHEN kind <> 'ARRAY' THEN [json_extract(j, '$.prediction')] END}}, {{'place': 2, 'items': json_extract(j, '$.prediction.predictions[*]')}},
      {{'place': 3, 'items': CASE WHEN json_type(j, '$.prediction.top') = 'OBJECT' THEN [json_extract(j, '$.prediction.top')] END}}, {{'place': 4, 'items': CASE WHEN kind = 'ARRAY' THEN json_extract(j, '$.prediction[*]') END}},
      {{'place': 5, 'items': json_extract(j, '$.classifications[*]')}}]) AS l FROM c),
    i AS (SELECT id, l.place AS place, unnest(l['items']) AS item, generate_subscripts(l['items'], 1) AS n FROM l),
    e AS (SELECT id, place, n, trim(CASE WHEN json_type(item) = 'OBJECT' THEN coalesce(nullif(item->>'$.label', ''), nullif(item->>'$.class', ''), nullif(item->>'$.name', ''), nullif(item->>'$.taxon', '')) ELSE item->>'$' END) AS label,
      CASE WHEN json_type(item) = 'OBJECT' THEN try_cast(coalesce(item->>'$.confidence', item->>'$.score', item->>'$.prob', item->>'$.p') AS DOUBLE) END AS score FROM i),
    b AS (SELECT id, place, first(label || '|' || coalesce(score::VARCHAR, 'none') ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN -n ELSE n END) AS best FROM e WHERE label <> '' GROUP BY id, place),
    f AS (SELECT id, arg_min(best, place) AS found FROM b GROUP BY id) SELECT id, coalesce(found, '|none') AS found FROM x LEFT JOIN f USING (id)""")
def nested_labels(spark, sf_dir):
    found = derived(spark, sf_dir, "events", RECORDS).withColumn("found", nested.nested_label(F.col("record"), ("prediction", "classifications")))
    return found.select("id", F.concat_ws("|", "found.label", F.coalesce(F.col("found.score").cast("string"), F.lit("none"))).alias("found"))


POINTED = {"id": "event_id", "record": pick(
    "event_id", f"'{{\"tip_x\": ' || {AMOUNT} || '}}'", f"'{{\"bill_tip_x\": \"' || {USER} || '\", \"tip_x\": 4}}'", f"'{{\"bill_tip_x\": -1' || {USER} || ', \"tip_x\": ' || {AMOUNT} || '}}'",
    f"'{{\"bill_tip_x\": \"\", \"bill_tip\": {{\"x\": ' || {USER} || ', \"y\": 3}}}}'", f"'{{\"bill_tip\": {{}}, \"tip\": {{\"x\": -' || {AMOUNT} || '}}}}'", f"'{{\"bill_tip\": ' || CAST(user_id % 3 AS VARCHAR(20)) || ', \"tip\": {{\"x\": 5}}}}'",
    "'{\"bill_tip\": {\"y\": 5}}'", TYPE, "NULL")}


@query(f"""WITH {as_sql('events', POINTED)}, j AS (SELECT id, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM x),
    v AS (SELECT id, try_cast(j->>'$.bill_tip_x' AS DOUBLE) AS a, try_cast(j->>'$.tip_x' AS DOUBLE) AS b, coalesce(CASE WHEN j->>'$.bill_tip' NOT IN ('', '{{}}', '[]', '0', '0.0', 'false') THEN j->>'$.bill_tip' END, CASE WHEN j->>'$.tip' NOT IN ('', '{{}}', '[]', '0', '0.0', 'false') THEN j->>'$.tip' END) AS t FROM j)
    SELECT id, coalesce(CASE WHEN a >= 0 THEN a END, CASE WHEN b >= 0 THEN b END, CASE WHEN starts_with(t, '{{') THEN try_cast(t::JSON->>'$.x' AS DOUBLE) END, -1.0) AS x FROM v""")
def nested_points(spark, sf_dir):
    x = nested.flexible_coordinate(F.col("record"), ("bill_tip_x", "tip_x"), ("bill_tip", "tip"), "x")
    return derived(spark, sf_dir, "events", POINTED).select("id", x.alias("x"))


def _crops(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    number = F.format_string("Bird%05d", F.col("user_id") % 50 + 1)
    name = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(number)
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("crop-"), F.col("event_id").cast("string")).alias("crop_path"), name.alias("identity"), F.lit("active").alias("identity_status"), F.lit("reviewed").alias("review_status"), F.when(F.col("event_id") % 2 == 0, "earlier").alias("reviewed_at"))


CROPS = """WITH c AS (SELECT event_id AS id, 'crop-' || event_id AS crop_path, CASE WHEN event_type = 'error' THEN ' ' ELSE printf('Bird%05d', user_id % 50 + 1) END AS identity, CASE WHEN event_id % 2 = 0 THEN 'earlier' END AS reviewed_at FROM events)"""


@query(f"""{CROPS} SELECT 'now' AS at, id AS crop_id, crop_path, identity AS old_identity, 'Bird00007' AS new_identity, 'merge_identity' AS action FROM c WHERE identity = 'Bird00003'""")
def merge_history(spark, sf_dir):
    return history.merged(_crops(spark, sf_dir), "Bird00003", "Bird00007", "now").history


@query(f"""{CROPS} SELECT 'now' AS at, 'name_identity_profile' AS action, 'Bird00003' AS source, 'Ruby' AS target, count(*) AS crops FROM c WHERE identity = 'Bird00003' HAVING count(*) > 0""")
def rename_action(spark, sf_dir):
    return history.renamed(_crops(spark, sf_dir), "Bird00003", " Ruby ", "now").action


@query(f"""{CROPS}, f AS (SELECT n, row_number() OVER (ORDER BY n) AS place FROM range(1, 100000) t(n) WHERE printf('Bird%05d', n) NOT IN (SELECT identity FROM c)),
    w AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM c WHERE trim(identity) = ''), g AS (SELECT id, printf('Bird%05d', n) AS given FROM w JOIN f USING (place))
    SELECT id, coalesce(given, identity) AS identity, CASE WHEN given IS NULL THEN 'active' ELSE 'provisional' END AS identity_status, CASE WHEN given IS NULL THEN 'reviewed' ELSE 'auto' END AS review_status,
      CASE WHEN given IS NULL THEN reviewed_at ELSE coalesce(reviewed_at, 'now') END AS reviewed_at FROM c LEFT JOIN g USING (id)""")
def autonamed_rows(spark, sf_dir):
    return history.autonamed(_crops(spark, sf_dir), "now", partly=True).drop("crop_path")


OLDER = {"id": "event_id", "individual_name": pick("event_id", "'Ann'", "' '", TYPE, "NULL", "'ann'"), "name": pick("user_id", "'x'", "' Ann '", "'Ann'", "NULL", "''"), "identity_status": pick("event_id", "'active'", "'false_positive'", "NULL"),
    "training_label": pick("user_id", "''", "'leaf'", "NULL"), "cleanup_notes": pick("event_id", "NULL", "''", "'old'", TYPE), "reviewed_at": pick("event_id + user_id", "NULL", "'then'")}
STATES = [c for c in OLDER if c != "id"]


@query(f"""WITH {as_sql('events', OLDER)}, h AS (SELECT *, trim(coalesce(name, '')) = 'Ann' OR trim(coalesce(individual_name, '')) = 'Ann' AS hit FROM x)
    SELECT id, CASE WHEN hit THEN 'Bea|Bea|active||' || trim(coalesce(cleanup_notes, '') || ' [now] moved') || '|' || coalesce(reviewed_at, 'now')
      ELSE {" || '|' || ".join(f"coalesce({c}, '')" for c in STATES)} END AS state FROM h""")
def older_updates(spark, sf_dir):
    new = history.updated(derived(spark, sf_dir, "events", OLDER), "Ann", "now", name="Bea", status="active", label="", note="moved")
    return new.select("id", F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in STATES)).alias("state"))


@query(f"WITH {as_sql('events', OLDER)} SELECT id FROM x WHERE coalesce(identity_status, '') = 'false_positive' OR coalesce(training_label, '') <> ''")
def training_rejects(spark, sf_dir):
    return history.rejected_for_training(derived(spark, sf_dir, "events", OLDER)).select("id")


TEXT = "CAST({} AS VARCHAR(20))".format
#: An order stands for a sequence and its lines for frames, with faults of every kind.
SEQUENCES = {"row": "o_orderkey", "sequence_id": f"CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE {TEXT('o_orderkey - CASE WHEN o_orderkey % 89 = 0 THEN 1 ELSE 0 END')} END", "start_frame_index": f"CASE WHEN o_orderkey % 83 = 0 THEN 'x' ELSE {TEXT('o_orderkey % 50')} END", "end_frame_index": TEXT("o_orderkey % 50 + o_custkey % 7 - 1"),
    "anchor_frame_index": TEXT("o_orderkey % 50 + o_custkey % 5"), "sequence_frames_planned": TEXT("o_custkey % 6"), "sequence_frame_count_expected": TEXT("o_custkey % 6 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END"),
    "sequence_frames_selected_for_extraction": "'2'", "sequence_frames_written": f"CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE {TEXT('o_orderkey % 4')} END"}
FRAME = "l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 13 + l_linenumber"
FRAMES = {"row": FRAME, "frame_id": f"CASE WHEN l_partkey % 101 = 0 THEN '' WHEN l_partkey % 67 = 0 THEN 'f' || {TEXT('l_orderkey')} ELSE {TEXT(FRAME)} END", "sequence_id": f"CASE WHEN l_suppkey % 53 = 0 THEN 'zz' ELSE {TEXT('l_orderkey')} END", "source_frame_index": f"CASE WHEN l_partkey % 61 = 0 THEN '' ELSE {TEXT('l_orderkey % 50 + l_linenumber % 5')} END",
    "anchor_frame_index": TEXT("l_orderkey % 50 + 2"), "offset_from_anchor_frames": TEXT("l_linenumber % 5 - 2 + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END"), "frame_selected_for_extraction": pick("l_partkey", "'true'", "'no'", "'yes'", "NULL"),
    "frame_materialization_status": pick("l_suppkey", "'written_debug_cache'", "'planned'"), "output_frame_path": pick("l_suppkey", "' '", "'p'", "'q'")}
EXTRACTED = {"row": FRAME, "frame_id": f"CASE WHEN l_suppkey % 29 = 0 THEN '' WHEN l_suppkey % 31 = 0 THEN 'other' || {TEXT('l_partkey')} ELSE {TEXT(FRAME)} END"}


def _codes(table: str, who: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{'warning' if code in audit.WARNINGS else 'error'}' AS level, '{code}' AS code, {who} AS id FROM {table} WHERE {rule}" for code, rule in rules.items())


@query(f"""WITH {as_sql('orders', SEQUENCES).replace('x AS', 'so AS')}, {as_sql('lineitem', FRAMES).replace('x AS', 'fo AS')}, {as_sql('lineitem', EXTRACTED).replace('x AS', 'xo AS')},
    s AS (SELECT trim(sequence_id) AS sid, row, try_cast(start_frame_index AS BIGINT) AS low, try_cast(end_frame_index AS BIGINT) AS high, try_cast(anchor_frame_index AS BIGINT) AS anchor, try_cast(sequence_frames_planned AS BIGINT) AS planned, try_cast(sequence_frame_count_expected AS BIGINT) AS expected,
      coalesce(try_cast(nullif(sequence_frames_written, '') AS BIGINT), 0) AS written, CASE WHEN trim(sequence_id) = '' THEN 'row ' || row ELSE trim(sequence_id) END AS who FROM so),
    last AS (SELECT * FROM s WHERE sid <> '' QUALIFY row_number() OVER (PARTITION BY sid ORDER BY row DESC) = 1),
    f AS (SELECT fo.row, frame_id AS fid, fo.sequence_id AS sid, try_cast(nullif(source_frame_index, '') AS BIGINT) AS spot, try_cast(anchor_frame_index AS BIGINT) AS anchor, try_cast(offset_from_anchor_frames AS BIGINT) AS off, coalesce(frame_selected_for_extraction IN ('true', 'yes'), CASE WHEN frame_selected_for_extraction IS NULL THEN NULL ELSE FALSE END) AS chosen,
      frame_materialization_status = 'written_debug_cache' AS cached, trim(output_frame_path) AS path, CASE WHEN frame_id = '' THEN 'row ' || fo.row ELSE frame_id END AS who, last.sid IS NOT NULL AS linked, last.low, last.high FROM fo LEFT JOIN last ON last.sid = fo.sequence_id),
    n AS (SELECT sid, count(*) AS seen FROM f WHERE fid <> '' AND linked GROUP BY sid), m AS (SELECT last.*, coalesce(seen, 0) AS seen FROM last LEFT JOIN n USING (sid)),
    g AS (SELECT *, spot IS NOT NULL AND anchor IS NOT NULL AND off IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL AS fine FROM f),
    d AS (SELECT sid AS id, 'duplicate_sequence_id' AS code FROM s WHERE sid <> '' QUALIFY row_number() OVER (PARTITION BY sid) > 1 UNION ALL SELECT fid, 'duplicate_frame_id' FROM f WHERE fid <> '' QUALIFY row_number() OVER (PARTITION BY fid) > 1
      UNION ALL SELECT frame_id, 'duplicate_extracted_frame_id' FROM xo WHERE frame_id <> '' QUALIFY row_number() OVER (PARTITION BY frame_id) > 1)
    {_codes("s", "who", {"blank_sequence_id": "sid = ''", "sequence_numeric_parse_failed": "sid <> '' AND low IS NULL", "sequence_start_after_end": "sid <> '' AND low > high", "anchor_outside_sequence": "sid <> '' AND low IS NOT NULL AND anchor NOT BETWEEN low AND high", "planned_expected_mismatch": "sid <> '' AND low IS NOT NULL AND planned <> expected", "sequence_written_exceeds_selected": "sid <> '' AND low IS NOT NULL AND written > 2"})}
    UNION ALL {_codes("g", "who", {"blank_frame_id": "fid = ''", "frame_missing_sequence": "fid <> '' AND NOT linked", "frame_numeric_parse_failed": "fid <> '' AND linked AND NOT fine", "frame_outside_sequence": "fid <> '' AND linked AND fine AND spot NOT BETWEEN low AND high", "offset_mismatch": "fid <> '' AND linked AND fine AND spot - anchor <> off", "written_frame_missing_output_path": "fid <> '' AND linked AND fine AND chosen AND cached AND path = ''", "unselected_frame_written": "fid <> '' AND linked AND fine AND NOT chosen AND cached"})}
    UNION ALL {_codes("m", "sid", {"sequence_frame_count_mismatch": "planned <> seen"})} UNION ALL SELECT 'error', code, id FROM d
    UNION ALL SELECT 'error', 'blank_extracted_frame_id', 'row ' || row FROM xo WHERE frame_id = '' UNION ALL SELECT 'error', 'extracted_frame_not_in_sampled_frames', frame_id FROM xo WHERE frame_id <> '' AND frame_id NOT IN (SELECT fid FROM f)""")
def sampling_audit(spark, sf_dir):
    return audit.sampling_issues(derived(spark, sf_dir, "orders", SEQUENCES), derived(spark, sf_dir, "lineitem", FRAMES), derived(spark, sf_dir, "lineitem", EXTRACTED))


@query(f"""{COSINES.replace("WITH e", "WITH RECURSIVE e")}, k AS (SELECT id FROM e WHERE id % 10 <> 9 AND NOT (id < 100 AND id % 10 = 8)), s AS (SELECT id, printf('Bird%05d', label * 2 + 1) AS identity FROM e WHERE id < 100),
    r AS (SELECT a, b, cosine FROM p WHERE b < a AND a >= 100 AND a IN (FROM k) AND b IN (FROM k) QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) = 1),
    walk(id, spot) AS (SELECT id, id FROM k WHERE id >= 100 UNION SELECT walk.id, r.b FROM walk JOIN r ON r.a = walk.spot AND r.cosine >= {CLUSTER}), roots AS (SELECT id, min(spot) AS root FROM walk GROUP BY id),
    f AS (SELECT n, row_number() OVER (ORDER BY n) AS place FROM range(1, 100000) t(n) WHERE printf('Bird%05d', n) NOT IN (SELECT identity FROM s)),
    w AS (SELECT root, row_number() OVER (ORDER BY root) AS place FROM roots WHERE root >= 100 AND id = root), g AS (SELECT root, printf('Bird%05d', n) AS identity FROM w JOIN f USING (place) UNION ALL SELECT id, identity FROM s)
    SELECT roots.id, identity, CASE WHEN cosine >= {CLUSTER} THEN 'match' ELSE 'new' END AS decision, cosine AS score, CASE WHEN cosine >= {CLUSTER} THEN b END AS match FROM roots JOIN g USING (root) LEFT JOIN r ON r.a = roots.id""")
def stored_identity(spark, sf_dir):
    """The first hundred vectors are the store; a tenth of all has another version, a tenth of the store is junk."""
    v, stored = vectors(spark, sf_dir), F.col("id") < 100
    rows = v.select("id", "vec", F.when(stored, F.format_string("Bird%05d", F.col("name") * 2 + 1)).alias("identity"), F.when(F.col("id") % 10 == 9, "v0").otherwise("v1").alias("version"), F.when(stored & (F.col("id") % 10 == 8), "junk").alias("status"))
    return identity.assign_against_store(rows, CLUSTER, "v1")
