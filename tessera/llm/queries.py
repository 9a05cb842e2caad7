"""The operators as queries over the driver's tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import fill_middle, host_rules, kmeans_tree, merkle, mixing, near_dup, packing, quality_rff, secret_scan, sharding, suffix_tree, token_counts, url_cascade

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 40
#: Rules of the URL filter, and names whose hosts are listed (alone and behind each prefix, under each domain).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
PREFIXES, DOMAINS = ("", "www.", "m.", "blog."), ("example.com", "example.net", "example.org")


def listed_hosts() -> list[str]:
    return [f"{prefix}{name}.{domain}" for name in LISTED_NAMES for prefix in PREFIXES for domain in DOMAINS]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(_table(spark, sf_dir, "pages"), RULES, listed_hosts())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(_table(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_documents(_table(spark, sf_dir, "documents"), width=2, percent=80)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(_table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), VOCABULARY)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.rearranged(_table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_url_filters, op3_lm_scoring, op4_nearest_neighbours, op5_mixing, op6_near_dedup, op7_host_rules, op8_secret_scans, op9_quality_classifier, op10_packing, op11_fill_in_middle, op12_merkle_manifest, op13_token_counts)
}


def _url_sql() -> str:
    fits = lambda rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)
    says = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in ordered)
    names = "|".join(LISTED_NAMES)
    return f"""
    WITH split AS (
      SELECT page_id,
        coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{url_cascade.UPPER}', '{url_cascade.LOWER}'), '') AS host,
        coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages)
    SELECT page_id, host, path, CASE {rule} END AS rule,
      CASE {says} WHEN regexp_full_match(host, '(www\\.|m\\.|blog\\.)?({names})\\.example\\.(com|net|org)') THEN 'block' ELSE 'allow' END AS verdict
    FROM split"""


def _merkle_sql() -> str:
    """Levels by one recursion, folding by another; n is the number of nodes of a tree in a level, and a tree's last node is its subroot."""
    field = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, (*merkle.COLUMNS[:-1], text)))})"
    grown = lambda name, tree, start: f"""
    {name}(tree, level, place, n, hash) AS (
      {start}
      UNION ALL
      SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(hash, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, level, place // 16, n)"""  # noqa: E731
    tampered = f"CASE WHEN crc % 5 = 0 THEN translate(text, '{merkle.UPPER}', '{merkle.LOWER}') ELSE text END"
    return f"""
    WITH RECURSIVE bits AS (
      SELECT doc_id, encode(doc_id::VARCHAR) AS b FROM documents WHERE doc_id IS NOT NULL),
    crcs AS ({_crc_sql()}),
    rows AS (
      SELECT d.doc_id, d.source, {leaf("text")} AS leaf, {leaf(tampered)} AS claimed FROM (SELECT d.*, crc FROM documents d LEFT JOIN crcs ON d.doc_id = crcs.doc_id) d),
    placed AS (
      SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM rows),
    {grown("own", "tree", "SELECT tree, 0, place, n, leaf FROM placed")},
    subroots AS (SELECT tree, hash AS subroot FROM own WHERE n = 1),
    {grown("over", "0", "SELECT -1::BIGINT, 0, tree, (SELECT count(*) FROM subroots), subroot FROM subroots")},
    root AS (SELECT hash AS root FROM over WHERE n = 1),
    nodes AS (SELECT * FROM own UNION ALL SELECT * FROM over),
    kids AS (SELECT tree, level, place // 16 AS up, list(hash ORDER BY place) AS hashes FROM nodes WHERE n > 1 GROUP BY tree, level, place // 16),
    climb(doc_id, leaf, source_tree, tree, level, place, n, fold, proof) AS (
      SELECT doc_id, leaf, tree, tree, 0, place, n, claimed, '' FROM placed
      UNION ALL
      SELECT c.doc_id, c.leaf, c.source_tree, CASE WHEN c.n > 1 THEN c.tree ELSE -1 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.place // 16 ELSE c.tree END,
        CASE WHEN c.n > 1 THEN (c.n + 15) // 16 ELSE (SELECT count(*) FROM subroots) END,
        CASE WHEN c.n > 1 THEN sha256(array_to_string(k.hashes[1:c.place % 16], '') || c.fold || array_to_string(k.hashes[c.place % 16 + 2:], '')) ELSE c.fold END,
        CASE WHEN c.n > 1 THEN c.proof || array_to_string(k.hashes[1:c.place % 16], '') || array_to_string(k.hashes[c.place % 16 + 2:], '') ELSE c.proof END
      FROM climb c LEFT JOIN kids k ON k.tree = c.tree AND k.level = c.level AND k.up = c.place // 16
      WHERE c.n > 1 OR c.tree >= 0)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
    FROM climb c JOIN subroots s ON s.tree = c.source_tree CROSS JOIN root WHERE c.tree = -1 AND c.n = 1"""


def _crc_sql() -> str:
    """crc32 of each doc_id's digits, bit by bit: DuckDB has no function for it."""
    return """
      SELECT doc_id, xor(crc, 4294967295) AS crc FROM (
        SELECT doc_id, list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
          lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
        FROM bits)"""


WORDS_SQL = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": _url_sql(),
    "op6_near_dedup": rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, {WORDS_SQL.replace("text,", f"translate(coalesce(text, ''), '{url_cascade.UPPER}', '{url_cascade.LOWER}'),")} AS w FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (
      SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
    sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(doc_id, other) AS (
      SELECT doc_id, doc_id FROM documents
      UNION
      SELECT reach.doc_id, sides.y FROM reach JOIN sides ON reach.other = sides.x)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id""",
    "op7_host_rules": rf"""
    WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS_SQL.replace("text", "coalesce(text, '')")} AS w FROM documents),
    grams AS (
      SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
    often AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    li AS (
      SELECT doc_id, count(*) - count(DISTINCT l) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    c AS (
      SELECT t.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(li.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN li USING (doc_id)),
    b AS (SELECT *, n_words < {host_rules.LEAST_WORDS} OR 100 * n_repeat_words > {host_rules.MOST_REPEATED} * n_words AS base_failed FROM c),
    s AS (
      SELECT *, (n_symbols * {host_rules.WORDS_PER_SYMBOL} > n_words)::INT + (n_dup_lines * {host_rules.WORDS_PER_LINE} > n_words)::INT + (100 * n_repeat_words > {host_rules.SOFT_REPEATED} * n_words)::INT
        + (word_chars < n_words * {host_rules.SHORTEST} OR word_chars > n_words * {host_rules.LONGEST})::INT AS soft FROM b),
    h AS (SELECT source, sum((base_failed OR soft > 0)::INT)::DOUBLE AS f, count(*) AS n FROM s WHERE source IS NOT NULL GROUP BY source),
    m AS (SELECT coalesce(avg(f / n), 0) AS mean, var_samp(f / n) AS v, avg(1 / n) AS part FROM h),
    t2 AS (SELECT *, CASE WHEN part < 1 THEN (v - mean * (1 - mean) * part) / (1 - part) END AS between_hosts FROM m),
    p AS (
      SELECT mean, CASE WHEN v IS NULL OR between_hosts IS NULL THEN {host_rules.PRIOR_DEFAULT} WHEN between_hosts <= 0 THEN {host_rules.PRIOR_MOST}
        ELSE greatest({host_rules.PRIOR_LEAST}, least({host_rules.PRIOR_MOST}, mean * (1 - mean) / between_hosts - 1)) END AS weight FROM t2),
    r AS (SELECT source, mean, n + weight AS total, (f + mean * weight) / (n + weight) AS rate FROM h, p),
    verdicts AS (
      SELECT source, CASE WHEN rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > greatest({host_rules.HOST_RATE}, {host_rules.HOST_ODDS} * mean / (1 + {host_rules.HOST_ODDS - 1} * mean)) THEN 0
        WHEN rate - {host_rules.SURE} * sqrt(rate * (1 - rate) / (total + 1)) > mean + {host_rules.SAME} THEN {host_rules.SOFT_STRICT} ELSE {host_rules.SOFT_MOST} END AS allowed FROM r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND soft < coalesce(allowed, {host_rules.SOFT_MOST}) AS kept
    FROM s LEFT JOIN verdicts USING (source)""",
    "op11_fill_in_middle": f"""
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS g FROM documents),
    h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(g, k, 8))::BIGINT) AS h FROM t),
    c AS (
      SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {fill_middle.RATE} THEN 'plain' WHEN h[4] % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:], '') AS suffix FROM c),
    o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
    r AS (
      SELECT *, string_split(substr(output, 4), CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) AS x FROM o),
    b AS (SELECT *, string_split(x[2], '<M>') AS y FROM r)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
      sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[1] || y[2] || y[1] ELSE y[1] || y[2] || x[1] END) AS restored_sha256
    FROM b""",
    "op12_merkle_manifest": _merkle_sql(),
}
