"""A Merkle manifest of a dataset: a tree of hashes per source and one over the sources, with proofs climbed by a recursive query.

Rows are leaves, numbered per source by doc_id. Every ARITY consecutive nodes of a level become one node, whose row links to its parent
and holds its children's hashes, so a tree takes as many groupings as it has levels, each a staged table. A recursive query climbs from
the leaves to the root: in each step a row meets the node it stands under, hashes are folded with their siblings, and the siblings are
appended to the proof.

The leaves of a run have all siblings above the run in common. So a row of the climb carries the leaves of a run: a folded hash for each
leaf, and what their proofs share once, as bytes. Near the root many rows meet one node: nodes above more than one row in a thousand are
a thousand a level at most, whatever the input, and are broadcast; the others are met by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import HEAVY_SHARE, join_spread, stage
from tessera.operators.numbering import numbered

ARITY = 16
#: A row counts as tampered where this number divides the crc32 of its doc_id.
TAMPERED = 5
#: The columns of a leaf, what stands for null, and the case that tampering changes.
COLUMNS, NULL = ("doc_id", "source", "lang", "n_chars", "text"), "-"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The tree over the sources; those of the sources are numbered from 0.
OVER = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
NODE = "id string, parent string, place int, kids binary, weight long"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of a row: of each value the count of its bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit(NULL)) for t in texts)))


@dataclass
class Manifest:
    """runs: leaves under one parent (id, tree, parent, place, alone, leaves: [at, doc_id, leaf, claimed]); nodes: the levels above, each
    with its parent's id, its place there and its children's hashes as bytes; subroots: a row per source; the hash of all."""

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: str | None


def _placed(leaves: DataFrame) -> DataFrame:
    """leaves with tree (place of their source, the null source first), at (place in the source, by doc_id) and n (leaves of the source)."""
    known = F.col("source").isNotNull()
    placed = numbered(leaves, [known, "source", "doc_id", "leaf", "claimed"], "number").withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    sources = stage(placed.groupBy("key", "source").agg(F.min("number").alias("first"), F.count("*").alias("n")), "merkle-sources")
    trees = numbered(sources, [known, "source"], "tree").select("key", F.col("tree") - 1, "first", "n", F.col("n").alias("rows"))
    table = stage(trees.toDF("key", "tree", "first", "n", "rows"), "merkle-trees")
    return join_spread(placed, table, ["key"], "rows", ["number"]).withColumn("at", F.col("number") - F.col("first"))


def _joined(members: Column, name: str) -> Column:
    return F.array_join(F.transform(members, lambda x: x[name]), "")


def _levels(level: DataFrame, arity: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels above a staged one (tree, at, n: nodes of the tree in this level, hash, weight: runs below), and the last node of each tree."""
    above, last = [], [level.where("n = 1")]
    while (level.agg(F.max("n")).first()[0] or 1) > 1:
        depth = len(above) + 1
        members = F.sort_array(F.collect_list(F.struct("at", "hash")))  # arity at most
        grown = level.where("n > 1").groupBy("tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n")).agg(members.alias("members"), F.sum("weight").alias("weight"))
        hashed = grown.select("tree", "at", "n", F.lit(depth).alias("level"), F.unhex(_joined(F.col("members"), "hash")).alias("kids"), digest(_joined(F.col("members"), "hash")).alias("hash"), "weight")
        level = stage(hashed, f"{name}-{depth}")
        above.append(level)
        last.append(level.where("n = 1"))
    return above, reduce(DataFrame.unionByName, (x.select("tree", "hash", "weight") for x in last))


def _id(tree: Column, level: Column, at: Column) -> Column:
    return F.concat_ws("/", *(c.cast("string") for c in (tree, level, at)))


def _link(level: Column, arity: int, sources: int) -> list[Column]:
    """Parent and place under it. A tree's last node stands in the tree over the sources, if there is one; that tree's last node is the root."""
    tree, at, n = F.col("tree"), F.col("at"), F.col("n")
    over = (tree != OVER) & F.lit(sources > 1)
    parent = F.when(n > 1, _id(tree, level + 1, F.expr(f"at div {arity}"))).when(over, _id(F.lit(OVER), F.lit(1), F.expr(f"tree div {arity}")))
    place = F.when(n > 1, F.pmod(at, F.lit(arity))).when(over, F.pmod(tree, F.lit(arity)))
    return [parent.alias("parent"), place.cast("int").alias("place")]


def build(leaves: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of leaves (doc_id, source, leaf; claimed: the hash that the proof of a leaf starts from).

    Leaves of a source ascend by doc_id, null first, and equal doc_ids by their hash: repeated rows are leaves of their own, and the
    manifest doesn't depend on the order of rows. Null is a source of its own, the first. Without leaves there is no root.
    """
    spark = leaves.sparkSession
    members = F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "claimed")))  # arity at most
    runs = _placed(leaves.select("doc_id", "source", "leaf", "claimed")).groupBy("tree", F.expr(f"at div {arity}").alias("run"), "n").agg(F.first("source").alias("source"), members.alias("leaves"))
    alone = F.col("n") == 1  # such a leaf is a subroot itself
    hashed = runs.select("tree", "source", F.col("run").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), alone.alias("alone"), F.lit(1).cast("long").alias("weight"), "leaves", F.when(alone, F.col("leaves")[0]["leaf"]).otherwise(digest(_joined(F.col("leaves"), "leaf"))).alias("hash"))
    low = stage(hashed, "merkle-runs")
    own, tops = _levels(low.select("tree", "at", "n", "hash", "weight"), arity, "merkle-own")
    subroots = stage(tops.join(low.where("at = 0").select("tree", "source"), "tree").select("tree", "source", F.col("hash").alias("subroot"), F.col("weight").alias("runs")), "merkle-subroots")
    sources = subroots.count()
    over, summit = _levels(subroots.select(F.lit(OVER).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(sources).cast("long").alias("n"), F.col("subroot").alias("hash"), F.col("runs").alias("weight")), arity, "merkle-over")
    root = summit.first()  # the only row
    linked = [x.select(_id(F.col("tree"), F.col("level"), F.col("at")).alias("id"), *_link(F.col("level"), arity, sources), "kids", "weight") for x in (*own, *over)]
    nodes = reduce(DataFrame.unionByName, linked, spark.createDataFrame([], NODE))
    anchors = low.select(_id(F.col("tree"), F.lit(0), F.col("at")).alias("id"), "tree", *_link(F.lit(0), arity, sources), "alone", "leaves")
    return Manifest(anchors, nodes, subroots, root and root["hash"])


@contextmanager
def _without_row_limit(spark: SparkSession) -> Iterator[None]:
    """Recursive queries stop at a number of rows by default; the climb ends at the root by itself."""
    before = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ROW_LIMIT)
        else:
            spark.conf.set(ROW_LIMIT, before)


CLIMB = """
WITH RECURSIVE climb (id, parent, place, folded, shared) AS (
  SELECT id, parent, place, folded, CAST('' AS BINARY) FROM {anchors}
  UNION ALL
  SELECT id, parent, place, transform(folded, f -> sha2(concat(lower(hex(before)), f, lower(hex(behind))), 256)), concat(shared, before, behind)
  FROM (
    SELECT id, parent, place, folded, shared, substring(kids, 1, 32 * was) AS before, substring(kids, 32 * was + 33) AS behind
    FROM (
      SELECT /*+ BROADCAST(h) */ c.id, c.place AS was, c.folded, c.shared, if(h.id IS NULL, n.parent, h.parent) AS parent, if(h.id IS NULL, n.place, h.place) AS place, coalesce(h.kids, n.kids) AS kids
      FROM climb c LEFT JOIN {heavy} h ON c.parent = h.id LEFT JOIN {light} n ON if(h.id IS NULL, c.parent, concat('of ', c.id)) = n.id
      WHERE c.parent IS NOT NULL)))
SELECT id, folded, shared FROM climb WHERE parent IS NULL
"""


def _others(leaves: str, i: Column) -> tuple[Column, Column]:
    """Hashes of the leaves before and behind the i-th of a run."""
    hashes = F.transform(leaves, lambda x: x["leaf"])
    return F.array_join(F.slice(hashes, F.lit(1), i), ""), F.array_join(F.slice(hashes, i + 2, F.greatest(F.size(leaves) - i - 1, F.lit(0))), "")


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every leaf: its claimed hash folded with its siblings up to the root."""
    spark, runs = manifest.runs.sparkSession, manifest.runs
    fold = lambda x, i: F.when(F.col("alone"), x["claimed"]).otherwise(digest(F.concat(_others("leaves", i)[0], x["claimed"], _others("leaves", i)[1])))
    anchors = runs.select("id", "parent", "place", F.transform("leaves", fold).alias("folded"))
    heavy = F.col("weight") * HEAVY_SHARE > runs.count()
    with _without_row_limit(spark):
        climbed = spark.sql(CLIMB, anchors=anchors, heavy=manifest.nodes.where(heavy), light=manifest.nodes.where(~heavy))
        ends = stage(climbed, "merkle-climb")
    known = join_spread(runs.select("id", "tree", "leaves"), manifest.subroots.select("tree", "subroot", "runs"), ["tree"], "runs", ["id"])
    each = known.join(ends, "id").select("subroot", "folded", "leaves", "shared", F.posexplode("leaves").alias("i", "own"))
    proof = digest(F.concat(*_others("leaves", F.col("i")), F.lower(F.hex("shared"))))
    out = each.select(F.col("own.doc_id").alias("doc_id"), F.col("own.leaf").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), proof.alias("proof_sha256"), F.get("folded", F.col("i")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """Text whose capitals became small where TAMPERED divides the crc32 of doc_id; else the text itself. Null doc_ids aren't tampered with."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def verify_documents(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Hashes, proof and verdict for every row of docs (doc_id, source, lang, n_chars, text) after some texts were tampered with.

    Nulls in any column hash as such; repeated rows are leaves each, equal doc_ids of a source stand in the order of their hashes; an empty
    table gives an empty result; other columns are not read. A tampered row without capitals verifies, as its bytes are the same.
    """
    first = [F.col(c) for c in COLUMNS[:-1]]
    leaves = docs.select("doc_id", "source", leaf_hash(*first, F.col("text")).alias("leaf"), leaf_hash(*first, tampered_text()).alias("claimed"))
    return proofs(build(leaves, arity))
