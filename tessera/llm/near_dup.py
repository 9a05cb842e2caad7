"""Near duplicates by fast similarity sketches, banding and exact verification on full shingle sets.

A sketch has BINS coordinates. In round r every shingle is hashed to a bin and a value above all values of earlier
rounds, and a bin keeps its least value; from round BINS on, round r fills bin r - BINS alone. So every coordinate is filled
after 2 * BINS rounds at the latest, two sets agree in a coordinate with probability equal to their similarity, and the
number of agreeing coordinates concentrates as for independent samples. A text of n shingles costs about
n + BINS log BINS steps instead of n * BINS.

Texts with equal sets are one class. Classes that share a band are candidates. They are verified in two steps, so that a
group of thousands of near copies costs no more than a few links each: first every class against the centers of its buckets,
which one hash of classes chooses, so that the buckets of a group mostly have the same few; then, inside buckets, only
classes that are not yet connected and whose sizes allow it, against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import texts
from tessera.llm.components import connected_components
from tessera.llm.shared import free_names, join_spread, stage

#: Two sets at similarity 0.8 miss each other in all bands with a chance of (1 - 0.8^BAND_ROWS)^BANDS, about 8e-6; at 0.85 it is 1e-9.
BANDS, BAND_ROWS = 64, 8
BINS = BANDS * BAND_ROWS
#: Classes, and about how many shingles, of a block that is compared in one task.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Buckets with more unconnected groups are compared in blocks as a whole, not group by group.
CROWD = 32
U = np.uint64
_VALUE_BITS = U(48)
_EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketches(row: np.ndarray, key: np.ndarray, rows: int) -> np.ndarray:
    """rows x BINS coordinates of the sets given as (row, key), sorted by row; a row without keys keeps _EMPTY."""
    out = np.full(rows * BINS, _EMPTY, dtype=U)
    salts = texts.numbers(77, 2 * BINS)
    row = row.astype(np.int64)
    for turn in range(2 * BINS):
        if not len(key):
            break
        x = texts.mix(key ^ salts[turn])
        value = (U(turn) << _VALUE_BITS) | (x >> (U(64) - _VALUE_BITS))
        spot = ((x & U(0xFFFF)) * U(BINS) >> U(16)).astype(np.int64) if turn < BINS else turn - BINS
        np.minimum.at(out, row * BINS + spot, value)
        waiting = (out.reshape(rows, BINS) == _EMPTY).any(axis=1)[row]
        row, key = row[waiting], key[waiting]
    return out.reshape(rows, BINS)


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """rows x BANDS keys; the band's place is part of the key."""
    state = np.broadcast_to(np.arange(BANDS, dtype=U), (len(sketch), BANDS))
    for k in range(BAND_ROWS):
        state = texts.chain(state, sketch[:, k::BAND_ROWS])
    return state


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, flat = [], [], [], []
        for block in texts.blocks(batch.column(1)):
            row, key = texts.shingles(texts.words(block), width, block.rows)
            count = np.bincount(row, minlength=block.rows)
            upto = np.concatenate([[0], np.cumsum(count)])
            sums = []
            for salt in texts.numbers(5, 2):
                total = np.concatenate([np.zeros(1, dtype=U), np.cumsum(texts.mix(key ^ salt))])
                sums.append(total[upto[1:]] - total[upto[:-1]])
            n.append(count.astype(np.int64)), one.append(sums[0]), two.append(sums[1])
            flat.append(bands_of(sketches(row, key, block.rows)))
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
        bands = pa.FixedSizeListArray.from_arrays(pa.array(texts.signed(np.concatenate(flat).ravel()) if flat else np.zeros(0, dtype=np.int64)), BANDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(whole(n, np.int64)), pa.array(texts.signed(whole(one, U))), pa.array(texts.signed(whole(two, U))), bands],
            names=["doc_id", "copy", "n_shingles", "set1", "set2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in texts.blocks(batch.column(1)):
            row, key = texts.shingles(texts.words(block), width, block.rows)
            upto = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=block.rows))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(texts.signed(key)))], names=["class", "shingles"])


def _close_pairs(held: pd.DataFrame, asking: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Similar enough pairs of a block of held and a block of asking classes: one count over the shingles that both have.

    own: the group that a class is connected to already (itself, if not given). Pairs inside a group are left out, and a class
    gets one link to each other group, since more connect no more.
    """
    none = pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
    if held.empty or asking.empty:
        return none
    sizes = np.array([len(x) for x in held["shingles"]])
    flat, owner = np.concatenate(held["shingles"].tolist()), np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner, ids = flat[order], owner[order], held["class"].to_numpy()
    group = held["own"].to_numpy() if "own" in held else ids
    found = []
    for x, mine, own in zip(asking["x"].tolist(), asking["own_x" if "own_x" in asking else "x"].tolist(), asking["of_x"].tolist(), strict=True):
        low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        width = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        common = np.bincount(owner[at], minlength=len(held))
        near = np.flatnonzero((common * 100 >= (sizes + len(own) - common) * percent) & (group != mine))
        near = ids[near[np.unique(group[near], return_index=True)[1]]]
        found.append(np.column_stack([np.minimum(near, x), np.maximum(near, x)]))
    links = np.concatenate(found)
    return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def _copy_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


class NearDuplicates:
    """Classes of equal sets of docs (doc_id, text), and which of them are connected by links of at least `percent` similarity."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("copy", _copy_key(F.col("text")))
        schema = "doc_id long, copy binary, n_shingles long, set1 long, set2 long, bands array<long>"
        self.rows = stage(self.docs.select("doc_id", "text", "copy").mapInArrow(lambda it: _fingerprints(it, width), schema), "fingerprints")
        # One row per distinct set. Its bands are those of any of its rows, since all are equal; so is the copy that stands for it.
        grouped = self.rows.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "copy")).alias("one"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
        self.classes = stage(grouped.withColumn("class", F.monotonically_increasing_id()), "classes")
        self.labels = self._linked()

    def _close(self, a: Column, b: Column) -> Column:
        """Sizes that allow the similarity asked for."""
        return F.least(a, b) * 100 >= F.greatest(a, b) * self.percent

    def _sets_of(self, wanted: DataFrame) -> DataFrame:
        """class and all shingles of some classes, from the text of one row of each. The only pass in which text is shuffled."""
        ones = stage(self.classes.join(wanted, "class").select("class", F.col("one.doc_id").alias("id"), F.col("one.copy").alias("key")), "wanted")
        ones = ones.hint("merge")  # it grows with the corpus: never broadcast, at no size
        found = self.docs.join(ones, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("copy") == F.col("key"))).select("class", "text")
        width = self.width
        return stage(found.mapInArrow(lambda it: _sets(it, width), "class long, shingles array<long>").dropDuplicates(["class"]), "sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """pairs (a, b) of classes whose full sets are similar enough."""
        both = pairs.join(sets.toDF("a", "of_a"), "a").join(sets.toDF("b", "of_b"), "b")
        common = F.size(F.array_intersect("of_a", "of_b"))
        enough = common * 100 >= (F.size("of_a") + F.size("of_b") - common) * self.percent
        return stage(both.where(enough).select("a", "b"), "links")

    def _linked(self) -> DataFrame:
        """class and label of every class with a link."""
        members = self.classes.select("class", "n", F.explode("bands").alias("band"))
        # Most bands occur once: they go before anything else is carried along
        shared_bands = members.groupBy("band").agg(F.count("*").alias("in")).where("in > 1").select("band")
        shared = stage(members.join(shared_bands, "band", "left_semi"), "shared")
        sets = self._sets_of(shared.select("class").distinct())
        prior = F.struct(F.xxhash64("class").alias("p"), F.col("class").alias("center"), F.col("n").alias("size"))
        centers = shared.groupBy("band").agg(F.min(prior).alias("first")).select("band", "first.center", "first.size")
        near = shared.join(centers, "band").where((F.col("class") != F.col("center")) & self._close(F.col("n"), F.col("size")))
        stars = stage(near.select(F.least("class", "center").alias("a"), F.greatest("class", "center").alias("b")).distinct(), "stars")
        links = self._verified(stars, sets)
        labels = connected_components(links)
        # Buckets in which several groups are left
        of = stage(shared.join(labels.toDF("class", "label"), "class", "left").select("band", "class", "n", F.coalesce("label", "class").alias("group")), "groups")
        several = of.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("band")
        left = stage(of.join(several, "band"), "left")
        more = self._across(left, sets, stars)
        return labels if more.isEmpty() else connected_components(links.union(more))

    def _across(self, left: DataFrame, sets: DataFrame, tried: DataFrame) -> DataFrame:
        """Links (a, b) between classes from different groups of a bucket. left: band, class, n, group.

        Of two groups the smaller one's classes ask. A class next to a group of one is a pair; next to a larger group it is
        compared with the group's blocks, where one pass over its shingles counts what it shares with every member. In a bucket
        with many groups, all classes but those of the largest group ask, and the whole bucket is held, in such blocks too.
        """
        sized = left.groupBy("band", "group").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"))
        crowded = sized.groupBy("band").agg(F.count("*").alias("groups"), F.max(F.struct("size", "group"))["group"].alias("largest")).where(F.col("groups") > CROWD)
        crowd = stage(left.join(crowded, "band").select("band", "class", "group", "largest"), "crowd")
        sized = sized.join(crowd.select("band").distinct(), "band", "left_anti")
        possible = (F.col("ha") * 100 >= F.col("lb") * self.percent) & (F.col("hb") * 100 >= F.col("la") * self.percent)
        two = sized.toDF("band", "ga", "sa", "la", "ha").join(sized.toDF("band", "gb", "sb", "lb", "hb"), "band").where((F.col("ga") < F.col("gb")) & possible)
        smaller = F.col("sa") <= F.col("sb")
        asked = two.select("band", F.when(smaller, F.col("ga")).otherwise(F.col("gb")).alias("few"), F.when(smaller, F.col("gb")).otherwise(F.col("ga")).alias("many"))
        asks = asked.join(left.select("band", F.col("class").alias("x"), F.col("group").alias("few")), ["band", "few"]).select("x", "many").distinct()
        inside = stage(left.select("group", "class").distinct(), "inside")
        members = inside.groupBy("group").agg(F.count("*").alias("members"), F.min("class").alias("only")).toDF("many", "members", "only")
        asks = stage(asks.join(members, "many"), "asks")
        pairs = asks.where("members = 1").select(F.least("x", "only").alias("a"), F.greatest("x", "only").alias("b")).distinct()
        single = self._verified(stage(pairs.join(tried, ["a", "b"], "left_anti"), "cross"), sets)
        # Blocks of groups and of crowded buckets, under the group's or the bucket's number
        kept = inside.select("group", "class", F.col("group").alias("own")).union(crowd.select(F.col("band").alias("group"), "class", F.col("group").alias("own")))
        asking = asks.where("members > 1").select(F.col("many").alias("group"), "x", F.lit(-1).cast("long").alias("own_x"))  # never of the group asked
        asking = asking.union(crowd.where(F.col("group") != F.col("largest")).select(F.col("band").alias("group"), F.col("class").alias("x"), F.col("group").alias("own_x")))
        size_of = self.classes.select("class", "n")
        kept, asking = stage(kept.join(size_of, "class"), "kept"), stage(asking.join(size_of.toDF("x", "n"), "x"), "asking")
        of = lambda rows, n: rows.groupBy("group").agg(F.count("*").alias(n), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias(n + "_blocks"))
        shape = stage(of(kept, "members").join(of(asking, "askers"), "group").select("group", "members", "askers", F.col("members_blocks").alias("rows"), F.col("askers_blocks").alias("columns")), "shapes")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        held = join_spread(kept.drop("n"), shape.drop("askers"), ["group"], "members", ["class"]).where("rows is not null")
        held = held.select("group", dealt("class", "rows").alias("row"), every("columns").alias("column"), "class", "own").join(sets, "class")
        wanted = join_spread(asking.drop("n"), shape.drop("members"), ["group"], "askers", ["x"]).where("rows is not null")
        wanted = wanted.select("group", every("rows").alias("row"), dealt("x", "columns").alias("column"), "x", "own_x").join(sets.toDF("x", "of_x"), "x")
        wanted, percent = wanted.toDF("x", "g", "r", "c", "own_x", "of_x"), self.percent
        across = held.groupBy("group", "row", "column").cogroup(wanted.groupBy("g", "r", "c")).applyInPandas(lambda a, b: _close_pairs(a, b, percent), "a long, b long")
        return stage(single.union(across), "more")

    def members(self) -> DataFrame:
        """doc_id, copy, n_shingles, label (null without words) and component_id for every row."""
        labelled = stage(self.classes.join(self.labels.toDF("class", "label"), "class", "left").select("set1", "set2", "n", "least", "copies", "label", "class"), "labelled")
        # Classes without a link are their own component; the others' smallest doc_ids are found by label
        linked = labelled.where("label is not null")
        smallest = stage(linked.groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("members")), "smallest")
        with_smallest = join_spread(linked, smallest, ["label"], "members", ["class"])
        alone = labelled.where("label is null").withColumns({"label": F.col("class"), "component": F.col("least")})
        of_class = stage(with_smallest.unionByName(alone).select("set1", "set2", F.col("n").alias("n_shingles"), "label", "component", "copies"), "of-class")
        joined = join_spread(self.rows.select("doc_id", "copy", "n_shingles", "set1", "set2"), of_class, ["set1", "set2", "n_shingles"], "copies", ["doc_id", "copy"])
        return joined.select("doc_id", "copy", "n_shingles", "label", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def link_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Words are lower-cased (A-Z) runs without ASCII white space; a set holds the distinct shingles of `width` words, or the
    whole sequence of a shorter text. Rows are linked if 100 * intersection >= percent * union; component_id is the
    smallest doc_id reachable. Null text counts as empty: its set is empty and it is linked with nothing, so its component
    is its own doc_id. Repeated rows have equal sets and one component, and each of them that has the smallest doc_id is kept.
    A null doc_id is never a component's id unless all of its rows have none. An empty table gives an empty result;
    other columns are not read.
    """
    rows = NearDuplicates(docs, width, percent).members()
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with exactly one row of each component, whole, with all columns: that of the smallest doc_id (null last). Rows without words all stay."""
    key, copy = free_names(docs, "key", "copy")
    rows = stage(NearDuplicates(docs, width, percent).members().where("label is not null").groupBy("label", "doc_id", "copy").agg(F.count("*").alias("times")), "members")
    first = stage(rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first"), F.count("*").alias("members")), "firsts")
    marked = join_spread(rows, first, ["label"], "members", ["doc_id", "copy"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy")))
    marked = stage(marked.select(F.col("doc_id").alias(key), F.col("copy").alias(key + "_copy"), "times", "stays"), "decisions")
    whole = docs.withColumn(copy, _copy_key(F.col("text")))
    same = whole["doc_id"].cast("long").eqNullSafe(F.col(key)) & (whole[copy] == F.col(key + "_copy"))
    kept = whole.join(marked.where("not stays"), same, "left_anti")
    again = marked.where("stays and times > 1")
    if not again.isEmpty():  # rows repeated as a whole
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", copy]))
    return kept.select(docs.columns)
