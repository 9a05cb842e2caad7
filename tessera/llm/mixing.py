"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... of the schedule map to van der Corput points, the points through the cumulative weights to sources, so
every stretch of the schedule holds each source in its proportion. With 2^k points, cumulative weights in whole slots
make each source's number of slots exact. Reversing bits undoes itself, so a source's slots are the reversed numbers of its
stretch of points. Slots are ranked per source and joined to the source's blocks: its documents
in hashed order, cut into blocks of equal words; rank r takes block r modulo the number of blocks, in epoch r div it.
What a document gets is the number of its blocks' slots, and where it stands in the mix is its first block's slot: in order of
slots every stretch of the mix holds each source near its share, which is what the low discrepancy is for.

Sources are a table of any length: their weights follow from numbers given over sorted ranges, their targets from one water
level that a few aggregations close in on, and rows meet their source by shared.join_spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.shared import ROWS_PER_BUCKET, free_names, join_spread, running_offsets, stage
from tessera.operators.numbering import numbered as numbered_in_order

#: Fixed value: a word, as the JVM's regular expressions write it.
WORD, BETWEEN = r"[^\x20\x09-\x0D]+", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Words of a block at most; a source with a small target has smaller ones, so that it gets BLOCKS_PER_SOURCE or more.
BLOCK_WORDS, BLOCKS_PER_SOURCE = 2048, 256
#: Parts that a search for the water level cuts its range into, each time.
PARTS = 1024


def source_key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def water_level(sources: DataFrame, total: int) -> float:
    """The level at which sources, each filled up to level * weight but not above its cap, hold `total` in sum.

    Between two neighbouring ratios of cap to weight the sum is linear in the level. The search sums by parts of the
    range of ratios, goes on inside the part that the level lies in, and ends when that part has one ratio left.
    """
    ratio = F.col("cap") / F.col("weight")
    low, high = 0.0, sources.agg(F.max(ratio)).first()[0]
    while True:
        full, rest = sources.agg(F.sum(F.when(ratio <= low, F.col("cap"))), F.sum(F.when(ratio > low, F.col("weight")))).first()
        full, rest = full or 0, rest or 0
        part = F.least(F.floor((ratio - low) / (high - low) * PARTS), F.lit(PARTS - 1)) if high > low else F.lit(0)
        sums = sources.where((ratio > low) & (ratio <= high)).groupBy(part.alias("part")).agg(F.min(ratio).alias("least"), F.max(ratio).alias("most"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
        rows = sorted(sums.collect())  # at most PARTS
        for _, least, most, cap, weight in rows:
            if full + cap + most * (rest - weight) >= total:
                break
            low, full, rest = most, full + cap, rest - weight
        else:
            return low
        if least == most:
            return (total - full) / rest
        high = most


def shares(totals: DataFrame) -> DataFrame:
    """A staged table of sources (key, rows) with src (their place), source_size, target, and block_words, blocks, slots, first (slots of sources before).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; none gets more than MOST_REPEATS times its
    own, and what one can't take goes to the others by weight.
    """
    placed = numbered_in_order(totals, [F.col("source").isNull(), "source"], "src")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("src") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    weighed = stage(placed.select("*", weight.alias("weight"), (F.col("source_size") * MOST_REPEATS).alias("cap")), "mix-sources")
    total = weighed.agg(F.sum("source_size")).first()[0]
    level = water_level(weighed, total) if total else 0.0
    size, target, block, blocks, epochs = map(F.col, ("source_size", "target", "block_words", "blocks", "epochs"))
    aimed = weighed.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * level))
    cut = aimed.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(target / BLOCKS_PER_SOURCE))).cast("long"))
    cut = cut.withColumn("blocks", F.ceil(size / block)).withColumn("epochs", F.when(size > 0, F.least(F.lit(MOST_REPEATS), F.floor(target / size))).otherwise(0))
    last = F.when(epochs < MOST_REPEATS, F.least(blocks, F.bround((target - epochs * size) / block))).otherwise(0)
    counted = stage(cut.withColumn("slots", (epochs * blocks + last).cast("long")).withColumns({"every": F.lit(0), "chunk": F.expr(f"src div {ROWS_PER_BUCKET}")}), "mix-slots")
    before = running_offsets(counted, ["every"], "chunk", F.col("slots"), "before")
    inside = W.partitionBy("chunk").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    whole = counted.join(F.broadcast(before), ["every", "chunk"]).withColumn("first", F.col("before") + F.coalesce(F.sum("slots").over(inside), F.lit(0)))  # a row per ROWS_PER_BUCKET sources
    return stage(whole.select("key", "rows", "src", "source_size", "target", "block_words", "blocks", "slots", "first"), "mix-shares")


def reversed_bits(x: Column, bits: int) -> Column:
    """A number's last `bits` bits in reverse: 2^bits times its van der Corput point."""
    return F.conv(F.reverse(F.lpad(F.bin(x), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def schedule(sources: DataFrame) -> DataFrame:
    """slot, src, block and epoch for every slot that goes to a source."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(0, total - 1).bit_length()
    some = sources.where("slots > 0").select("src", "blocks", "first", "slots")
    parts = some.select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {ROWS_PER_BUCKET})")).alias("part")).repartition("src", "part")
    start = f"first + part * {ROWS_PER_BUCKET}"
    points = parts.select("src", "blocks", F.explode(F.expr(f"sequence({start}, least(first + slots, {start} + {ROWS_PER_BUCKET}) - 1)")).alias("point"))
    # Each slot's rank in its source: slots in order, by chunks of consecutive ones
    slots = points.withColumn("slot", reversed_bits(F.col("point"), bits)).drop("point")
    chunked = stage(slots.withColumn("chunk", F.expr(f"slot div {ROWS_PER_BUCKET}")), "slots")
    before = running_offsets(chunked, ["src"], "chunk", F.lit(1), "before")
    rank = F.col("before") + F.row_number().over(W.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = chunked.join(before, ["src", "chunk"]).withColumn("rank", rank)
    return ranked.select("slot", "src", F.expr("rank % blocks").alias("block"), F.expr("cast(rank div blocks as int)").alias("epoch"))


def in_order(rows: DataFrame, offsets: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with `at`: the words of the same source that come before them. names: what src, bucket, size, key and at are called."""
    n = names
    of_bucket = offsets.toDF(n["src"], n["bucket"], n["base"])
    inside = W.partitionBy(n["src"], n["bucket"]).orderBy(n["key"]).rowsBetween(W.unboundedPreceding, -1)
    at = F.col(n["base"]) + F.coalesce(F.sum(n["size"]).over(inside), F.lit(0))
    return rows.join(of_bucket, [n["src"], n["bucket"]]).withColumn(n["at"], at)


class Mix:
    """The plan of a mix: shares, the staged schedule, and where each bucket of a source's hashed order starts."""

    def __init__(self, docs: DataFrame):
        sized = stage(self._sized(docs.select("doc_id", "source", "text"), "words", "order", "key").drop("text"), "mix-sizes")
        totals = stage(sized.groupBy("source", "key").agg(F.sum("words").alias("source_size"), F.count("*").alias("rows")), "mix-totals")
        self.shares = shares(totals)
        self.buckets = max(1, -(-(totals.agg(F.sum("rows")).first()[0] or 0) // ROWS_PER_BUCKET))
        self.slots = stage(schedule(self.shares), "schedule")
        of = ["key", "rows", "src", "source_size", "target", "block_words"]
        self.sized = stage(self._bucketed(join_spread(sized, self.shares.select(*of), ["key"], "rows", ["order"]), "order", "bucket"), "mix-rows")
        self.offsets = stage(running_offsets(self.sized, ["src"], "bucket", F.col("words"), "base"), "mix-offsets")

    @staticmethod
    def _sized(docs: DataFrame, words: str, order: str, key: str) -> DataFrame:
        """The word count, a hash that puts documents of a source into an order of their own, and the source's key."""
        hashed = F.xxhash64(F.md5(F.col("text").cast("binary")), F.col("doc_id"), F.col("source"))
        return docs.withColumns({words: F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), order: hashed, key: source_key(F.col("source"))})

    def _bucketed(self, rows: DataFrame, order: str, bucket: str) -> DataFrame:
        return rows.withColumn(bucket, F.pmod(F.col(order), F.lit(self.buckets)).cast("int"))

    def positions(self) -> DataFrame:
        """doc_id, source place, words and `at` for every row."""
        return in_order(self.sized, self.offsets, {n: n for n in ("src", "bucket", "at", "base")} | {"size": "words", "key": "order"})

    def taken_words(self) -> DataFrame:
        """Words that the schedule takes from every row, and its first slot: the row's pieces joined to the slots of their blocks."""
        placed = stage(self.positions().withColumn("row", F.monotonically_increasing_id()), "mix-places")
        pieces = placed.where("words > 0").select("row", "src", "at", "words", "block_words", F.explode(F.expr("sequence(at div block_words, (at + words - 1) div block_words)")).alias("block"))
        times = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
        overlap = F.least(F.col("at") + F.col("words"), (F.col("block") + 1) * F.col("block_words")) - F.greatest(F.col("at"), F.col("block") * F.col("block_words"))
        taken = pieces.join(times, ["src", "block"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"), F.min("slot").alias("first_slot"))
        return placed.join(taken, "row", "left").select("doc_id", F.col("words").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")

    def documents(self, docs: DataFrame, slot: str | None = None) -> DataFrame:
        """docs as the mix takes them: each row once per epoch, in a source's last epoch up to the last block's end.

        slot: a column of this name gets the slot at which a row starts in that epoch; in its order the rows are the mix.

        The ranks of a source's slots run through its blocks in order, so an epoch takes the first blocks of the
        source; where they end inside a document, the row keeps the words up to there, and n_chars, if docs has it, follows.
        """
        words, order, key, src, bucket, base, at, took, ends, epoch, width = free_names(docs, "words", "order", "key", "src", "bucket", "base", "at", "took", "ends", "epoch", "width")
        names = {"src": src, "bucket": bucket, "size": words, "key": order, "at": at, "base": base}
        upto = F.array_compact(F.array(*(F.max(F.when(F.col("epoch") == k, F.col("block") + 1)) for k in range(MOST_REPEATS + 1))))
        epochs = self.slots.groupBy("src").agg(upto.alias("upto"))
        recipe = self.shares.join(epochs, "src", "left").select(F.col("key").alias(key), "rows", F.col("src").alias(src), F.transform("upto", lambda b: b * F.col("block_words")).alias(ends), F.col("block_words").alias(width))
        known = join_spread(self._sized(docs, words, order, key), stage(recipe, "mix-epochs"), [key], "rows", [order])
        rows = in_order(self._bucketed(known, order, bucket), self.offsets, names)
        each = F.transform(ends, lambda e: F.least(e - F.col(at), F.col(words)))
        mixed = rows.select("*", F.posexplode(each).alias(epoch, took)).where(f"`{took}` > 0")  # one row per epoch
        parts = F.split("text", BETWEEN)
        lead = F.when(F.get(parts, F.lit(0)).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
        cut = F.col(took) < F.col(words)
        text = F.when(cut, F.array_join(F.slice(parts, 1, F.col(took).cast("int") + lead), "")).otherwise(F.col("text"))
        out = mixed.withColumn("text", text)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        if slot is None:
            return out.select(docs.columns)
        starts = self.slots.select(F.col("src").alias(src), F.col("block").alias(base), F.col("epoch").alias(epoch), F.col("slot").alias(slot))
        begun = out.withColumn(base, F.expr(f"`{at}` div `{width}`"))
        return begun.join(starts, [src, base, epoch]).select(*docs.columns, slot)


def mix_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes of every row of docs (doc_id, text, source): doc_id, size, source_size, target, taken and first_slot (where
    in the mix the row starts first; null if nothing is taken of it).

    Null text has no words and nothing is taken of it; null is a source of its own, the last. Repeated rows are rows of
    their own (which of two equal rows comes first is open, what both are given in sum is not). A source without words
    has target 0. An empty table gives an empty result; other columns are not read. Reruns agree, since the order is a
    hash of doc_id, text and source.
    """
    return Mix(docs).taken_words()
