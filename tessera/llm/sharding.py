"""Sharding by the longest-processing-time rule: groups sorted by size, each to the least-loaded shard through a heap.

The heap runs over size classes, not over groups. A class holds the groups of one size (below 8192 bytes exactly one
size, above it sizes within 1/4096 of each other), so at most about 217,000 classes with their counts reach the driver,
whatever the corpus. The equal groups of a class go out in one step: the heap only sees the last few of them. Groups
then take their shard by their rank inside the class, found over buckets. Groups meet their class and rows their group by
shared.join_spread, so neither a common size nor a text with a third of all copies makes a hot task or a large broadcast.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_rows, free_names, join_spread, numbered, stage, utf8_bytes

#: Sizes of one class differ by less than one part in 2^CLASS_BITS.
CLASS_BITS = 12
#: What every row costs besides its text.
ROW_BYTES = 16
MOST_CLASSES = (1 << CLASS_BITS) * (64 - CLASS_BITS) + (2 << CLASS_BITS)


def size_class(size: Column) -> Column:
    """The smallest size of the class: the leading CLASS_BITS + 1 bits of the size."""
    shift = F.greatest(F.length(F.bin(size)) - (CLASS_BITS + 1), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """classes: (class, groups, bytes), largest class first. For each class the shards that get some of its groups and up to which rank.

    Equal groups, one after another to the least-loaded shard, fill the shards to one level. All but the last few are
    dealt by finding that level; a heap deals the rest. Ties go to the smaller shard.
    """
    load, plan = [0.0] * shards, []
    for key, groups, total in classes:
        each, given = total / groups, [0] * shards
        if groups > 4 * shards and each > 0:
            low, high = min(load), max(load) + each * (groups // shards + 1)
            for _ in range(100):
                middle = (low + high) / 2
                if sum(max(0, int((middle - x) / each)) for x in load) <= groups - shards:
                    low = middle
                else:
                    high = middle
            given = [max(0, int((low - x) / each)) for x in load]
        heap = [(x + n * each, s) for s, (x, n) in enumerate(zip(load, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(groups - sum(given)):
            least, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (least + each, s))
        load = [x + n * each for x, n in zip(load, given, strict=True)]
        into = [s for s in range(shards) if given[s]]
        upto, so_far = [], 0
        for s in into:
            so_far += given[s]
            upto.append(so_far)
        plan.append((key, into, upto))
    return plan


def shard_groups(groups: DataFrame, size: str, shards: int) -> DataFrame:
    """A shard for each row of a staged table of groups; columns of the result: those of groups and `shard`."""
    cls, n, total, rank, into, upto = free_names(groups, "cls", "n", "total", "rank", "into", "upto")
    classed = stage(groups.withColumn(cls, size_class(F.col(size))), "size-classes")
    counted = classed.groupBy(cls).agg(F.count("*").alias(n), F.sum(size).alias(total))
    classes = sorted(((r[0], r[1], r[2]) for r in bounded_rows(counted, MOST_CLASSES, "the table of size classes")), reverse=True)
    plan = deal(classes, shards)
    columns = [pa.array([p[0] for p in plan], pa.int64()), pa.array([p[1] for p in plan], pa.list_(pa.int32())), pa.array([p[2] for p in plan], pa.list_(pa.int64())), pa.array([c[1] for c in classes], pa.int64())]
    dealt = stage(groups.sparkSession.createDataFrame(pa.table(columns, names=[cls, into, upto, n])), "shard-plan")
    key = [c for c in groups.columns if c != size]
    ranked = numbered(classed, [cls], F.struct(*key), key, rank, max((c[1] for c in classes), default=0))
    chosen = F.expr(f"element_at(`{into}`, 1 + size(filter(`{upto}`, u -> u <= `{rank}`)))").cast("int")
    return join_spread(ranked, dealt, [cls], n, key).withColumn("shard", chosen).drop(cls, rank, into, upto)


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every row of docs (doc_id, text) in one of `shards` shards of nearly equal bytes; equal texts stay together.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot (gapless from 0 in each shard)
    and grown_shard (null: this law doesn't say where rows go if a shard is added). Null texts are one group, apart
    from empty ones, of 16 bytes each and with a null checksum. Repeated rows are rows of their own, in one shard. A group larger
    than a shard's fair share fills a shard alone. An empty table gives an empty result; other columns are not read.
    """
    own = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (utf8_bytes(F.col("text")) + ROW_BYTES).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit(b"")).alias("copies"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = stage(own.groupBy("copies").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    placed = stage(shard_groups(groups, "bytes", shards).select("copies", "shard", "rows"), "shard-of-group")
    rows = stage(join_spread(own, placed, ["copies"], "rows", ["row"]).drop("copies"), "sharded")
    slotted = numbered(rows, ["shard"], F.col("row"), ["row"], "slot", rows.count())
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
