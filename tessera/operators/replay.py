"""Replay of a log of merges and renames: what names have become by the end of the log, or by any entry of it.

Each entry gives everything that goes by its old name the new one. What an entry did is changed again by the first later entry whose
old name is its new one: so entries form a forest, each pointing at a later one, and following pointers to the end tells what
became of a name. Inside of a chunk of the log a task follows them; from chunk to chunk pointers are doubled in rounds of joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.numbering import cut
from tessera.operators.spread import join_counted

#: Numbers of the log that one task sorts of a name.
CHUNK = 65_536


def next_leave(asks: DataFrame, log: DataFrame, name: str, after: str, chunk: int = CHUNK) -> DataFrame:
    """asks with `next`: the first entry of the log (entry, old) later than `after` that takes the name away; null if none does.

    A name with a third of all entries is cut into chunks of the log: inside of one the next entry is a window, behind it the first entry of a later chunk.
    """
    at = F.floor(F.col("__at") / chunk)
    leaves = log.select(F.col("old").alias(name), F.col("entry").alias("__at"), F.col("entry").alias("__leave")).withColumn("__chunk", at)
    events = asks.withColumns({"__at": F.col(after), "__ask": F.lit(True)}).withColumn("__chunk", at).unionByName(leaves, allowMissingColumns=True)
    # from the last entry backwards: a frame that only grows is summed up as it goes, one that only shrinks would be read anew for every row
    inside = F.min("__leave").over(W.partitionBy(name, "__chunk").orderBy(F.col("__at").desc()).rangeBetween(W.unboundedPreceding, -1))
    firsts = events.groupBy(name, "__chunk").agg(F.min("__leave").alias("__first"))
    behind = F.min("__first").over(W.partitionBy(name).orderBy(F.col("__chunk").desc()).rangeBetween(W.unboundedPreceding, -1))
    later = firsts.withColumn("__later", behind).select(name, "__chunk", "__later")
    found = events.withColumn("__inside", inside).where("__ask").join(later, [name, "__chunk"], "left")
    return found.select(*asks.columns, F.coalesce("__inside", "__later").alias("next"))


def became(log: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """entry and final: what the new name of each entry (entry, old, new) has become at the end of the log.

    The log is cut into chunks of its numbers. Inside of one a task goes back from the end; what a chunk does as a whole is a row for each name that
    it takes away, by the first entry that does. Only those rows are followed from chunk to chunk, by doubled pointers: the rounds are as many as the
    logarithm of the chunks, however long the chain of entries is.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = f"entry {kinds['entry']}, old {kinds['old']}, final {kinds['new']}, first boolean, chunk long"
    walked = cut(log.select("entry", "old", "new", F.floor(F.col("entry") / chunk).cast("long").alias("chunk")).groupBy("chunk").applyInArrow(_walked_back, schema))
    firsts = walked.where("first")
    # a row per name and chunk at most: who goes by a name when a chunk ends, and which entry takes the name away in a chunk
    names = walked.select("chunk", "final").distinct().withColumn("__leave", F.lit(None).cast(kinds["entry"]))
    events = names.unionByName(firsts.select("chunk", F.col("old").alias("final"), F.col("entry").alias("__leave")))
    behind = F.min("__leave").over(W.partitionBy("final").orderBy(F.col("chunk").desc()).rangeBetween(W.unboundedPreceding, -1))
    hops = cut(events.withColumn("next", behind).where("__leave is null and next is not null").select("chunk", "final", "next"))
    links = cut(join_counted(firsts.select("entry", "chunk", "final"), hops, ["chunk", "final"], ["entry"]).select("entry", "final", "next"))
    while not (open_ := links.where("next is not null")).isEmpty():
        further = links.select(F.col("entry").alias("next"), F.col("next").alias("__next"), F.col("final").alias("__final"))
        met = join_counted(open_, further, ["next"], ["entry"])  # many entries may wait for the same later one
        moved = met.select("entry", F.col("__final").alias("final"), F.col("__next").alias("next"))
        links = cut(moved.unionByName(links.where("next is null")))
    ends = hops.join(links.select(F.col("entry").alias("next"), F.col("final").alias("__end")), "next").select("chunk", "final", "__end")
    return join_counted(walked.select("entry", "chunk", "final"), ends, ["chunk", "final"], ["entry"]).select("entry", F.coalesce("__end", "final").alias("final"))


def _walked_back(log: pa.Table) -> pa.Table:
    """A chunk's entries with what their new name is when the chunk ends, and whether an entry is the first to take its old name away."""
    log = log.sort_by([("entry", "descending")])
    ends: dict = {}
    takes: dict = {}
    finals = []
    for k, (old, new) in enumerate(zip(log["old"].to_pylist(), log["new"].to_pylist(), strict=True)):
        final = ends.get(new, new)
        finals.append(final)
        ends[old], takes[old] = final, k
    first = np.zeros(len(finals), dtype=bool)
    first[list(takes.values())] = True
    return pa.table({"entry": log["entry"], "old": log["old"], "final": pa.array(finals, log.schema.field("new").type), "first": first, "chunk": log["chunk"]})


def replayed(rows: DataFrame, log: DataFrame, since: Column | None = None, until: int | None = None, blank: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """rows (id, name and others) with `final`: what their name has become by the log (entry, old, new), entries in the order of their number.

    since: the entry after which a row goes by its name (null: it did before all entries). until: the last entry that counts, for the
    state at any time. blank: names that are never merged away. Entries without a name, or from a name to itself, change nothing.
    """
    counts = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("old") != F.col("new")) & ~F.col("old").isin(*blank)
    kept = log.where(counts if until is None else counts & (F.col("entry") <= until)).select("entry", "old", "new")
    kept = cut(kept)
    start = F.lit(None).cast("long") if since is None else since
    least = F.coalesce(start, F.lit(-(1 << 62)))
    asked = rows.select("*", least.alias("__since"))
    first = cut(next_leave(asked, kept, "name", "__since", chunk))
    ends = became(kept, chunk).select(F.col("entry").alias("next"), F.col("final").alias("__final"))
    return join_counted(first, ends, ["next"], ["id"]).select(*rows.columns, F.coalesce("__final", "name").alias("final"))
