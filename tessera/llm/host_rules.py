"""Quality rules with a verdict per host: failures of documents, counted by host, shrunk towards all hosts' rate.

Two base rules reject a document by themselves. Softer rules are judged together with its host: a host whose rate of failing documents
is, by its posterior, above the hosts' mean for nearly certain is strict ground, where one soft failure rejects a document; elsewhere it
takes two. So a host of few documents is no strict ground for what these documents did themselves. A host
whose rate is beyond doubt far above the others' is rejected with all its documents.

Counting runs over bytes of whole texts in Arrow batches; host rates are an aggregation with map-side sums, so a host
with a third of all rows sends one row per task, and its documents get its verdict by broadcast (shared.join_spread).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import texts
from tessera.llm.shared import free_names, join_spread, stage

#: A document fails with fewer words, or with a larger share (in percent) of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Soft rules: more symbols than one to so many words, a repeated line to so many words, a larger share of repeated words (in
#: percent), mean word length outside these limits.
WORDS_PER_SYMBOL, WORDS_PER_LINE, SOFT_REPEATED, SHORTEST, LONGEST = 10, 20, 20, 3, 10
#: Soft failures that reject a document, and those that do so on strict ground.
SOFT_MOST, SOFT_STRICT = 2, 1
#: A host is rejected if its shrunk rate, less two standard deviations, exceeds this rate and this multiple of the mean host's odds.
HOST_RATE, HOST_ODDS = 0.3, 4.0
#: Standard deviations of the posterior that a strict host's rate stands above the mean by: a chance of one in twenty.
SURE = 1.645
#: Weight of the prior, in documents, where there is one host alone, and its limits.
PRIOR_DEFAULT, PRIOR_LEAST, PRIOR_MOST = 20.0, 2.0, 1000.0
#: Rates this close count as equal.
SAME = 1e-9
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_block(block: texts.Block) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a block."""
    rows = block.rows
    w = texts.words(block, lower=False)
    letter = np.ones(256, dtype=bool)
    letter[0x80:0xC0] = False  # continuation bytes of UTF-8
    letter[[9, 10, 11, 12, 13, 32]] = False
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS.encode())] = True
    row, line, filled = texts.lines(block)
    row, line = row[filled], line[filled]
    return {
        "n_words": w.count,
        "word_chars": texts.byte_counts(block, letter),
        "n_symbols": texts.byte_counts(block, symbol),
        "n_dup_lines": texts.by_row(row, rows) - texts.distinct_in_row(row, line, rows),
        "n_repeat_words": texts.repeated_words(w, 3, rows),
    }


def _with_counts(batches: Iterator[pa.RecordBatch], at: int, keep: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [count_block(b) for b in texts.blocks(batch.column(at))]
        counts = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for c in COUNTS]
        arrays = [batch.column(k) for k in keep] + [pa.array(c.astype(np.int64)) for c in counts]
        yield pa.RecordBatch.from_arrays(arrays, names=[str(k) for k in range(len(arrays))])


def with_counts(docs: DataFrame, text: str, keep: list[str], names: list[str]) -> DataFrame:
    """docs' columns `keep`, and the counts of COUNTS under `names`."""
    read = docs.select(*keep, *([] if text in keep else [text]))
    at, kept = read.columns.index(text), [read.columns.index(c) for c in keep]
    schema = read.select(*keep).schema
    for name in names:
        schema = schema.add(name, "long")
    return read.mapInArrow(lambda it: _with_counts(it, at, kept), schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (n_repeat_words * 100 > n_words * MOST_REPEATED)


def soft_failures(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column) -> Column:
    """How many of the soft rules a document fails."""
    rules = (
        n_symbols * WORDS_PER_SYMBOL > n_words,
        n_dup_lines * WORDS_PER_LINE > n_words,
        n_repeat_words * 100 > n_words * SOFT_REPEATED,
        (word_chars < n_words * SHORTEST) | (word_chars > n_words * LONGEST),
    )
    return reduce(lambda a, b: a + b, (r.cast("int") for r in rules))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta distribution that the hosts' rates (failed of rows) come from.

    Moments of the rates, less what the rates vary because hosts are finite; hosts that differ no more than that get PRIOR_MOST.
    """
    f, n = F.col("failed"), F.col("rows")
    mean, var, part = hosts.agg(F.avg(f / n), F.var_samp(f / n), F.avg(1 / n)).first()
    if mean is None or var is None or part >= 1:
        return mean or 0.0, PRIOR_DEFAULT
    between = (var - mean * (1 - mean) * part) / (1 - part)
    weight = mean * (1 - mean) / between - 1 if between > 0 else PRIOR_MOST
    return mean, min(max(weight, PRIOR_LEAST), PRIOR_MOST)


def host_verdicts(rows: DataFrame, host: str, failed: str) -> DataFrame:
    """A staged table of hosts (without null): their rows, and how many soft failures reject a document of theirs (0: all of them go)."""
    hosts = stage(rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.sum(F.col(failed).cast("long")).alias("failed"), F.count("*").alias("rows")), "hosts")
    mean, weight = prior(hosts)
    total = F.col("rows") + weight
    rate = (F.col("failed") + mean * weight) / total
    spread = F.sqrt(rate * (1 - rate) / (total + 1))
    far = max(HOST_RATE, HOST_ODDS * mean / (1 + (HOST_ODDS - 1) * mean))
    allowed = F.when(rate - 2 * spread > far, 0).when(rate - SURE * spread > mean + SAME, SOFT_STRICT).otherwise(SOFT_MOST)
    return stage(hosts.select(host, "rows", allowed.alias("allowed")), "host-verdicts")


def passes(failed: Column, soft: Column, allowed: Column) -> Column:
    return ~failed & (soft < F.coalesce(allowed, F.lit(SOFT_MOST)))


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs (doc_id, text, source); the source is the host.

    kept is false for a document that fails itself, for one with as many soft failures as its host's verdict allows at most, and for all
    documents of a rejected host. Rows without source have no host and answer for themselves. Null text counts as empty: no words,
    hence failed. Repeated rows are judged each, hosts of equal rates equally; an empty table gives an empty result; other columns are
    not read.
    """
    counted = with_counts(docs.select("doc_id", "source", "text"), "text", ["doc_id", "source"], list(COUNTS))
    rows = stage(counted.withColumns({"base_failed": base_failed(F.col("n_words"), F.col("n_repeat_words")), "soft": soft_failures(*map(F.col, COUNTS))}), "rule-counts")
    hosts = host_verdicts(rows.select("source", (F.col("base_failed") | (F.col("soft") > 0)).alias("failed")), "source", "failed")
    judged = join_spread(rows, hosts, ["source"], "rows", ["doc_id", *COUNTS])
    return judged.select("doc_id", *COUNTS, "base_failed", passes(F.col("base_failed"), F.col("soft"), F.col("allowed")).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge_documents keeps, with all their columns. Two passes over the text: hosts first, then rows."""
    names = free_names(docs, *COUNTS)
    failed, soft = base_failed(F.col(names[0]), F.col(names[4])), soft_failures(*map(F.col, names))
    rates = with_counts(docs.select("source", "text"), "text", ["source"], names).select("source", (failed | (soft > 0)).alias("failed_"))
    hosts = host_verdicts(rates, "source", "failed_")
    (allowed,) = free_names(docs, "allowed_soft")
    good = with_counts(docs, "text", docs.columns, names).where(~failed & (soft < SOFT_MOST))  # the rest needs no host
    marked = good.withColumn(allowed, soft).drop(*names)
    (verdict,) = free_names(marked, "verdict")
    judged = join_spread(marked, hosts.withColumnsRenamed({"allowed": verdict}), ["source"], "rows", [allowed, *docs.columns])
    return judged.where(F.col(allowed) < F.coalesce(verdict, F.lit(SOFT_MOST))).select(docs.columns)
