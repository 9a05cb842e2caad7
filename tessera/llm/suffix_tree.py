"""Language-model scoring by a probabilistic suffix tree over words.

A context (up to DEPTH words) is a candidate if it occurs often enough, and a state of
the tree if what follows it diverges from what follows its suffix. A state keeps the next words that follow it
often enough; the rest of its probability goes to its suffix, down to the root, which knows every
word of the corpus. Depth goes on while contexts pass.

What is often enough grows with the square root of the corpus, so the tree grows with it too: from N tokens at most
sqrt(N) / CONTEXT_ROOT contexts of each length, sqrt(N) / NEXT_ROOT next words and sqrt(N) / WORD_ROOT frequent words. The tree
travels to the tasks (some megabytes from 10^8 tokens, ten times as much from 10^10), while the whole vocabulary stays a table
that rare words are joined to. Texts are read twice, to count words and to number the frequent ones; after that, passes read numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import texts
from tessera.llm.shared import crc_bucket, stage

DEPTH = 6
#: Occurrences that a context, a next word and a frequent word need: these times the square root of the training tokens, and so many at least.
CONTEXT_ROOT, NEXT_ROOT, WORD_ROOT = 0.05, 0.005, 0.0025
LEAST_CONTEXT, LEAST_NEXT = 8, 2
#: A context is kept if the divergence (in nats) of its next words from its suffix's is at least this.
DIVERGENCE = 0.02
HELD_OUT, FOLDS = 1, 5
U = np.uint64


def sequences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, token hashes, row of each token) of a text column's blocks; an END token closes each text."""
    for block in texts.blocks(column):
        w = texts.words(block)
        token = np.full(len(w.hash) + block.rows, texts.END, dtype=U)
        row = np.empty(len(token), dtype=np.int64)
        token[np.arange(len(w.hash)) + w.row] = w.hash
        row[np.arange(len(w.hash)) + w.row] = w.row
        row[np.cumsum(w.count) + np.arange(block.rows)] = np.arange(block.rows)
        yield block.first, block.rows, token, row


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return np.where(table[at] == x, at, -1)


@dataclass
class Level:
    """Contexts of one length. A context is known by its parent (the context without its last word) and that word."""

    key: np.ndarray  # parent * width + last word, sorted: the context's number is its place here
    suffix: np.ndarray  # number of the context without its first word, one length below
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))
    next_key: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # context * width + next word, sorted
    next_count: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    next_log: np.ndarray = field(default_factory=lambda: np.zeros(0))
    down_log: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of the weight of the suffix
    total: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # occurrences


@dataclass
class Tree:
    word: np.ndarray  # hashes of frequent words, sorted
    count: np.ndarray
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.word) + 1  # the last number stands for all other words

    def log_base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def contexts(self, word: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """For each length, the number of the context before each token, -1 where there is none."""
        out: list[np.ndarray] = []
        for n, level in enumerate(self.levels):
            here = np.full(len(word), -1, dtype=np.int64)
            if len(word) > n + 1:
                parent = np.zeros(len(word) - 1, dtype=np.int64) if n == 0 else out[-1][:-1]
                ok = np.flatnonzero((row[1:] == row[:-1]) & (parent >= 0) & (word[:-1] >= 0))
                here[1 + ok] = find(level.key, parent[ok] * self.width + word[ok])
            out.append(here)
        return out


#: Tokens that are worked on together; a longer text alone.
TOKENS_AT_ONCE = 1 << 20


def _numbered(batches: Iterator[pa.RecordBatch], word: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each text the numbers of its tokens (-1: no frequent word) as 32-bit integers, and the hashes of the others."""
    for batch in batches:
        for first, rows, token, row in sequences(batch.column(2)):
            number = find(word, token).astype("<i4")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
            rare = np.concatenate([[0], np.cumsum(np.bincount(row[number < 0], minlength=rows))])
            ids = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(number)])
            others = pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(texts.signed(token[number < 0])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), ids, others], names=["doc_id", "learns", "ids", "rare"])


def _numbers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, token numbers, row of each token) of a column that _numbered made."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data, at = np.frombuffer(column.buffers()[2], dtype=np.uint8), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 4 * TOKENS_AT_ONCE, side="right")) - 1)
        yield at, to - at, data[offsets[at] : offsets[to]].view("<i4").astype(np.int64), np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]) // 4)
        at = to


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [t for _, _, t, _ in sequences(batch.column(0))]
        key, n = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(texts.signed(key)), pa.array(n.astype(np.int64))], names=["key", "n"])


def _next_counts(batches: Iterator[pa.RecordBatch], tree: Tree, least: int) -> Iterator[pa.RecordBatch]:
    """How often each next word follows each context of the tree's longest length."""
    often = np.append(tree.count >= least, False)  # the last for -1
    for batch in batches:
        keys = []
        for _, _, word, row in _numbers(batch.column(0)):
            context = tree.contexts(word, row)[-1]
            there = np.flatnonzero(context >= 0)
            after = np.where(often[word[there]], word[there], tree.width - 1)
            keys.append(context[there] * tree.width + after)
        key, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])


def _summed(df: DataFrame, name: str) -> DataFrame:
    return stage(df.groupBy("key").agg(F.sum("n").alias("n")), name)


def _arrays(df: DataFrame) -> list[np.ndarray]:
    """Columns of a small table, by its first column."""
    table = df.toArrow().combine_chunks()
    columns = [c.to_numpy() for c in table.columns]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _settle(tree: Tree, total: np.ndarray, divergence: float) -> None:
    """Which contexts of the newest length diverge from their suffix, and their smoothed next words.

    total: occurrences of each context. What a context doesn't keep, and one count for each word it keeps, is the weight of its suffix.
    """
    level, n = tree.levels[-1], len(tree.levels)
    context, word = level.next_key // tree.width, level.next_key % tree.width
    p = level.next_count / total[context]
    if n == 1:
        q, lower = tree.count[word] / tree.tokens, 10.0 ** tree.log_base(tree.count[word])
    else:
        below = tree.levels[-2]
        at = find(below.next_key, level.suffix[context] * tree.width + word)  # always there: the suffix is as frequent at least
        q, lower = below.next_count[at] / below.total[level.suffix[context]], 10.0 ** below.next_log[at]
    size = len(level.key)
    kept_p, kept_q = np.bincount(context, p, size), np.bincount(context, q, size)
    rest_p, rest_q = np.clip(1 - kept_p, 0, 1), np.clip(1 - kept_q, 1e-12, 1)
    rest = np.where(rest_p > 1e-12, rest_p * np.log(np.maximum(rest_p, 1e-12) / rest_q), 0)
    level.kept = np.bincount(context, p * np.log(p / q), size) + rest >= divergence
    level.total = total
    kinds, kept = np.bincount(context, minlength=size), np.bincount(context, level.next_count, size)
    down = (total - kept + kinds) / np.maximum(total + kinds, 1)
    level.down_log = np.log10(np.maximum(down, 1e-300))
    level.next_log = np.log10(level.next_count / (total + kinds)[context] + down[context] * lower)


def least_counts(tokens: int, roots: tuple[float, float, float] = (CONTEXT_ROOT, NEXT_ROOT, WORD_ROOT)) -> tuple[int, int, int]:
    """Occurrences that a context, a next word and a frequent word need."""
    return tuple(max(least, int(root * tokens**0.5)) for root, least in zip(roots, (LEAST_CONTEXT, LEAST_NEXT, 1), strict=True))


def root_of(counts: DataFrame) -> Tree:
    """The tree without contexts, from the staged counts of words (key, n)."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    word, count = _arrays(counts.where(F.col("n") >= least_counts(tokens)[2]).select(F.col("key").alias("key"), "n"))
    order = np.argsort(word.view(U))
    return Tree(word.view(U)[order], count[order], tokens, distinct)


def grow(tree: Tree, ids: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE) -> Tree:
    """The tree with its contexts, from a table with the token numbers of the training texts. One pass over it per length."""
    of_context, of_next, _ = least_counts(tree.tokens)
    last_words = np.flatnonzero((tree.count >= of_context) & (tree.word != U(texts.END)))
    parents, suffixes = np.zeros(len(last_words), dtype=np.int64), np.zeros(len(last_words), dtype=np.int64)
    for n in range(depth):
        key = parents * tree.width + last_words
        order = np.argsort(key)
        tree.levels.append(level := Level(key[order], suffixes[order]))
        if not len(key):
            tree.levels.pop()
            break
        found = _summed(ids.mapInArrow(lambda it, tree=tree: _next_counts(it, tree, of_next), "key long, n long"), f"next-{n + 1}")
        level.next_key, level.next_count = _arrays(found.where((F.col("n") >= of_next) & (F.col("key") % tree.width != tree.width - 1)))
        whole = found.groupBy(F.expr(f"key div {tree.width}").alias("context")).agg(F.sum("n").alias("n"))
        total = np.zeros(len(key), dtype=np.int64)
        context, times = _arrays(whole)
        total[context] = times
        _settle(tree, total, divergence)
        # Contexts one word longer: what follows this length often enough
        often = (level.next_count >= of_context) & (tree.word[level.next_key % tree.width] != U(texts.END))
        parents, last_words = level.next_key[often] // tree.width, level.next_key[often] % tree.width
        if n == 0:
            suffixes = find(level.key, last_words)
        else:
            suffixes = find(level.key, level.suffix[parents] * tree.width + last_words)
        whole_chain = suffixes >= 0
        parents, last_words, suffixes = parents[whole_chain], last_words[whole_chain], suffixes[whole_chain]
    for upper, lower in zip(tree.levels[:0:-1], tree.levels[-2::-1], strict=True):
        lower.kept[upper.suffix[upper.kept]] = True  # a state's suffixes are states
    return tree


def _scores(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    base = tree.log_base(tree.count)
    for batch in batches:
        for first, rows, word, row in _numbers(batch.column(2)):
            context = tree.contexts(word, row)
            rare = word < 0
            root = np.where(rare, 0.0, base[word] if len(base) else 0.0)
            score, settled = np.zeros(len(word)), np.zeros(len(word), dtype=bool)
            for level, at in zip(tree.levels[::-1], context[::-1], strict=True):
                ask = np.flatnonzero((at >= 0) & ~settled)
                ask = ask[level.kept[at[ask]]]
                hit = np.where(rare[ask], -1, find(level.next_key, at[ask] * tree.width + word[ask]))
                score[ask] += np.where(hit >= 0, level.next_log[hit] if len(level.next_log) else 0.0, level.down_log[at[ask]])
                settled[ask[hit >= 0]] = True
            score += np.where(settled, 0.0, root)
            known = [batch.column(k).slice(first, rows) for k in (0, 1)]
            sums = [texts.by_row(row, rows), texts.by_row(row[~rare], rows), np.bincount(row, root, rows), np.bincount(row, score, rows)]
            yield pa.RecordBatch.from_arrays([*known, *map(pa.array, sums)], names=["doc_id", "row", "n_tokens", "n_known", "base", "score"])


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """log10 probability of every text of docs (doc_id, text), by words alone (base_score) and by the tree (score).

    Texts whose crc32(doc_id as text) modulo 5 is 1 are held out; the others train, also those without doc_id. Words are
    lower-cased (A-Z) runs without ASCII white space, and an end token closes a text. Null text counts as empty: it has
    the end token alone. Repeated rows train and are scored each. With nothing to train on, every token has
    probability 1. An empty table gives an empty result; other columns are not read.
    """
    held_out = crc_bucket(F.col("doc_id"), FOLDS) == HELD_OUT
    counts = _summed(docs.where(~held_out).select("text").mapInArrow(_word_counts, "key long, n long"), "word-counts")
    tree = root_of(counts)
    word, own = tree.word, docs.select("doc_id").schema
    schema = T.StructType([*own, *T.StructType.fromDDL("learns boolean, ids binary, rare array<long>")])
    read = docs.select("doc_id", (~held_out).alias("learns"), "text").mapInArrow(lambda it: _numbered(it, word), schema)
    ids = stage(read.withColumn("row", F.monotonically_increasing_id()), "token-numbers")
    tree = grow(tree, ids.where("learns").select("ids"), depth)
    schema = T.StructType([*own, *T.StructType.fromDDL("row long, n_tokens long, n_known long, base double, score double")])
    scored = stage(ids.select("doc_id", "row", "ids").mapInArrow(lambda it: _scores(it, tree), schema), "scored")
    rare = ids.select("row", F.explode("rare").alias("key"))
    n = F.coalesce(F.col("n"), F.lit(0))
    log = F.log10((n + 0.5) / F.lit(tree.tokens + 0.5 * (tree.distinct + 1)))
    late = rare.join(counts, "key", "left").groupBy("row").agg(F.sum(log).alias("late"), F.count("n").alias("late_known"))
    whole = scored.join(late, "row", "left")
    more = F.coalesce("late", F.lit(0.0))
    return whole.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
