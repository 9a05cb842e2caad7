"""Token counts by a map-side lookup of two tiers: a broadcast table of frequent words' counts, and caches of the workers.

Tokens of the vocabulary never span white space, so a text's count is the sum over its words (runs of bytes other than space and
\\t \\n \\v \\f \\r). Words are never shuffled: each block of texts is hashed as arrays, frequent words are looked up in a compact
open-addressing table that travels once to each executor, other words in a cache that a worker keeps from task to task, and what the
cache lacks is encoded by the vocabulary's own library. The table only saves time; counts don't depend on it.

Which words are frequent is counted over all documents: each task keeps a summary of bounded size, and only these are added up.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import texts

LIMIT = 2048
#: Words of the broadcast table (512 KiB of keys, 64 KiB of counts), and those of a task's summary.
FREQUENT, SUMMARY = 32_768, 4096
#: Longer words (bytes) are encoded wherever they come up, never kept.
LONGEST = 64
#: Words that a worker's cache holds before it starts anew, and words that are encoded in one call.
REMEMBERED, AT_ONCE = 400_000, 2048
#: The most a vocabulary file may have to be broadcast.
MOST_VOCABULARY_BYTES = 64 << 20


class Lengths:
    """An open-addressing table from 64-bit word hashes to counts, read as arrays. Key 0 marks a free slot."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        slots = 1 << max(4, int(2 * len(keys) - 1).bit_length())
        self.keys, self.counts, self.steps = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.uint8), 0
        fits = (keys != 0) & (counts < 256)
        keys, counts = keys[fits], counts[fits]
        while len(keys):
            at = self._slot(keys, self.steps)
            _, first = np.unique(at, return_index=True)
            placed = first[self.keys[at[first]] == 0]
            self.keys[at[placed]], self.counts[at[placed]] = keys[placed], counts[placed]
            rest = np.ones(len(keys), dtype=bool)
            rest[placed] = False
            keys, counts, self.steps = keys[rest], counts[rest], self.steps + 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys + np.uint64(step)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's count, and whether the table has it."""
        count, known, left = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool), np.arange(len(keys))
        for step in range(self.steps):
            at = self._slot(keys[left], step)
            hit = self.keys[at] == keys[left]
            count[left[hit]], known[left[hit]] = self.counts[at[hit]], True
            left = left[~hit & (self.keys[at] != 0)]
            if not len(left):
                break
        return count, known


class Encoder:
    """Counts of single words by the vocabulary's library, with a cache."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[int, int] = {}

    def counts(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def look_up(self, keys: np.ndarray, block: texts.Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Counts of distinct words, given their hashes and where each stands in the block."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = [self.known.get(k) for k in keys.tolist()]
        missing = [i for i, n in enumerate(found) if n is None]
        for at in range(0, len(missing), AT_ONCE):
            some = missing[at : at + AT_ONCE]
            for i, n in zip(some, self.counts([block.data[start[i] : end[i]].tobytes().decode() for i in some]), strict=True):
                found[i] = n
                if end[i] - start[i] <= LONGEST:
                    self.known[int(keys[i])] = n
        return np.array(found, dtype=np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's own encoder of a vocabulary; it and its cache outlive a task."""
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    if name not in _encoders:
        _encoders[name] = Encoder(vocabulary)
    return _encoders[name]


def count_block(block: texts.Block, frequent: Lengths, words: Encoder) -> np.ndarray:
    """Tokens of each text of a block."""
    w = texts.words(block, lower=False)
    count, known = frequent.find(w.hash)
    late = np.flatnonzero(~known)
    if len(late):
        keys, first, which = np.unique(w.hash[late], return_index=True, return_inverse=True)
        count[late] = words.look_up(keys, block, w.start[late[first]], w.end[late[first]])[which]
    return np.bincount(w.row, weights=count, minlength=block.rows).astype(np.int64)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent words with their counts, SUMMARY at most."""
    seen: dict[bytes, int] = {}
    most = lambda: dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY])
    for batch in batches:
        for block in texts.blocks(batch.column(0)):
            w = texts.words(block, lower=False)
            _, first, count = np.unique(w.hash, return_index=True, return_counts=True)
            often = (count > 1) & (w.end[first] - w.start[first] <= LONGEST)
            for s, e, n in zip(w.start[first[often]].tolist(), w.end[first[often]].tolist(), count[often].tolist(), strict=True):
                word = block.data[s:e].tobytes()
                seen[word] = seen.get(word, 0) + n
            if len(seen) > 8 * SUMMARY:
                seen = most()
    seen = most()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[bytes]:
    """The most frequent words of docs.text, as told by the tasks' summaries; `most` at most reach the driver."""
    summaries = docs.select("text").mapInArrow(_summary, "word binary, n long")
    top = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [bytes(row.word) for row in top.collect()]


def lengths(words: list[bytes], vocabulary: str) -> Lengths:
    """The table of the words' counts."""
    if not words:
        return Lengths(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    (block,) = texts.blocks(pa.array([" ".join(w.decode() for w in words)]), most=1 << 40)
    counts = encoder(vocabulary).counts([w.decode() for w in words])
    return Lengths(texts.words(block, lower=False).hash, np.array(counts, dtype=np.int64))


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read by the driver; it travels to the tasks, so no executor needs the path."""
    if os.path.getsize(path) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has more than {MOST_VOCABULARY_BYTES} bytes")
    with open(path, encoding="utf-8") as file:
        return file.read()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) for every row of docs (doc_id, text).

    path: a vocabulary file of the tokenizers library whose tokens never span white space. Strings of special tokens inside of texts
    count as the library takes them by default, as one token. Null text counts as empty: no bytes, no tokens. Each row is counted by itself,
    so repeated rows get equal results and an empty table an empty one; other columns are not read.
    """
    context, vocabulary = docs.sparkSession.sparkContext, read_vocabulary(path)
    sent = context.broadcast((vocabulary, lengths(frequent_words(docs), vocabulary)))
    read = docs.select("doc_id", "text")
    schema = read.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, frequent = sent.value
        words = encoder(vocabulary)
        for batch in batches:
            parts = [(np.diff(b.bounds), count_block(b, frequent, words)) for b in texts.blocks(batch.column(1))]
            size, count = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64()), pa.array(count > limit)], names=schema.names)

    return read.mapInArrow(run, schema)
