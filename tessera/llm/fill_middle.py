"""Fill-in-middle: texts cut into lines, two cuts chosen by a digest of doc_id, and the pieces put into another order.

The main work is a chain of pyarrow.compute calls over a batch: texts are split into lists of lines, lists are flattened with the index
of the text they came from, a line's ordinal in its text tells its role (prefix, middle, suffix), lines are filtered by role,
lists rebuilt per text and joined to pieces. Every text is transformed by itself, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the three pieces.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are transformed at all, and of these the percent whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7
#: Bytes of text that go through the chain at once (a longer text alone).
SLICE_BYTES = 4 << 20


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of the text column; row by row where texts are longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        done = int(ends[row - 1]) if row else 0
        to = max(row + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield batch.slice(row, to - row)
        row = to


def _units(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all texts, each with its break: the flat strings, the text's index and the ordinal in the text of each, and lines per text."""
    lists = pc.split_pattern(text, "\n")
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    count = pc.list_value_length(lists).to_numpy().astype(np.int64)
    start = np.cumsum(count) - count
    ordinal = np.arange(len(flat)) - start[parent]
    last = ordinal == count[parent] - 1
    unit = pc.if_else(pa.array(last), flat, pc.binary_join_element_wise(flat, _mark("\n"), _mark("")))
    real = ~last | (pc.binary_length(flat).to_numpy() > 0)  # what follows the last break is a line only if there is something
    kept = pa.array(real)
    return pc.filter(unit, kept), parent[real], ordinal[real], np.bincount(parent[real], minlength=len(text))


def _mark(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _piece(unit: pa.Array, parent: np.ndarray, role: np.ndarray, rows: int) -> pa.Array:
    """The lines that have the role, joined per text."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(parent[role], minlength=rows))])
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pc.filter(unit, pa.array(role))), _mark(""))


def _rearranged(batch: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    """batch: doc_id, text (no nulls), h1 to h4."""
    text = batch.column(1).cast(pa.large_string())
    h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
    unit, parent, ordinal, n = _units(text)
    low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    roles = ordinal < low[parent], (ordinal >= low[parent]) & (ordinal < high[parent]), ordinal >= high[parent]
    prefix, middle, suffix = (_piece(unit, parent, role, len(text)) for role in roles)
    marked = pc.match_substring_regex(text, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False)
    plain = pa.array((n == 0) | marked | (h3 % 100 >= rate))
    spm = pa.array(h4 % 100 < suffix_first)
    join = lambda *parts: pc.binary_join_element_wise(*parts, _mark(""))
    moved = pc.if_else(spm, join(_mark(SUFFIX), suffix, _mark(PREFIX), prefix, _mark(MIDDLE), middle), join(_mark(PREFIX), prefix, _mark(SUFFIX), suffix, _mark(MIDDLE), middle))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    form = pc.if_else(plain, pa.scalar("plain"), pc.if_else(spm, pa.scalar("spm"), pa.scalar("psm")))
    arrays = [batch.column(0), pa.array(n, pa.int64()), form, *chars, pc.if_else(plain, text, moved).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _numbers(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rearranged(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output for every row of docs (doc_id, text).

    Null text counts as empty; empty texts and those that hold one of the marks stay as they are (form plain, no piece lengths). A null
    doc_id draws its cuts from the seed alone. Rows are transformed each by itself: repeated rows give equal results, cuts may fall
    together and leave an empty middle, and an empty table gives an empty result. Other columns are not read.
    """
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_numbers(F.col("doc_id"), seed))
    schema = read.select("doc_id").schema
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                yield _rearranged(part, rate, suffix_first)

    return read.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Pieces hold no mark, and no end of a piece can start one, so the first of each mark is it."""
    body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    middle = F.substring_index(output, MIDDLE, -1)
    between = lambda first, then: F.substring_index(F.substring_index(output, first, -1), then, 1)
    psm = F.concat(F.substring_index(body, SUFFIX, 1), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, F.substring_index(body, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(moved: DataFrame) -> DataFrame:
    """The result of rearranged with digests in place of the output: of itself, and of the text restored from it."""
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
