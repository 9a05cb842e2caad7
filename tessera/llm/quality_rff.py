"""A quality classifier on document statistics: random Fourier features, ridge regression, isotonic calibration.

Statistics are counted from the bytes of whole texts. Random cosines of them approximate a Gaussian kernel, so one linear
system of fixed size gives a kernel ridge regression: tasks sum its matrix over their rows and only these sums meet. One
fold of the labelled rows is left out of the system and calibrates its scores, as sums per score bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import texts
from tessera.llm.shared import crc_bucket, stage

FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
#: Labelled rows that the model is fitted on at most, chosen by a hash of doc_id; parts that they are summed in.
MOST_LABELLED, PARTS = 200_000, 16
COSINES, BANDWIDTH, RIDGE = 256, 4.0, 1e-3
CLIP = 6.0
BINS = 2000
THRESHOLD = 0.3


def _set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


#: Classes of bytes whose shares are statistics.
CLASSES = [_set(c) for c in (bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>", b"!?", b".,;:", b"|", b"\"'()[]{}", b"@/\\=+_~^`-", b"\n", bytes(range(128, 256)))]
STATISTICS = len(CLASSES) + 13


def statistics(block: texts.Block) -> np.ndarray:
    """rows x STATISTICS."""
    rows, w = block.rows, texts.words(block)
    size, count = np.diff(block.bounds), w.count.astype(np.float64)
    long = (w.end - w.start).astype(np.float64)
    row, line, filled = texts.lines(block)
    row, line = row[filled], line[filled]
    n_lines = texts.by_row(row, rows)
    per = lambda x: x / np.maximum(count, 1)
    mean = per(np.bincount(w.row, long, rows))
    longest = np.zeros(rows)
    np.maximum.at(longest, w.row, long)
    upper = _set(bytes(range(65, 91)))[block.data[w.start]] if len(w.start) else np.zeros(0, dtype=bool)
    marked = ~(_set(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])))[block.data[w.end - 1]] if len(w.end) else np.zeros(0, dtype=bool)
    columns = [
        *(texts.byte_counts(block, c) / np.maximum(size, 1) for c in CLASSES),
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(per(np.bincount(w.row, long**2, rows)) - mean**2, 0)), np.log1p(longest),
        per(np.bincount(w.row, long <= 3, rows)), per(np.bincount(w.row, upper, rows)), per(np.bincount(w.row, marked, rows)),
        per(texts.distinct_in_row(w.row, w.hash, rows)), per(texts.repeated_words(w, 3, rows)),
        np.log1p(n_lines), (n_lines - texts.distinct_in_row(row, line, rows)) / np.maximum(n_lines, 1), count / np.maximum(n_lines, 1) / 100,
    ]
    return np.column_stack(columns)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in texts.blocks(batch.column(1)):
            x = statistics(block)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(block.rows + 1, dtype=np.int32) * STATISTICS), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), flat], names=["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray | None = None
    edge: np.ndarray | None = None  # raw scores and what they are worth
    worth: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        random = np.random.default_rng(2024)
        along, phase = random.normal(0, 1 / BANDWIDTH, (STATISTICS, COSINES)), random.uniform(0, 2 * np.pi, COSINES)
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / COSINES) * np.cos(z @ along + phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weight, -1.0, 2.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edge, self.worth), 0.0, 1.0)


def _sums(rows: DataFrame, of: callable, size: int) -> np.ndarray:
    """Sum over a table (x, y) of of(x, y), an array of fixed size: every task sums its rows, the driver sums tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column(0)), batch.column(1).to_numpy()).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    parts = rows.select("x", "y").mapInArrow(run, "total array<double>").toArrow().column(0)
    return np.sum([p.values.to_numpy() for p in parts], axis=0) if len(parts) else np.zeros(size)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing means of y (sums over n rows at x, x increasing), at the centers of their blocks."""
    pools: list[list[float]] = []
    for at, total, rows in zip(x, y, n, strict=True):
        pools.append([at * rows, total, rows])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(labelled: DataFrame) -> Model:
    """labelled: a staged table of x, y (0 to 1) and the fold."""
    n = STATISTICS
    moments = _sums(labelled, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x**2).sum(axis=0)]), 2 * n + 1)
    rows = max(1.0, moments[0])
    mean = moments[1 : n + 1] / rows
    scale = np.sqrt(np.maximum(moments[n + 1 :] / rows - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0))
    width = 1 + n + COSINES

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return f.T @ np.column_stack([f, y])

    system = _sums(labelled.where(F.col("fold") != CALIBRATES), equations, width * (width + 1)).reshape(width, width + 1)
    ridge = RIDGE * max(1.0, system[0, 0]) * np.eye(width)
    ridge[0, 0] = 1e-9
    model.weight = np.linalg.lstsq(system[:, :-1] + ridge, system[:, -1], rcond=None)[0]

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        at = np.minimum(((raw + 1) / 3 * BINS).astype(int), BINS - 1)
        return np.column_stack([np.bincount(at, raw, BINS), np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    sums = _sums(labelled.where(F.col("fold") == CALIBRATES), bins, BINS * 3).reshape(BINS, 3)
    if not sums.any():  # no rows in that fold: those of the system calibrate it
        sums = _sums(labelled, bins, BINS * 3).reshape(BINS, 3)
    filled = sums[sums[:, 2] > 0]
    if len(filled):
        model.edge, model.worth = isotonic(filled[:, 0] / filled[:, 2], filled[:, 1], filled[:, 2])
    else:
        model.edge, model.worth = np.zeros(1), np.array([0.5])
    return model


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text), learned from labels (doc_id, quality).

    Labels of rows whose crc32(doc_id as text) modulo 5 is 0 (held out) are never used; a row without doc_id isn't held
    out and has no label. Several labels of one doc_id count as their mean, null ones not at all. Null text counts as
    empty and is scored as such. Without labels every score is 0.5. Repeated rows are scored each; an empty table gives an empty
    result; other columns are not read.
    """
    fold = crc_bucket(F.col("doc_id"), FOLDS, null=FOLDS)
    schema = docs.select("doc_id").schema.add("x", T.ArrayType(T.DoubleType()))
    counted = stage(docs.select("doc_id", "text").mapInArrow(_statistics, schema), "statistics")
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    learned = marks.withColumn("fold", fold).where(F.col("doc_id").isNotNull() & (F.col("fold") != HELD_OUT))
    total = learned.count()
    if total > MOST_LABELLED:
        learned = learned.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * MOST_LABELLED / total))
    # Dealt and sorted by doc_id, so that sums come out alike to the last bit when the query is run again
    known = counted.join(learned, "doc_id").select("doc_id", "x", "y", "fold").repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "x")
    labelled = stage(known.drop("doc_id"), "labelled")
    model = fit(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    scored = counted.mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
