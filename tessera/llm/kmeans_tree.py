"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into a leaf. A query takes leaves off a priority queue,
nearest center first, and visits as many as the calibration asks for: exact neighbours of some queries, found by brute force over
all vectors, tell how many visits reach the recall wanted. Leaves are split into cells of bounded size; a task holds one
cell and streams the queries that visit it, so neither vectors nor queries of a leaf need fit into memory. Every query visits
its first leaves in one round; in a second round, each further leaf only sends what is as good as the k-th hit so far, so
hits don't multiply with visits.

Largest inner products are nearest neighbours after one more coordinate, sqrt(M^2 - |x|^2) for vectors (M: the largest
norm) and 0 for queries; the tree lives in that space, scores are inner products of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.shared import stage

#: Vectors that the tree is fitted on: so many a leaf, at least and at most; queries that calibrate it, at most.
PER_LEAF, SAMPLE, MOST_SAMPLE, PROBES = 64, 16_384, 262_144, 256
BRANCHES, ROUNDS, RESTARTS = 8, 8, 3
#: One leaf to so many rows. The tree travels to the tasks, so its leaves end at MOST_LEAVES: beyond LEAF_ROWS * MOST_LEAVES
#: vectors leaves grow, and are split into cells.
LEAF_ROWS, MOST_LEAVES = 1000, 16_384
CELL_ROWS = 4096
#: Leaves of the first round of a search; later leaves only send what beats its k-th score.
FIRST_VISITS = 4
RECALL = 0.97
#: Rounding of a matrix product, in units of the last place times components and norms; candidates this close to the last place are scored again one by one.
SLACK = 8 * np.finfo(np.float64).eps


@dataclass
class Tree:
    center: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)  # number of the leaf, -1 for inner nodes

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of x, always to the nearest child."""
        out, work = np.empty(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if self.leaf[node] >= 0 or not len(rows):
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            near = distances(x[rows], self.center[kids]).argmin(axis=1)
            work += [(kid, rows[near == k]) for k, kid in enumerate(kids)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first walk."""
        far = ((self.center - query) ** 2).sum(axis=1)
        queue, out = [(far[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            else:
                for kid in self.children[node]:
                    heapq.heappush(queue, (far[kid], kid))
        return out


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers**2).sum(axis=1) - 2 * x @ centers.T  # but for a constant per row


def k_means(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Group of each row, the tightest of RESTARTS runs; some groups may be empty."""
    groups, least = np.zeros(len(x), dtype=np.int64), np.inf
    for _ in range(RESTARTS):
        centers = x[random.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(ROUNDS):
            group = distances(x, centers).argmin(axis=1)
            size = np.bincount(group, minlength=len(centers))
            sums = np.zeros_like(centers)
            np.add.at(sums, group, x)
            centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers)
        spread = float(distances(x, centers)[np.arange(len(x)), group].sum())
        if spread < least:
            groups, least = group, spread
    return groups


def fit(sample: np.ndarray, leaves: int) -> Tree:
    random, centers, tree = np.random.default_rng(11), [], Tree(np.zeros((0, 0)))
    least = max(1, len(sample) // leaves)

    def grow(x: np.ndarray) -> int:
        node = len(centers)
        centers.append(x.mean(axis=0))
        tree.children.append([])
        tree.leaf.append(-1)
        group = k_means(x, BRANCHES, random) if len(x) > 1.5 * least and (x != x[0]).any() else np.zeros(len(x), dtype=np.int64)
        parts = [x[group == g] for g in np.unique(group)]
        if len(parts) < 2:
            tree.leaf[node] = max(tree.leaf) + 1
        else:
            tree.children[node] = [grow(part) for part in parts]
        return node

    grow(sample)
    tree.center = np.array(centers)
    return tree


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With the coordinate that makes all norms equal to the largest."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None]])


def best(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score) of each query's k best rows, without those of its own id; ties to the smaller id.

    A matrix product picks candidates; those that may be among the k are summed coordinate by coordinate, so equal vectors score equally.
    """
    rough = queries @ x.T
    rough[own[:, None] == ids[None, :]] = -np.inf
    last = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(queries), -np.inf)
    slack = SLACK * x.shape[1] * np.sqrt((queries**2).sum(axis=1)) * np.sqrt((x**2).sum(axis=1).max(initial=0))
    q, r = np.nonzero((rough >= (last - slack)[:, None]) & (rough > -np.inf))
    score = np.zeros(len(q))
    for d in range(x.shape[1]):
        score += queries[q, d] * x[r, d]
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    start = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - start[q] < k
    return q[keep], r[keep], score[keep]


HIT = "query_id long, vec_id long, leaf int, score double"


def _hits(query_ids: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
    q, r, score = found
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(leaf[r].astype(np.int32)), pa.array(score)], names=["query_id", "vec_id", "leaf", "score"])


def top(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Every valid vector of `vectors` (vec_id, embedding) with its leaf, as a staged table."""

    def __init__(self, vectors: DataFrame):
        numbers = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
        fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        valid = numbers.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda v: v != 0))
        sizes = valid.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)).alias("top"))
        row = sizes.orderBy(F.col("n").desc(), F.col("dim")).first()
        self.dim, self.rows, self.top = (row["dim"], row["n"], row["top"]) if row else (0, 0, 0.0)
        if not self.rows:
            return
        self.valid = valid.where(F.size("vec") == self.dim)
        leaves = min(MOST_LEAVES, max(1, self.rows // LEAF_ROWS))
        sample = min(MOST_SAMPLE, max(SAMPLE, PER_LEAF * leaves))
        drawn = self.valid.select(F.xxhash64("vec_id").alias("h"), "vec").orderBy("h").limit(sample).select("vec").toArrow()
        self.tree = fit(lifted(matrix(drawn.column(0).combine_chunks(), self.dim), self.top), leaves)
        self.placed = stage(self.valid.mapInArrow(self._place, "vec_id long, leaf int, vec array<double>"), "placed")

    def _place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = self.tree.assign(lifted(matrix(batch.column(1), self.dim), self.top))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), batch.column(1)], names=["vec_id", "leaf", "vec"])

    def __getstate__(self) -> dict:  # what tasks need
        return {k: getattr(self, k) for k in ("dim", "top", "tree")}

    def exact(self, probes: pa.Table, k: int) -> DataFrame:
        """Brute force for a few queries: every task compares all of them with its vectors."""
        own, queries, dim = probes.column(0).to_numpy(), matrix(probes.column(1).combine_chunks(), self.dim), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                yield _hits(own, best(queries, own, matrix(batch.column(2), dim), ids, k), ids, batch.column(1).to_numpy())

        return top(self.placed.mapInArrow(run, HIT), k)

    def calibrated(self, queries: DataFrame, k: int, recall: float) -> int:
        """Leaf visits that find `recall` of the exact neighbours of some queries, widened one leaf at a time."""
        probes = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBES).select("query_id", "vec").toArrow()
        if not probes.num_rows:
            return 1
        truth = self.exact(probes, k).select("query_id", "leaf").toArrow()
        leaf_of = dict[int, list[int]]()
        for q, leaf in zip(*(c.to_pylist() for c in truth.columns), strict=True):
            leaf_of.setdefault(q, []).append(leaf)
        at_visit = np.zeros(self.tree.leaves, dtype=np.int64)
        padded = np.hstack([matrix(probes.column(1).combine_chunks(), self.dim), np.zeros((probes.num_rows, 1))])
        for q, vector in zip(probes.column(0).to_pylist(), padded, strict=True):
            place = {leaf: n for n, leaf in enumerate(self.tree.visits(vector, self.tree.leaves))}
            np.add.at(at_visit, [place[leaf] for leaf in leaf_of.get(q, [])], 1)
        found, visits = at_visit[0], 1
        while found < recall * at_visit.sum():
            found, visits = found + at_visit[visits], visits + 1
        return visits

    def search(self, queries: DataFrame, k: int, visits: int) -> DataFrame:
        """query_id, rank, vec_id and score of the k best vectors in the leaves that each query visits."""
        columns = ("query_id", "rank", "vec_id", "score")
        found = top(self._answers(queries.withColumn("floor", F.lit(float("-inf"))), k, 0, min(visits, FIRST_VISITS)), k)
        if visits <= FIRST_VISITS:
            return found.select(*columns)
        found = stage(found, "first-hits")
        floors = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        asking = queries.join(floors, "query_id", "left").fillna(float("-inf"), ["floor"])
        return top(found.drop("rank").unionByName(self._answers(asking, k, FIRST_VISITS, visits)), k).select(*columns)

    def _answers(self, queries: DataFrame, k: int, skip: int, visits: int) -> DataFrame:
        """Hits of queries (query_id, vec, floor) in the leaves that each visits from place `skip` up to `visits`: k of a cell at most, none below its floor."""
        tree, dim = self.tree, self.dim
        sizes = self.placed.groupBy("leaf").agg(F.count("*").alias("n"))
        cells = np.ones(tree.leaves, dtype=np.int64)
        for leaf, n in sizes.collect():  # at most MOST_LEAVES, give or take the tree's branches
            cells[leaf] = -(-n // CELL_ROWS)
        first = np.concatenate([[0], np.cumsum(cells)])

        def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, rows, cell = matrix(batch.column(1), dim), [], []
                for n, vector in enumerate(np.hstack([vectors, np.zeros((len(vectors), 1))])):
                    own = np.concatenate([np.arange(first[leaf], first[leaf + 1]) for leaf in tree.visits(vector, visits)[skip:]])
                    rows.append(np.full(len(own), n)), cell.append(own)
                    if sum(map(len, rows)) > 20_000 or n + 1 == len(vectors):
                        at = pa.array(np.concatenate(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.ones(len(at), dtype=np.int32)), *(batch.column(c).take(at) for c in range(3))], names=["cell", "asks", "id", "vec", "floor"])
                        rows, cell = [], []

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                part = (texts_mix(ids) % cells[leaf].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + part), pa.array(np.zeros(len(ids), dtype=np.int32)), batch.column(0), batch.column(2), pa.array(np.zeros(len(ids)))], names=["cell", "asks", "id", "vec", "floor"])

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by cell, a cell's vectors before the queries that visit it."""
            now, ids, vectors = -1, [], []
            for batch in batches:
                cell, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                id_, vec, floor = batch.column(2).to_numpy(), matrix(batch.column(3), dim), batch.column(4).to_numpy()
                edges = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
                for s, e in zip([0, *edges], [*edges, len(cell)], strict=True):
                    if s == e:
                        continue
                    if cell[s] != now:
                        now, ids, vectors = cell[s], [], []
                    if not asks[s]:
                        ids.append(id_[s:e]), vectors.append(vec[s:e])
                    elif ids:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                        for at in range(s, e, 256):
                            to = min(e, at + 256)
                            q, r, score = best(vec[at:to], id_[at:to], vectors[0], ids[0], k)
                            good = score >= floor[at:to][q]
                            yield _hits(id_[at:to], (q[good], r[good], score[good]), ids[0], np.zeros(len(ids[0])))

        shape = "cell long, asks int, id long, vec array<double>, floor double"
        both = self.placed.mapInArrow(held, shape).unionByName(queries.select("query_id", "vec", "floor").mapInArrow(to_cells, shape))
        return both.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(answer, HIT)


def texts_mix(ids: np.ndarray) -> np.ndarray:
    from tessera.llm.texts import mix

    return mix(ids.astype(np.uint64) + np.uint64(1))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row of vectors (vec_id, embedding) whose vec_id is divisible by `every`.

    Nearest is the largest inner product, ties to the smaller vec_id. A row with a null or zero vector, with null or
    not finite components, without vec_id, or with another number of components than most rows takes no part. Rows that
    share a query's vec_id are its own and no candidates; repeated rows under another id are candidates each, a repeated query asks once. Fewer candidates than k are returned all, no vectors give no rows;
    other columns are not read.
    """
    index = Index(vectors)
    if not index.rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = stage(index.placed.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    return index.search(queries, k, index.calibrated(queries, k, recall))
