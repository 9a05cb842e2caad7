"""Nearest vectors, matches and best pairs. Cosines are rounded to six digits, so ties and thresholds don't hang on the last bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import tiles as T
from tessera.operators.balls import NOTHING
from tessera.operators.blocks import BLOCK_ROWS, in_cells, matrix

DIGITS = 6
#: Tables of so many blocks are compared whole; larger ones in tiles of packed blocks, with bounds.
FEW_BLOCKS = 4


def dot(a: Column, b: Column) -> Column:
    """Null on unequal lengths or a result that isn't finite."""
    value = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def cosine(a: Column, b: Column, zero: float | None = None) -> Column:
    """Null (or the value given) if a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(zero))


def _cosines(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    x, y = matrix(a["vec"]), matrix(b["vec"])
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    return np.round(np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0), DIGITS)


def _few(rows: int) -> bool:
    return rows <= FEW_BLOCKS * BLOCK_ROWS


def nearest(vectors: DataFrame, k: int = 8) -> DataFrame:
    """The k nearest of every row of vectors (id, vec), itself left out; ties to the smaller id."""

    def keep(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            sim, ids = _cosines(a, b), b["id"].to_numpy()
            for q, row in zip(a["id"].to_numpy(), sim, strict=True):
                order = np.lexsort((ids, -row))
                order = order[ids[order] != q][:k]
                out.append(pd.DataFrame({"query": q, "id": ids[order], "cosine": row[order]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "cosine": []})

    (rows, width), schema = T.measured(vectors), "query long, id long, cosine double"
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("cosine").desc(), "id"))
    best = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k)
    if _few(rows):
        return best(in_cells(vectors, vectors, "id", keep, schema, rows))

    def visit(a: T.Block, others: Iterator[T.Block]) -> Iterator[pa.RecordBatch]:
        top = T.Top(a, k, DIGITS, lambda own, other: own != other)
        for b in others:
            top.see(b)
        return top.batches(["query", "id", "cosine"])

    blocks = T.packed(vectors.select("id", "vec"), rows, width, BLOCK_ROWS)
    return best(T.met(blocks, blocks, visit, schema, BLOCK_ROWS))


def _pairs(a: pd.DataFrame, b: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of two blocks, each pair once with the smaller id first, of at least the cosine given."""
    if not len(a) or not len(b):
        return pd.DataFrame({"a": [], "b": [], "cosine": []})
    sim, x, y = _cosines(a, b), a["id"].to_numpy(), b["id"].to_numpy()
    wanted = sim >= least
    if a["block_a"].iloc[0] == b["block_b"].iloc[0]:
        wanted &= x[:, None] < y[None, :]
    i, j = np.nonzero(wanted)
    return pd.DataFrame({"a": np.minimum(x[i], y[j]), "b": np.maximum(x[i], y[j]), "cosine": sim[i, j]})


PAIR = "a long, b long, cosine double"


def pairs_above(vectors: DataFrame, least: float) -> DataFrame:
    """All pairs (a < b) of vectors (id, vec and others) whose cosine is at least so much; with others, as c_a and c_b, of both."""
    others = [c for c in vectors.columns if c not in ("id", "vec")]
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join([PAIR, *(f"{c}_{n} {kinds[c]}" for n in "ab" for c in others)])

    def listed(i: np.ndarray, j: np.ndarray, cosine: np.ndarray, a: pa.Table, b: pa.Table) -> pa.RecordBatch:
        """The pairs of places, turned so that the smaller id is first."""
        x, y = a["id"].to_numpy()[i], b["id"].to_numpy()[j]
        out, turned = [np.minimum(x, y), np.maximum(x, y), cosine], pa.array(x > y)
        sides = [(a[c].take(i), b[c].take(j)) for c in others]
        picked = [pc.if_else(turned, q, p) for p, q in sides] + [pc.if_else(turned, p, q) for p, q in sides]
        return pa.table([*map(pa.array, out), *picked], names=["a", "b", "cosine", *(f"{c}_{n}" for n in "ab" for c in others)])

    def keep(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        sim, x, y = _cosines(a, b), a["id"].to_numpy(), b["id"].to_numpy()
        same = a["block_a"].iloc[0] == b["block_b"].iloc[0]
        i, j = np.nonzero((sim >= least) & ((x[:, None] < y[None, :]) if same else (x[:, None] != y[None, :])))
        tables = (pa.Table.from_pandas(df[["id", *others]], preserve_index=False) for df in (a, b))
        return listed(i, j, sim[i, j], *tables).to_pandas()

    def visit(a: T.Block, seen: Iterator[T.Block]) -> Iterator[pa.RecordBatch]:
        for b in seen:
            for i, j, score in T.above(a, b, least, DIGITS):
                x, y = a.ids[i], b.ids[j]
                kept = x < y if a.block == b.block else x != y
                yield from listed(i[kept], j[kept], score[kept], a.others, b.others).to_batches()

    rows, width = T.measured(vectors)
    if _few(rows):
        return in_cells(vectors, vectors, "id", keep, schema, rows, once=True)
    return T.met(T.packed(vectors, rows, width, BLOCK_ROWS), None, visit, schema, BLOCK_ROWS)


def best_pairs(vectors: DataFrame, k: int, differ: int | None = None) -> DataFrame:
    """The k best of all pairs (a < b) with their rank, ties to the smaller ids; differ: pairs whose ids are equal div this are left out.

    Every task gives its k best, so what is ranked at last is k rows a task; the k-th score found so far is what its further tiles have to reach.
    """

    def keep(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        pairs = _pairs(a, b, -2.0)
        pairs = pairs[pairs["a"] // differ != pairs["b"] // differ] if differ else pairs
        return pairs.sort_values(["cosine", "a", "b"], ascending=[False, True, True]).head(k)

    def visit(a: T.Block, others: Iterator[T.Block]) -> Iterator[pa.RecordBatch]:
        x, y, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        for b in others:
            bounds = a.bounds(b)
            for p, q in zip(*np.unravel_index(np.argsort(-bounds, axis=None, kind="stable"), bounds.shape), strict=True):
                need = score[k - 1] if len(score) >= k else NOTHING
                if bounds[p, q] < need - a.slack(DIGITS):
                    break
                for i, j, found in T.tile_above(a, p, b, q, need, DIGITS):
                    u, v = a.ids[i], b.ids[j]
                    kept = (u < v if a.block == b.block else u != v) & ((u // differ != v // differ) if differ else True)
                    u, v = u[kept], v[kept]
                    x, y, score = np.append(x, np.minimum(u, v)), np.append(y, np.maximum(u, v)), np.append(score, found[kept])
                    order = np.lexsort((y, x, -score))[:k]
                    x, y, score = x[order], y[order], score[order]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(score)], names=["a", "b", "cosine"])

    (rows, width), order = T.measured(vectors), [F.col("cosine").desc(), "a", "b"]
    if _few(rows):
        found = in_cells(vectors, vectors, "id", keep, PAIR, rows, once=True)
    else:
        found = T.met(T.packed(vectors.select("id", "vec"), rows, width, BLOCK_ROWS), None, visit, PAIR, BLOCK_ROWS)
    return found.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))  # k rows


def with_place(few: DataFrame, order: list) -> DataFrame:
    """A short listing (limited by its caller) with the place of each row."""
    return few.withColumn("place", F.row_number().over(W.orderBy(*order)))


def ordered_pairs(vectors: DataFrame, most: int) -> DataFrame:
    """The first `most` pairs (i < j, in order) of rows numbered by id, with cosine and rank.

    Only rows that reach into the first pairs take part: they are joined on row numbers, not each with each. What one task
    numbers and ranks is bounded by `most`, whatever the table.
    """
    total = vectors.count()
    reach = vectors.select("id").orderBy("id").limit(most + 1)  # the first row alone has most pairs with these
    numbered = vectors.join(reach.withColumn("ord", (F.row_number().over(W.orderBy("id")) - 1).cast("long")), "id")
    before = F.expr(f"ord * {total}L - ord * (ord + 1) div 2")
    firsts = numbered.withColumn("before", before).where((F.col("before") < most) & (F.col("ord") < total - 1))
    last = F.least(F.lit(total - 1), F.col("ord") + most - F.col("before"))
    pairs = firsts.select(F.col("id").alias("a"), F.col("vec").alias("of_a"), "ord", "before", F.explode(F.sequence(F.col("ord") + 1, last)).alias("other"))
    others = numbered.select(F.col("ord").alias("other"), F.col("id").alias("b"), F.col("vec").alias("of_b"))
    scored = pairs.join(others, "other").select((F.col("before") + F.col("other") - F.col("ord")).alias("pair"), "a", "b", F.round(cosine(F.col("of_a"), F.col("of_b")), DIGITS).alias("cosine"))
    return scored.withColumn("rank", F.row_number().over(W.orderBy(F.col("cosine").desc_nulls_last(), "pair")))


def best_before(vectors: DataFrame, threshold: float, asked: DataFrame | None = None) -> DataFrame:
    """For every row, or those asked for (id), the best among rows of smaller id (ties: the smallest id), and whether it is a match."""

    def keep(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "best": [], "cosine": []})
        b = b.sort_values("id")
        sim, ids = _cosines(a, b), b["id"].to_numpy()
        sim[ids[None, :] >= a["id"].to_numpy()[:, None]] = -2
        at = sim.argmax(axis=1)
        ok = sim[np.arange(len(a)), at] > -2
        return pd.DataFrame({"id": a["id"].to_numpy()[ok], "best": ids[at][ok], "cosine": sim[np.arange(len(a)), at][ok]})

    def visit(a: T.Block, others: Iterator[T.Block]) -> Iterator[pa.RecordBatch]:
        best = T.Top(a, 1, DIGITS, lambda own, other: other < own)
        for b in others:
            best.see(b)
        return best.batches(["id", "best", "cosine"])

    (rows, width), schema = T.measured(vectors), "id long, best long, cosine double"
    only = lambda df: df if asked is None else df.join(asked.select("id"), "id", "left_semi")
    top = lambda found: found.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "best")).alias("x"))
    if _few(rows):
        best = top(in_cells(only(vectors), vectors, "id", keep, schema, rows))
    else:
        plain = vectors.select("id", "vec")
        blocks = T.packed(plain, rows, width, BLOCK_ROWS)
        best = top(T.met(blocks if asked is None else T.packed(only(plain), rows, width, BLOCK_ROWS), blocks, visit, schema, BLOCK_ROWS))
    joined = only(vectors.select("id")).join(best, "id", "left").select("id", F.col("x.best").alias("best"), (-F.col("x.minus")).alias("cosine"))
    matched = F.coalesce(F.col("cosine") >= threshold, F.lit(False))
    return joined.select("id", F.when(matched, F.col("best")).alias("match"), "cosine", F.when(matched, "match").otherwise("new").alias("decision"))


def _best_of_names(a: pd.DataFrame, b: pd.DataFrame, least: float, once: bool) -> pd.DataFrame:
    """Of every two names in two blocks the best pair, if it reaches the score, ties to the smaller ids; once: the smaller name first.

    Rows are sorted by name, so the best scores are maxima over rectangles; only pairs that have the best score are looked at one by one.
    """
    if not len(a) or not len(b):
        return pd.DataFrame({"name_a": [], "name_b": [], "id_a": [], "id_b": [], "cosine": []})
    a, b = a.sort_values(["name", "id"]), b.sort_values(["name", "id"])
    na, nb, ia, ib = a["name"].to_numpy(), b["name"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()
    sim = _cosines(a, b)
    sim[na[:, None] == nb[None, :]] = NOTHING
    of_a, of_b = np.flatnonzero(np.diff(na, prepend=na[0] - 1)), np.flatnonzero(np.diff(nb, prepend=nb[0] - 1))
    most = np.maximum.reduceat(np.maximum.reduceat(sim, of_a, axis=0), of_b, axis=1)
    wanted = np.where(most >= least, most, np.inf)
    wide = np.repeat(np.repeat(wanted, np.diff(np.append(of_a, len(na))), axis=0), np.diff(np.append(of_b, len(nb))), axis=1)
    i, j = np.nonzero(sim == wide)
    out = pd.DataFrame({"name_a": na[i], "name_b": nb[j], "id_a": ia[i], "id_b": ib[j], "cosine": sim[i, j]})
    if once:
        turned = out["name_a"] > out["name_b"]
        out.loc[turned, ["name_a", "name_b", "id_a", "id_b"]] = out.loc[turned, ["name_b", "name_a", "id_b", "id_a"]].to_numpy()
    return out.sort_values(["cosine", "id_a", "id_b"], ascending=[False, True, True]).drop_duplicates(["name_a", "name_b"])


def best_between(vectors: DataFrame, threshold: float, per_name: int | None = None, most: int = 200, anchor: int | None = None) -> DataFrame:
    """Of every two names the best pair of vectors (name, id, vec), best pairs first; per_name: only the first so many vectors of a name."""
    first = F.row_number().over(W.partitionBy("name").orderBy("id"))
    few = vectors.withColumn("n", first).where(F.col("n") <= per_name).drop("n") if per_name else vectors
    left = few.where(F.col("name") == anchor) if anchor is not None else few

    def keep(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best_of_names(a, b, threshold, once=anchor is None)

    def visit(a: T.Block, others: Iterator[T.Block]) -> Iterator[pa.RecordBatch]:
        for b in others:
            yield from T.best_of_names(a, b, threshold, DIGITS, once=anchor is None)

    (rows, width), schema = T.measured(few), "name_a long, name_b long, id_a long, id_b long, cosine double"
    if _few(rows):
        found = in_cells(left, few, "id", keep, schema, rows, once=anchor is None)
    else:
        plain = lambda df: T.packed(df.select("id", "name", "vec"), rows, width, BLOCK_ROWS)
        found = T.met(plain(left), None if anchor is None else plain(few), visit, schema, BLOCK_ROWS)
    best = found.groupBy("name_a", "name_b").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "id_a", "id_b")).alias("x"))
    return best.select("name_a", "name_b", "x.id_a", "x.id_b", (-F.col("x.minus")).alias("cosine")).orderBy(F.col("cosine").desc(), "name_a", "name_b").limit(most)
