"""Exact top-k by inner product as a Voronoi join.

Vectors are dealt to the nearest of some pivots, drawn from the data. A cell's summary is its count, its radius R, the largest
distance to the pivot p, and the largest length L; for any x of the cell q.p - |q| R <= q.x <= min(q.p + |q| R, |q| L). A query is first
held against the cells that promise most and hold k vectors together. The k-th score that it finds there bounds its answer
from below, closer than summaries can, and only cells whose upper bound reaches it are searched too. A large cell is cut
into slices; a slice's vectors lie in one task, once, and the queries that need the cell stream past it. The k best of a
query's slices are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Pivots (at most; else the square root of the vectors), queries that are multiplied together, and vectors in a slice: they bound the driver's table and a task's memory.
PIVOTS, GROUP, SLICE = 1024, 64, 16_384


def whole_components(c: str, factor: int = 1024) -> Column:
    """floor(factor * x) of each component; null where the vector is null or holds a null or a non-finite one."""
    bad = F.exists(F.col(c), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(c).isNotNull() & ~bad, F.transform(F.col(c), lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of int64; shorter ones are padded with zeros."""
    flat = np.asarray(column.flatten(), np.int64)
    n = np.diff(column.offsets.to_numpy())
    if len(n) and (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.arange(dim) < n[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: doubles where no sum can leave their whole numbers, else 64-bit integers."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _bounds(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """[query, cell]: the least and the greatest score that a cell's vectors may have."""
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))[:, None]
    mid = queries.astype(np.float64) @ pivots.T
    slack = norm * radius * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))
    high = mid + slack
    if longest is not None:
        high = np.minimum(high, norm * longest * (1 + 1e-9) + 1e-6)
    return mid - slack, high


def needed_cells(queries: np.ndarray, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int, own: int = 1, least: np.ndarray | None = None, longest: np.ndarray | None = None) -> np.ndarray:
    """[query, cell] True where the cell may hold one of the query's k best. Up to `own` rows of the query may be in the count, so k + own are asked for.

    least: scores that k other rows of each query are known to reach.
    """
    low, high = _bounds(queries, pivots, radius, longest)
    order = np.argsort(-low, axis=1)
    held = np.cumsum(count[order], axis=1) >= k + own
    at = np.where(held.any(axis=1), held.argmax(axis=1), low.shape[1] - 1)
    bound = np.take_along_axis(np.take_along_axis(low, order, axis=1), at[:, None], axis=1)
    bound[~held.any(axis=1)] = -np.inf
    if least is not None:
        bound = np.maximum(bound, least[:, None])
    return (high >= bound) & (count > 0)


def first_cells(queries: np.ndarray, pivots: np.ndarray, count: np.ndarray, k: int, own: int = 1) -> np.ndarray:
    """[query, cell] True for the cells of the nearest pivots, by inner product, that hold k + own vectors together."""
    order = np.argsort(-(queries.astype(np.float64) @ pivots.T), axis=1, kind="stable")
    before = np.cumsum(count[order], axis=1) - count[order]
    out = np.zeros(order.shape, bool)
    np.put_along_axis(out, order, before < k + own, axis=1)
    return out & (count > 0)


def _solved(slices: DataFrame, posed: DataFrame, dim: int, k: int, group: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in each slice of the cells that it is posed to.

    slices: cell, s, vec_id, x; posed: cell, s, query_id, x. A slice's vectors come first and are held; queries stream past them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            cell, s, query = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            runs = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (s[1:] != s[:-1]) | (query[1:] != query[:-1])))
            for low, high in zip(runs, np.append(runs[1:], b.num_rows)):
                part = b.column(3).to_numpy()[low:high], np.frombuffer(b"".join(b.column(4).slice(low, high - low).to_pylist()), np.int64).reshape(-1, dim)
                if (cell[low], s[low]) != now:
                    now, parts = (cell[low], s[low]), []
                if not query[low]:
                    parts.append(part)
                    continue
                if not parts:
                    continue  # no vector lies in this slice
                if len(parts) > 1:
                    parts = [tuple(np.concatenate(c) for c in zip(*parts))]
                ids, x = parts[0]
                yield from answers(*part, ids, x)
        shared.release_memory()

    def answers(qs: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low in range(0, len(qs), group):
            for qid, scores in zip(qs[low : low + group], _products(q[low : low + group], x)):
                other = np.flatnonzero(ids != qid)
                best = other[_best(scores[other], ids[other], k)]
                got.append((np.full(len(best), qid), ids[best], scores[best]))
        yield pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*got)], names=["query_id", "vec_id", "score"])

    both = slices.select("cell", "s", F.lit(False).alias("query"), F.col("vec_id").alias("id"), "x").union(posed.select("cell", "s", F.lit(True), "query_id", "x"))
    return both.repartition("cell", "s").sortWithinPartitions("cell", "s", "query").mapInArrow(run, "query_id long, vec_id long, score long")


def _k_best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class Cells:
    """vectors (vec_id, v, asks) dealt to cells; `dealt` is written, summaries are on the driver, a row for each pivot."""

    def __init__(self, vectors: DataFrame, pivots: int, slice_rows: int):
        n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
        self.n, self.dim = n, dim = n, max(dim or 0, 1)
        # Pivots are the first rows by hash: at most `pivots` of them, whatever the table.
        drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(int(max(1, min(pivots, n**0.5)))).select("v").collect()
        centre = np.zeros((len(drawn), dim))
        for i, r in enumerate(drawn):
            centre[i, : len(r[0])] = r[0]
        self.centre = centre = np.unique(centre, axis=0)
        square = (centre**2).sum(axis=1)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    x = _matrix(b.column(1).slice(at, 4096), dim)
                    cell = (square - 2 * x.astype(np.float64) @ centre.T).argmin(axis=1)
                    far, size = np.sqrt(((x - centre[cell]) ** 2).sum(axis=1)), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
                    yield pa.record_batch([b.column(0).slice(at, 4096), pa.array([y.tobytes() for y in x], pa.binary()), b.column(2).slice(at, 4096), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(size)], names=["vec_id", "x", "asks", "cell", "far", "size"])

        self.dealt = dealt = shared.written(vectors.mapInArrow(deal, "vec_id long, x binary, asks boolean, cell int, far double, size double"), "knn-cells")
        self.count, self.radius, self.longest = (np.zeros(len(centre)) for _ in range(3))
        for c, m, r, size in dealt.groupBy("cell").agg(F.count("*"), F.max("far"), F.max("size")).collect():  # a row for each pivot
            self.count[c], self.radius[c], self.longest[c] = m, r, size
        self.cuts = np.maximum(1, np.ceil(self.count / slice_rows)).astype(int).tolist()
        cuts = F.element_at(F.array(*map(F.lit, self.cuts)), F.col("cell") + 1)
        # Rows are dealt to slices by where they lie, so that equal ones are spread too.
        self.slices = dealt.select("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), cuts).cast("int").alias("s"), "vec_id", "x")
        asks = dealt.where("asks").groupBy("vec_id").agg(F.min("x").alias("x"))
        repeats = dealt.groupBy("vec_id").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")).where("asked > 0")
        self.own = repeats.agg(F.max("n")).first()[0] or 1
        self.asks = shared.written(asks.select(F.col("vec_id").alias("query_id"), "x"), "knn-queries")

    def first(self, k: int) -> DataFrame:
        """(query_id, x, cells) that each query is held against first."""
        centre, count, own = self.centre, self.count, self.own
        return self._posed(self.asks.withColumn("least", F.lit(None).cast("double")), lambda q, least: first_cells(q, centre, count, k, own))

    def needed(self, known: DataFrame, k: int) -> DataFrame:
        """(query_id, x, cells) of the other cells that may hold an answer; known: (query_id, least), a score that k rows reach."""
        centre, count, radius, longest, own = self.centre, self.count, self.radius, self.longest, self.own

        def cells(q: np.ndarray, least: np.ndarray) -> np.ndarray:
            return needed_cells(q, centre, radius, count, k, own, least, longest) & ~first_cells(q, centre, count, k, own)

        return self._posed(self.asks.join(known, "query_id", "left"), cells)

    def _posed(self, asks: DataFrame, cells: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    q = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(-1, dim)
                    least = np.array([-np.inf if x is None else x for x in part.column(2).to_pylist()])
                    yield pa.record_batch([part.column(0), part.column(1), pa.array([np.flatnonzero(r).astype(np.int32) for r in cells(q, least)], pa.list_(pa.int32()))], names=["query_id", "x", "cells"])

        return asks.select("query_id", "x", "least").mapInArrow(run, "query_id long, x binary, cells array<int>")

    def solved(self, posed: DataFrame, k: int, group: int) -> DataFrame:
        cuts = F.element_at(F.array(*map(F.lit, self.cuts)), F.col("cell") + 1)
        units = posed.select("query_id", "x", F.explode("cells").alias("cell")).withColumn("s", F.explode(F.sequence(F.lit(0), cuts - 1)))
        return _solved(self.slices, units, self.dim, k, group)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS, group: int = GROUP, slice_rows: int = SLICE) -> DataFrame:
    """vectors (vec_id, v array<long>) to (query_id, rank, vec_id, score): each query's k best other rows, all if fewer.

    Rows with null v or null vec_id take no part. Shorter vectors count as padded with zeros; where all are empty all scores are 0. Rows with
    the query's vec_id are its own and no candidates; several rows with one vec_id ask once (as the least vector) and each is a
    candidate. Ties go to the smaller vec_id. Extra columns are not read. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", is_query.alias("asks")).where("vec_id is not null and v is not null")
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = Cells(rows, pivots, slice_rows)
    near = shared.written(_k_best(cells.solved(cells.first(k), k, group), k), "knn-near")
    # A whole score as a double, rounded down: it may leave a cell too many.
    known = near.where(F.col("rank") == k).select("query_id", (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-12 - 1).alias("least"))
    rest = cells.solved(cells.needed(known, k), k, group)
    return _k_best(near.drop("rank").union(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
