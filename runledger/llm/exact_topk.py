"""Operator 10, exact top-k search with multi-resolution segment statistics.

The inner product of two segments of length l is at most l * (m m' + s s') with their
means and deviations, so sums over segments bound the score of a pair from above,
which bounds its distance (the negative score) from below.

* A block of data is centred and turned by its own orthogonal basis, largest variance
  first. Inner products stay: <q, x> is <q, centre> plus the product of the turned rests. Segments
  are short where the variance lies and longer behind.
* Bounds are taken coarse to fine. The first resolution is the norm of the rest and
  discards whole queries for a block. At each resolution the candidates with the best bounds are scored
  exactly to raise the k-th best score, the floor; pairs whose bound lies below it fall out, finer bounds are only
  taken for queries and rows that are left, and only survivors of the finest resolution are scored.
* Floors are shared: one pilot block of each dimension is searched first, and its k-th best
  scores are the floors with which queries come to all other blocks.

Only queries travel to the blocks. Every block gives at most k rows for each query, which are merged.

Components are floor(scale * x). Scores are exact integers; beyond 2^53 they are computed with
Python integers and cut to the range of a long. Ties go to the smaller id. Vectors that are null or hold null or
non-finite components take no part, nor rows with a null id; vectors only meet others of their
dimension. A repeated row is a candidate of its twin. A query with fewer candidates than
k gets them all. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import stored
from runledger.llm.vectors import in_blocks, matrix, meeting, rows_of

#: Components of a data block, queries compared in one go, and segments of each resolution.
DATA, BLOCK, LEVELS = 1 << 18, 256, (1, 4, 16, 64)
#: Longest vectors whose blocks are turned; longer ones are only centred.
TURNED = 1024
EXACT = float(1 << 53)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of its length; segments grow along the vector."""
    dim = vectors.shape[1]
    starts = np.unique(np.arange(segments) ** 2 * dim // segments ** 2)
    root = np.sqrt(np.diff(np.append(starts, dim)))
    mean = np.add.reduceat(vectors, starts, 1) / root
    square = np.add.reduceat(vectors * vectors, starts, 1) - mean * mean
    return np.concatenate([mean, np.sqrt(np.maximum(square, 0))], 1)


def _exact(queries: np.ndarray, data: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of the pairs (q[i], c[i])."""
    out = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = np.einsum("nd,nd->n", queries[q[some]], data[c[some]])
    return out


def _kth(bounds: np.ndarray, mask: np.ndarray, queries: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score among the candidates with the best bounds; -inf with fewer than k."""
    shown = np.where(mask, bounds, -np.inf)
    k_ = min(k, shown.shape[1])
    best = np.argpartition(-shown, k_ - 1, 1)[:, :k_]
    q = np.repeat(np.arange(len(queries)), k_)
    score = np.where(np.take_along_axis(mask, best, 1), _exact(queries, data, q, best.ravel()).reshape(-1, k_), -np.inf)
    return np.full(len(queries), -np.inf) if k_ < k else score.min(1)


class Block:
    """A data block, centred and turned, with its statistics at every resolution."""

    def __init__(self, data: np.ndarray):
        self.data, self.centre = data, data.mean(0)
        rest = data - self.centre
        self.basis = np.linalg.eigh(rest.T @ rest)[1][:, ::-1] if data.shape[1] <= TURNED else None
        turned = self.turn(rest)
        self.statistics = [statistics(turned, s) for s in LEVELS]
        self.norm = np.sqrt((data ** 2).sum(1).max(initial=0)) + np.sqrt((rest ** 2).sum(1).max(initial=0))

    def turn(self, vectors: np.ndarray) -> np.ndarray:
        return vectors if self.basis is None else vectors @ self.basis


def best_pairs(queries: np.ndarray, block: Block, allowed: np.ndarray, k: int, ids: np.ndarray, floor: np.ndarray,
               left: list[float] | None = None) -> tuple[np.ndarray, ...]:
    """Positions (query, row) and scores of the best k allowed rows of each query that reach its ``floor``.

    ``left`` receives the share of the pairs that is left after each resolution.
    """
    mask, floor, data = allowed.copy(), floor.copy(), block.data
    at_centre, turned = queries @ block.centre, block.turn(queries)
    slack = 1e-9 * np.sqrt((queries ** 2).sum(1)) * block.norm + 1e-9
    for segments, of_data in zip(LEVELS, block.statistics):
        rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if len(rows):
            some, some_data, here = queries[rows], data[columns], mask[np.ix_(rows, columns)]
            bounds = at_centre[rows, None] + statistics(turned[rows], segments) @ of_data[columns].T
            floor[rows] = np.maximum(floor[rows], _kth(bounds, here, some, some_data, k))
            mask[np.ix_(rows, columns)] = here & (bounds >= (floor - slack)[rows, None])
        if left is not None:
            left.append(float(mask.sum() / max(1, allowed.sum())))
    q, c = np.nonzero(mask)
    score = np.concatenate([np.empty(0), *(data[np.flatnonzero(mask[i])] @ queries[i] for i in np.unique(q))])
    high = score >= floor[q]
    q, c, score = q[high], c[high], score[high]
    order = np.lexsort((ids[c], -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    keep = np.arange(len(q)) - first[q] < k
    return q[keep], c[keep], score[keep]


def _best_big(queries: np.ndarray, data: np.ndarray, allowed: np.ndarray, k: int, ids: np.ndarray) -> tuple[list, ...]:
    """The same with Python integers, for components whose products a double can't hold."""
    whole = [[int(x) for x in v] for v in data]
    out = []
    for q, vector in enumerate(queries):
        mine = [int(x) for x in vector]
        scores = [(-sum(a * b for a, b in zip(mine, whole[c])), ids[c], c) for c in np.flatnonzero(allowed[q])]
        out += [(q, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, _, c in sorted(scores)[:k]]
    return tuple(map(list, zip(*out))) if out else ([], [], [])


def search(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` highest inner products of each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = rows_of(table, id, vector, zero=True).withColumn("vec", F.transform("vec", lambda x: x * scale))
    data = stored(in_blocks(rows, F.col("row"), DATA, F.struct("vec_id", "row", "vec"), "block"), "data_blocks")
    asked = rows.where(is_query)

    def run(batches):
        for batch in batches:
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                here, every = (batch.column(x).slice(i, 1).flatten() for x in ("items", "queries"))
                data = np.floor(matrix(here, dim))
                ids, id_rows = (np.asarray(here.field(x)) for x in ("vec_id", "row"))
                block = None
                for at in range(0, len(every), BLOCK):
                    asked = every.slice(at, BLOCK)
                    wanted, floor = np.floor(matrix(asked, dim)), np.asarray(asked.field("floor"))
                    query_ids, query_rows = (np.asarray(asked.field(x)) for x in ("vec_id", "row"))
                    allowed = query_rows[:, None] != id_rows[None, :]
                    small = dim * float(np.abs(data).max()) * float(np.abs(wanted).max()) < EXACT
                    if small:
                        block = block or Block(data)
                        q, c, score = best_pairs(wanted, block, allowed, k, ids, floor)
                    else:
                        q, c, score = _best_big(wanted, data, allowed, k, ids)
                    q, c = np.asarray(q, np.int64), np.asarray(c, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(query_ids[q]), pa.array(query_rows[q]), pa.array(ids[c]), pa.array(id_rows[c]),
                         pa.array(score.astype(np.int64) if small else score, pa.int64())], ["query_id", "query_row", "vec_id", "row", "score"])

    def found(blocks: DataFrame, queries: DataFrame) -> DataFrame:
        return meeting(blocks, queries, F.struct("vec_id", "row", "vec", "floor")).select("dim", "items", "queries").mapInArrow(
            run, "query_id long, query_row long, vec_id long, row long, score long")

    lowest = F.lit(float("-inf"))
    pilot = stored(found(data.where("block = 0"), asked.withColumn("floor", lowest)), "pilot")
    floors = pilot.groupBy(F.col("query_row").alias("row")).agg(
        F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    floored = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", lowest))
    every = pilot.unionByName(found(data.where("block > 0"), floored))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
