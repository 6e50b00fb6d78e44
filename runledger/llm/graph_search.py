"""Operator 5, nearest neighbours by a robust-pruned directed graph.

Equal vectors become one node that keeps the k + 1 smallest ids, which is all that a
query can return of them. Nodes are dealt to shards of about ``SHARD`` components. A shard is
indexed in one task, batch by batch: greedy beam searches from the medoid propose
neighbours of each point, robust pruning keeps a proposal only if no neighbour
kept before is nearer to it by the factor ``ALPHA``, and reversed edges are pruned
alike. Every shard row holds its vectors and its graph; all queries are
searched in every shard, which stays where it is, with a beam of ``BEAM``, and the shards' answers are merged.

Distances are Euclidean in double precision on the original vectors. The index is
approximate, its scores are exact; ties go to the smaller id. Vectors that are null, zero or have null or non-finite
components take no part, nor rows with a null id; vectors only meet others of
their dimension. A repeated row is a candidate of its twin. A query with
fewer candidates than k gets them all. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import stored
from runledger.llm.vectors import in_blocks, matrix, meeting, rows_of

#: Components of a shard's vectors; edges of a node, beam widths when building and when searching, slack of pruning.
SHARD, DEGREE, BUILD_BEAM, BEAM, ALPHA = 1 << 18, 32, 64, 128, 1.2
#: Queries searched in one go.
BLOCK = 256


def _distances(points: np.ndarray, ids: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of the points ``ids`` (rows of -1 padded lists) to one vector for each row."""
    gap = points[ids] - to[:, None, :]
    found = np.einsum("bnd,bnd->bn", gap, gap)
    found[ids < 0] = np.inf
    return found


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beams of ids and squared distances, nearest first, and the nodes expanded on the way (-1 padded)."""
    n = len(queries)
    ids = np.full((n, width), -1, np.int32)
    ids[:, 0] = start
    near = _distances(points, ids[:, :1], queries)
    near = np.concatenate([near, np.full((n, width - 1), np.inf, near.dtype)], 1)
    fresh, trail = ids >= 0, []
    while (rows := np.flatnonzero(fresh.any(1))).size:
        pick = fresh[rows].argmax(1)  # beams are sorted
        fresh[rows, pick] = False
        step = np.full(n, -1, np.int32)
        step[rows] = ids[rows, pick]
        trail.append(step)
        more = graph[step[rows]]
        more[(more[:, :, None] == ids[rows][:, None, :]).any(2)] = -1
        both = np.concatenate([ids[rows], more], 1)
        far = np.concatenate([near[rows], _distances(points, more, queries[rows])], 1)
        new = np.concatenate([fresh[rows], more >= 0], 1)
        order = np.argsort(far, 1, kind="stable")[:, :width]
        ids[rows], near[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(far, order, 1)
        fresh[rows] = np.take_along_axis(new, order, 1) & (ids[rows] >= 0)
    return ids, near, np.stack(trail, 1) if trail else ids[:, :0]


def robust_prune(points: np.ndarray, of: np.ndarray, proposed: np.ndarray, degree: int, alpha: float, most: int = 96) -> np.ndarray:
    """For each node of ``of`` up to ``degree`` diverse neighbours among its proposals (-1 padded)."""
    proposed = np.where(proposed == of[:, None], -1, proposed)
    order = np.sort(proposed, 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    near = _distances(points, order, points[of])
    rank = np.argsort(near, 1, kind="stable")[:, :most]
    ids, near = np.take_along_axis(order, rank, 1), np.take_along_axis(near, rank, 1)
    own = points[ids]
    square = np.einsum("bnd,bnd->bn", own, own)
    between = square[:, :, None] + square[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
    alive, kept = ids >= 0, np.full((len(of), degree), -1, np.int32)
    every = np.arange(len(of))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        kept[some, k] = ids[every, pick][some]
        alive &= alpha * alpha * between[every, pick] > near
        alive[every, pick] = False
    return kept


def _reverse(points: np.ndarray, graph: np.ndarray, sources: np.ndarray, alpha: float) -> None:
    """Add the edges that point back at ``sources``, pruning nodes that overflow."""
    degree = graph.shape[1]
    to, back = graph[sources].ravel(), np.repeat(sources, degree)
    to, back = to[to >= 0], back[to >= 0]
    order = np.argsort(to, kind="stable")
    nodes, first, count = np.unique(to[order], return_index=True, return_counts=True)
    wide = np.full((len(nodes), count.max(initial=0)), -1, np.int32)
    wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(order)) - np.repeat(first, count)] = back[order]
    for at in range(0, len(nodes), 512):
        some = nodes[at:at + 512]
        graph[some] = robust_prune(points, some, np.concatenate([graph[some], wide[at:at + 512]], 1), degree, alpha)


def build_graph(points: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The neighbours of each point and the start node of searches."""
    n, rng = len(points), np.random.default_rng(0)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    graph[graph == np.arange(n)[:, None]] = -1
    for factor in (1.0, alpha):
        for batch in np.array_split(rng.permutation(n).astype(np.int32), max(1, -(-n // 512))):
            ids, _, trail = beam_search(points, graph, start, points[batch], min(width, n))
            graph[batch] = robust_prune(points, batch, np.concatenate([ids, trail, graph[batch]], 1), degree, factor)
            _reverse(points, graph, batch, factor)
    return graph, start


def index(rows: DataFrame, k: int) -> DataFrame:
    """One row for each shard: ``points``, ``members`` (ids of equal vectors), ``graph`` and ``start``."""
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id", "row"))
    nodes = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vec").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    nodes = stored(nodes.select("vec", F.size("vec").alias("dim"), "members"), "nodes")
    shards = in_blocks(nodes, F.col("vec"), SHARD, F.struct("vec", "members"), "shard")

    def run(batches):
        for batch in batches:
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                items = batch.column("items").slice(i, 1).flatten()
                graph, start = build_graph(matrix(items, dim).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), batch.column("items").slice(i, 1), pa.array([graph.tobytes()], pa.binary()),
                     pa.array([start], pa.int32())], ["dim", "items", "graph", "start"])

    kind = shards.schema["items"].dataType.simpleString()
    return stored(shards.select("dim", "items").mapInArrow(run, f"dim int, items {kind}, graph binary, start int"), "graphs")


def search(table: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest found for each query row.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = rows_of(table, id, vector, zero=False)
    graphs = index(rows, k)

    def run(batches):
        for batch in batches:
            for i, dim in enumerate(batch.column("dim").to_pylist()):
                nodes, every = (batch.column(x).slice(i, 1).flatten() for x in ("items", "queries"))
                points, start = matrix(nodes, dim), batch.column("start")[i].as_py()
                near = points.astype(np.float32)
                graph = np.frombuffer(batch.column("graph")[i].as_py(), np.int32).reshape(len(points), -1)
                members = nodes.field("members").to_pylist()
                for at in range(0, len(every), BLOCK):
                    asked = every.slice(at, BLOCK)
                    wanted = matrix(asked, dim)
                    ids, _, _ = beam_search(near, graph, start, wanted.astype(np.float32), min(BEAM, len(points)))
                    out = []
                    for q, row, beam, vec in zip(asked.field("vec_id").to_pylist(), asked.field("row").to_pylist(), ids, wanted):
                        beam = beam[beam >= 0]
                        score = np.sqrt(((points[beam] - vec) ** 2).sum(1))
                        best = sorted((s, m["vec_id"], m["row"]) for s, p in zip(score.tolist(), beam.tolist()) for m in members[p] if m["row"] != row)
                        out += [(q, row, v, r, s) for s, v, r in best[:k]]
                    columns = zip(*out) if out else [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()])],
                                                     ["query_id", "query_row", "vec_id", "row", "score"])

    found = meeting(graphs, rows.where(is_query), F.struct("vec_id", "row", "vec")).select("dim", "items", "graph", "start", "queries").mapInArrow(
        run, "query_id long, query_row long, vec_id long, row long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
