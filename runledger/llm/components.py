"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from runledger.llm.common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and three numbers that tell whether a round still changed them, taken as it is written."""
    state = Observation()
    table = stored(edges.observe(state, F.count("*").alias("edges"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("down"),
                                 F.sum(F.xxhash64("b", "a") % 998_244_353).alias("up")), "edges")
    return table, tuple(state.get.get(name) for name in ("edges", "down", "up"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node reachable, for every end of ``edges`` (a, b).

    Rounds of large star and small star: each node hands its larger neighbours, then
    its smaller ones, to the least node it knows, until only stars are left. A hub
    with very many edges costs one aggregate row for each task and a join that
    adaptive execution can split; the number of rounds grows with the logarithm of
    the longest chain. Each round is a written table.
    """
    edges, before = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        near = _both(edges)
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lower, "a")
        edges, now = _written(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                              .unionByName(lower.withColumnRenamed("m", "b")).distinct())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
