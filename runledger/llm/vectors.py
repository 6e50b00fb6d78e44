"""Blocks of vectors: bounded groups of rows, and their meeting with a stated set of queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import stored

#: Components of a part of the queries (8 bytes each), of the parts broadcast at a time, and most tasks that build blocks.
PART, TURN, MOST_TASKS = 1 << 17, 1 << 21, 4096


def usable(vector: Column, zero: bool) -> Column:
    """Whether a vector has components and all of them are finite; ``zero`` allows the zero vector."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & (F.lit(True) if zero else F.exists(vector, lambda x: x != 0)), F.lit(False))


def rows_of(table: DataFrame, id: str, vector: str, zero: bool) -> DataFrame:
    """Usable rows as ``vec_id``, ``vec`` (doubles), ``dim`` and ``row``, a number that tells equal rows apart.

    Written, so that the numbers are the same for all that reads them.
    """
    vec = F.col(vector).cast("array<double>")
    rows = table.where(F.col(id).isNotNull() & usable(vec, zero)).select(F.col(id).cast("long").alias("vec_id"), vec.alias("vec"))
    return stored(rows.select("vec_id", "vec", F.size("vec").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")


def in_blocks(rows: DataFrame, number: Column, cells: int, content: Column, name: str) -> DataFrame:
    """One row (dim, ``name``, items) for about ``cells`` components of vectors; ``number`` spreads rows evenly.

    Each block is some work for a task of its own, so the number of tasks is stated.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("long")), F.lit(0))).first()
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(float(n)) * F.col("dim") / cells))
    dealt = rows.select("dim", F.pmod(F.xxhash64(number), blocks).cast("int").alias(name), content.alias("item"))
    tasks = min(MOST_TASKS, 2 * max(1, -(-total // cells)))
    return dealt.repartition(tasks, "dim", name).groupBy("dim", name).agg(F.collect_list("item").alias("items"))


def meeting(blocks: DataFrame, queries: DataFrame, content: Column) -> DataFrame:
    """Every row of ``blocks`` with every part of the queries of its dimension, as the column ``queries``.

    A stated query set against all rows, in blocks: only queries travel. They lie in parts
    of about ``PART`` components, and about ``TURN`` components are broadcast at a time,
    so that what is broadcast does not grow with the input, only the number of turns does.
    """
    parts = stored(in_blocks(queries, F.col("row"), PART, content, "part"), "query_parts").withColumnRenamed("items", "queries")
    cells = parts.agg(F.coalesce(F.sum(F.size("queries") * F.col("dim").cast("long")), F.lit(0))).first()[0]
    turns = max(1, -(-cells // TURN))
    turn = F.pmod(F.xxhash64("dim", "part"), F.lit(turns))
    met = [blocks.join(F.broadcast(parts.where(turn == t)), "dim") for t in range(turns)]
    return reduce(DataFrame.unionByName, met)


def matrix(items: pa.Array, dim: int) -> np.ndarray:
    """The ``vec`` fields of a list of structs as a matrix of doubles."""
    return np.asarray(items.field("vec").flatten(), np.float64).reshape(-1, dim)
