"""Array transforms and expectations on produced values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.checks import first_failure, holds


def doubled(values: Column) -> Column:
    return F.transform(values, lambda x: x * 2)


def value_expectations(rows: DataFrame, values: str, expected: Sequence[int]) -> DataFrame:
    """Judge each produced array: size, then positive integers, then content."""
    v = F.col(values)
    wanted = F.array(*[F.lit(x) for x in expected]).cast("array<bigint>")
    defect = first_failure(
        (F.size(v) == len(expected), "wrong_count"),
        (F.forall(v, lambda x: holds(x > 0)), "not_positive"),
        (v.cast("array<bigint>") == wanted, "unexpected_values"))
    return rows.withColumn("failed_expectation", defect).withColumn("passed", F.col("failed_expectation").isNull())


def table_expectations(rows: DataFrame, key: Sequence[str], value: str, expected_rows: int) -> DataFrame:
    """The same expectations per group of a long table, folded without lists."""
    return rows.groupBy(*key).agg(
        (F.count("*") == expected_rows).alias("count_ok"),
        F.bool_and(holds(F.col(value) > 0)).alias("all_positive"))
