"""Incremental selection, cleaning, upsert and reconciliation of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.sources.tables import stored_watermark

COLUMNS = ("transaction_id", "customer_id", "amount", "status", "transaction_date", "updated_at")
KEY = "transaction_id"


def newer_than(raw: DataFrame, mark: Column) -> DataFrame:
    """Rows strictly after the mark; an unknown mark selects nothing."""
    return raw.where(F.col("updated_at") > mark)


def new_data_gate(raw: DataFrame, watermarks: DataFrame, pipeline: str) -> DataFrame:
    """One row: how many rows arrived since the last load, and whether to go on."""
    pending = newer_than(raw, stored_watermark(watermarks, pipeline))
    return pending.agg(F.count("*").alias("new_rows")).withColumn("has_new", F.col("new_rows") > 0)


def business_rules(raw: DataFrame) -> DataFrame:
    return raw.where((F.col("status") == "COMPLETED") & F.col("amount").isNotNull()
                     & ~F.col("customer_id").like("TEST%"))


def latest_per_key(rows: DataFrame, key: str = KEY, version: str = "updated_at",
                   tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The newest version of every key.

    Spark ranks within map tasks first and ships at most one row per key and
    task, so a key holding a large part of the table costs no more than others.
    """
    newest = Window.partitionBy(key).orderBy(F.col(version).desc(), *[F.col(c).desc() for c in tie_break])
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def clean(raw: DataFrame, mark: Column) -> DataFrame:
    """Rules first, then one row per key: an older completed version outlives
    a newer failed one. Equal times are settled by the remaining columns."""
    kept = business_rules(newer_than(raw, mark)).select(*COLUMNS)
    return latest_per_key(kept, tie_break=("amount", "customer_id", "transaction_date"))


def metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("record_count"),
                    F.coalesce(F.sum("amount"), F.lit(0)).alias("total_amount"))


def target_metrics(target: DataFrame, staged: DataFrame) -> DataFrame:
    """Metrics of the target rows whose key is staged."""
    return metrics(target.select(KEY, "amount").join(staged.select(KEY), KEY))


def upsert(target: DataFrame, staged: DataFrame, key: str = KEY) -> DataFrame:
    """The target after inserting new keys and replacing existing ones; a null key replaces a null key."""
    arriving = staged.select(F.col(key).alias("_arriving"))
    return target.join(arriving, F.col(key).eqNullSafe(F.col("_arriving")), "left_anti").unionByName(
        staged.select(*target.columns))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare two one-row metric tables: count first, then amount."""
    sides = (expected.withColumn("_side", F.lit("expected"))
             .unionByName(actual.withColumn("_side", F.lit("actual"))))

    def pick(side, column):
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    row = sides.agg(pick("expected", "record_count").alias("expected_count"),
                    pick("actual", "record_count").alias("actual_count"),
                    pick("expected", "total_amount").cast("double").alias("expected_amount"),
                    pick("actual", "total_amount").cast("double").alias("actual_amount"))
    return row.withColumn("status", F.when(~F.col("expected_count").eqNullSafe(F.col("actual_count")), "COUNT_MISMATCH")
                          .when(~F.col("expected_amount").eqNullSafe(F.col("actual_amount")), "AMOUNT_MISMATCH")
                          .otherwise("PASSED"))


def next_watermark(watermarks: DataFrame, staged: DataFrame, pipeline: str) -> DataFrame:
    """Move one pipeline's mark to the newest staged row; keep it if none was staged."""
    newest = staged.agg(F.max("updated_at")).scalar()
    return watermarks.withColumn(
        "last_processed_at",
        F.when(F.col("pipeline_name") == pipeline, F.coalesce(newest, F.col("last_processed_at")))
         .otherwise(F.col("last_processed_at")))
