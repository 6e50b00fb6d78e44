"""The incremental load: gate, clean, upsert, reconcile, move the mark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.operators import transactions as X
from runledger.sources import schemas as S
from runledger.sources import targets
from runledger.sources.tables import read_watermarks, stored_watermark


@dataclass(frozen=True)
class LoadPaths:
    """Where a pipeline keeps its tables; all below one shared folder."""

    root: str
    buckets: int = 64
    #: Turns of the target that stay readable after a load.
    keep_turns: int = 3

    def staging(self, load_id: str) -> str:
        return f"{self.root}/staging/load_id={load_id}"

    @property
    def target(self) -> str:
        return f"{self.root}/reporting"

    def watermark(self, load_id: str) -> str:
        return f"{self.root}/watermark/load_id={load_id}"


def plan_load(raw: DataFrame, target: DataFrame, watermarks: DataFrame, pipeline: str) -> dict[str, DataFrame]:
    """The load as lazy tables, for callers that write (or do not write) them
    themselves: staged rows, new target, outcome and next mark."""
    staged = X.clean(raw, stored_watermark(watermarks, pipeline))
    loaded = X.upsert(target, staged)
    outcome = X.reconcile(X.metrics(staged), X.target_metrics(loaded, staged))
    return {"gate": X.new_data_gate(raw, watermarks, pipeline), "staged": staged, "target": loaded,
            "outcome": outcome, "watermarks": X.next_watermark(watermarks, staged, pipeline)}


def run_load(spark: SparkSession, raw: DataFrame, paths: LoadPaths, watermark_path: str, load_id: str,
             pipeline: str) -> dict:
    """Run one load. Returns status, metrics and the path of the mark to use next.

    Staging is written once and read by every later step. The upsert comes
    before reconciliation, so a mismatch leaves the target changed and the mark
    unmoved; running the same load again is harmless. Upsert and reconciliation
    scan the touched buckets only. One-row results and the numbers of those
    buckets reach the driver.
    """
    watermarks = read_watermarks(spark, watermark_path)
    gate = X.new_data_gate(raw, watermarks, pipeline).first()
    if not gate["has_new"]:
        return {"status": "NO_NEW_DATA", "watermark_path": watermark_path}
    staged = targets.rebuild(X.clean(raw, stored_watermark(watermarks, pipeline)), paths.staging(load_id))
    targets.upsert_target(paths.target, staged, X.KEY, S.TRANSACTIONS_DDL, paths.buckets)
    touched = targets.touched_buckets(staged, X.KEY, paths.buckets)
    target = targets.read_target(spark, paths.target, S.TRANSACTIONS_DDL, touched)
    outcome = X.reconcile(X.metrics(staged), X.target_metrics(target, staged)).first().asDict()
    if outcome["status"] != "PASSED":
        return {**outcome, "watermark_path": watermark_path}
    next_path = paths.watermark(load_id)
    X.next_watermark(watermarks, staged, pipeline).coalesce(1).write.mode("overwrite").parquet(next_path)
    targets.tidy_target(spark, paths.target, paths.keep_turns)
    return {**outcome, "watermark_path": next_path}


def create_pipeline(spark: SparkSession, paths: LoadPaths, pipeline: str, start: str,
                    initial: DataFrame | None = None) -> str:
    """Lay down an empty (or given) target and the first mark; returns its path."""
    empty = spark.createDataFrame([], S.TRANSACTIONS_DDL)
    targets.create_target(empty if initial is None else initial, paths.target, X.KEY, paths.buckets)
    first = paths.watermark("initial")
    mark = spark.range(1).select(F.lit(pipeline).alias("pipeline_name"),
                                 F.lit(start).cast("timestamp").alias("last_processed_at"))
    mark.coalesce(1).write.mode("overwrite").parquet(first)
    return first
