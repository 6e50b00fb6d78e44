"""Continuous append to the incident history, with a quarantine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.operators.incidents import parse_incidents, redact_incidents
from runledger.sources.incident_store import stored_rules


def append_batch(batch: DataFrame, batch_id: int, json_column: str, path: str, secrets: Iterable[str] = (),
                 **rules) -> None:
    """Write one micro-batch; folders are keyed by batch id, so a replay replaces itself."""
    judged = f"{path}/judged/batch_id={batch_id}"
    parsed = parse_incidents(batch, json_column, **rules).select("incident", F.col("reject_reason").alias("_before"))
    kept = redact_incidents(parsed, secrets, **stored_rules(rules), judged="_before")
    kept.select("incident", "reject_reason").write.mode("overwrite").parquet(judged)
    kept = batch.sparkSession.read.schema(kept.select("incident", "reject_reason").schema).parquet(judged)
    good = kept.where("reject_reason IS NULL").select("incident")
    bad = kept.where("reject_reason IS NOT NULL").select("reject_reason")
    good.write.mode("overwrite").parquet(f"{path}/valid/batch_id={batch_id}")
    bad.write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch_id}")


def run_history_stream(source: DataFrame, json_column: str, path: str, secrets: Iterable[str] = (), **rules):
    secrets = tuple(secrets)
    return (source.writeStream
            .foreachBatch(lambda df, i: append_batch(df, i, json_column, path, secrets, **rules))
            .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start())


def read_history(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/valid").select("incident", F.col("batch_id"))
