"""Keyed streams over several micro-batches: same answers as the batch jobs, and state that empties."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from runledger.operators import runs
from runledger.session import shared_dir
from runledger.sources import schemas as S
from runledger.streaming import watch
from runledger.workload import streams


def as_stream(spark, df, path, files):
    """One file for each micro-batch, in the order of its ``batch`` column."""
    for i in range(files):
        df.where(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(out, base):
    (out.writeStream.format("parquet").option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start(base + "/out").awaitTermination())
    return out.sparkSession.read.parquet(base + "/out").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_run_watch_equals_batch_and_forgets(spark, seed):
    rng, base = random.Random(seed), shared_dir(spark, "watch")
    start = datetime(2024, 1, 1)
    triggers = [("d", f"r{i}", start + timedelta(seconds=rng.randint(0, 600))) for i in range(30)] + [("d", "r1", start + timedelta(seconds=900))]
    seen = [("d", f"r{rng.randint(0, 45)}", start + timedelta(seconds=rng.randint(0, 1000)), rng.choice(["queued", "running", "success", "failed", "odd"])) for _ in range(400)]
    late = timedelta(hours=2)  # closes every window, and is a run of its own
    seen += [("d", "end", start + late, "success"), ("d", "end", start + 2 * late, "success")]
    # Batches are shuffled within the allowed lateness, triggers and observations alike.
    t = spark.createDataFrame([(*x, rng.randint(0, 2)) for x in triggers], "dag_id STRING, dag_run_id STRING, trigger_started_at TIMESTAMP, batch INT")
    o = spark.createDataFrame([(*x, rng.randint(0, 2) if x[1] != "end" else 3 + (x[2] > start + late)) for x in seen], S.OBSERVATIONS_DDL + ", batch INT")
    out = watch.watch_runs(as_stream(spark, t, base + "/t", 3), as_stream(spark, o, base + "/o", 5), 120, "30 minutes")
    got = sorted((r["dag_run_id"], r["trigger_us"], r["outcome"], r["dag_run_state"] or "", r["decided_us"] or 0) for r in run(out, base))
    us = lambda c: F.coalesce(F.unix_micros(c), F.lit(0))
    batch = runs.first_decisive(t.drop("batch"), o.drop("batch"), 120).select("dag_run_id", us("trigger_started_at"), "outcome", F.coalesce("dag_run_state", F.lit("")), us("decided_at"))
    assert got == sorted(tuple(r) for r in batch.collect()) and len(got) == 31
    left = {r["key"]["dag_run_id"] for r in spark.read.format("statestore").load(base + "/checkpoint").collect()}
    assert left <= {"end"}  # its last observation is not behind the watermark yet


def test_approvals_are_decided_once_and_forgotten(spark):
    base = shared_dir(spark, "approvals")
    now = datetime.now(timezone.utc)
    at = lambda minutes: (now - timedelta(minutes=minutes)).isoformat()
    opened = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("d", 0), ("e", 1), ("waits", 1)], "approval_id STRING, batch INT")
    rows = [("a", 1, "approve", "x", at(60), 0), ("a", 2, "reject", "x", at(59), 1),  # expired long ago; decided once
            ("b", 3, "maybe", "x", at(1), 0), ("b", 4, "approve", " ", at(1), 0), ("b", 5, "reject", "y", at(2), 1),
            ("c", 6, "approve", "z", at(1), 1), ("c", 7, "reject", "z", at(500), 2),  # still valid; states an earlier time, arrives later
            ("d", 9, "reject", "late", at(3), 1), ("d", 8, "approve", "first", at(400), 1),  # one batch: the first to arrive counts
            ("e", 10, "approve", "x", at(1), 0), ("e", 11, "reject", "x", at(1), 2),  # not known yet, then known
            ("unknown", 12, "approve", "x", at(1), 1)]
    decisions = spark.createDataFrame(rows, S.DECISIONS_DDL + ", batch INT")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        out = watch.approval_life(as_stream(spark, decisions, base + "/d", 3), as_stream(spark, opened, base + "/o", 2))
        got = sorted((r["approval_id"], r["status"], r["reviewer"]) for r in run(out, base))
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert got == [("a", "APPROVED", "x"), ("a", "EXPIRED", None), ("b", "REJECTED", "y"), ("c", "APPROVED", "z"),
                   ("d", "APPROVED", "first"), ("d", "EXPIRED", None), ("e", "REJECTED", "x")]
    left = {r["key"]["approval_id"] for r in spark.read.format("statestore").load(base + "/checkpoint").collect()}
    assert left == {"c", "waits"}


def test_registered_decisions_arrive_by_seq_however_slowly_the_first_are_written(spark, tmp_path, monkeypatch):
    n = 400
    spark.range(n).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    # The least numbers reject, and their part takes by far the longest to write.
    row = spark.range(2 * n, numPartitions=8).withColumn("early", F.col("id") < n)
    long_ = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.sha2(F.concat_ws(" ", "id", k), 256)))
    decisions = row.select(F.concat(F.lit("ap_"), F.col("id") % n).alias("approval_id"), F.col("id").alias("seq"), F.when(F.col("early"), "reject").otherwise("approve").alias("command"),
                           F.when(F.col("early"), long_).otherwise("late").alias("reviewer"), F.lit("2024-03-01T10:00:00+00:00").alias("decided_at"))
    monkeypatch.setattr(streams, "view", lambda *_: decisions)
    got = streams.stream_approvals(spark, str(tmp_path)).select("approval_id", "status", F.col("reviewer") == "late").collect()
    assert {tuple(r) for r in got} == {(f"ap_{k}", "REJECTED", False) for k in range(n) if k % 9 != 4} and len(got) == len({r[0] for r in got})
