"""Loads, evidence, similarity, history and streams."""

import json
import random
import re
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from runledger.operators import evidence, logs, runs, similarity, verification
from runledger.operators import transactions as X
from runledger.plans.incremental_load import LoadPaths, create_pipeline, run_load
from runledger.session import shared_dir
from runledger.sources import incident_store, schemas, targets
from runledger.streaming import watch
from runledger.workload.adapters import EXPECTED_CHANGE, INCIDENT_RULES, view

SF = "/root/testdata/sf0.001"


def test_load_is_idempotent_and_keys_unique(spark):
    raw = spark.sql("""SELECT * FROM VALUES
      (1L, 'C1', 10.00BD, 'COMPLETED', DATE'2024-01-02', TIMESTAMP'2024-01-02 00:00:00'),
      (1L, 'C1', 99.00BD, 'FAILED', DATE'2024-01-03', TIMESTAMP'2024-01-03 00:00:00'),
      (2L, 'TEST9', 5.00BD, 'COMPLETED', DATE'2024-01-02', TIMESTAMP'2024-01-02 00:00:00'),
      (3L, NULL, 5.00BD, 'COMPLETED', DATE'2024-01-02', TIMESTAMP'2024-01-02 00:00:00'),
      (4L, 'C4', 7.00BD, 'COMPLETED', DATE'2024-01-02', TIMESTAMP'2024-01-01 00:00:00'),
      (5L, 'C5', NULL, 'COMPLETED', DATE'2024-01-02', TIMESTAMP'2024-01-02 00:00:00'),
      (6L, 'C6', 1.00BD, 'COMPLETED', DATE'2024-01-02', TIMESTAMP'2024-01-02 00:00:00'),
      (6L, 'C6', 2.50BD, 'COMPLETED', DATE'2024-01-04', TIMESTAMP'2024-01-04 00:00:00')
      AS t(transaction_id, customer_id, amount, status, transaction_date, updated_at)""")
    raw = raw.withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    paths = LoadPaths(shared_dir(spark, "t"), buckets=4)
    old = raw.where("transaction_id = 4").withColumn("transaction_id", F.lit(6).cast("bigint"))
    mark = create_pipeline(spark, paths, "p", "2024-01-01 00:00:00", initial=old)
    first = run_load(spark, raw, paths, mark, "a", "p")
    again = run_load(spark, raw, paths, mark, "a", "p")
    assert first["status"] == again["status"] == "PASSED" and first["actual_count"] == 2
    rows = {r["transaction_id"]: float(r["amount"]) for r in targets.read_target(spark, paths.target, schemas.TRANSACTIONS_DDL).collect()}
    assert rows == {1: 10.0, 6: 2.5}
    assert run_load(spark, raw, paths, first["watermark_path"], "b", "p")["status"] == "NO_NEW_DATA"


def _transactions(spark, *rows):
    return spark.createDataFrame([(k, "C", Decimal(a), "COMPLETED", None, datetime(2024, 1, d)) for k, a, d in rows], schemas.TRANSACTIONS_DDL)


def test_target_keeps_null_keys_once_and_its_bucket_count(spark):
    paths = LoadPaths(shared_dir(spark, "t"), buckets=4)
    mark = create_pipeline(spark, paths, "p", "2024-01-01 00:00:00")
    raw = _transactions(spark, (None, "1.00", 2), (7, "2.00", 3))
    for turn in "abc":
        run_load(spark, raw, paths, mark, turn, "p")
    assert targets.read_target(spark, paths.target, schemas.TRANSACTIONS_DDL).count() == 2
    with pytest.raises(ValueError):
        targets.upsert_target(paths.target, raw, X.KEY, schemas.TRANSACTIONS_DDL, 5)


def test_load_that_fails_before_the_switch_changes_nothing(spark, monkeypatch):
    paths = LoadPaths(shared_dir(spark, "t"), buckets=4)
    mark = create_pipeline(spark, paths, "p", "2024-01-01 00:00:00", initial=_transactions(spark, *((k, "1.00", 1) for k in range(20))))
    raw = _transactions(spark, (3, "9.00", 2), (99, "9.00", 2))
    read = lambda *only: {r[X.KEY]: int(r["amount"]) for r in targets.read_target(spark, paths.target, schemas.TRANSACTIONS_DDL, *only).collect()}
    before = read()
    with monkeypatch.context() as broken:
        broken.setattr(targets, "_switch", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run_load(spark, raw, paths, mark, "a", "p")
    assert read() == before == dict.fromkeys(range(20), 1)
    assert run_load(spark, raw, paths, mark, "a", "p")["status"] == "PASSED"
    assert read() == before | {3: 9, 99: 9}
    touched = targets.touched_buckets(raw, X.KEY, 4)
    part = targets.read_target(spark, paths.target, schemas.TRANSACTIONS_DDL, touched)
    assert re.search(r"PartitionFilters: \[[^\]]*key_bucket", part._jdf.queryExecution().toString())
    assert {3, 99} <= read(touched).keys() and read([]) == {}


def test_repeated_verification_run_gives_one_row_each(spark):
    requests = spark.sql("""SELECT * FROM VALUES ('d', 'old', 'new', CAST(NULL AS STRING), true, TIMESTAMP'2024-01-01 00:00:00'),
      ('d', 'old2', 'new', NULL, true, TIMESTAMP'2024-01-01 00:00:00'), ('d', 'old3', 'new', NULL, true, TIMESTAMP'2024-01-01 01:00:00')
      AS t(dag_id, original_dag_run_id, verification_dag_run_id, refusal, created, trigger_started_at)""")
    seen = spark.sql("SELECT 'd' AS dag_id, 'new' AS dag_run_id, TIMESTAMP'2024-01-01 00:00:30' AS observed_at, 'success' AS state")
    tasks = spark.createDataFrame([("d", "new", "a", "success", 1, -1)], "dag_id string, dag_run_id string, task_id string, state string, try_number int, map_index int")
    got = sorted((r["original_dag_run_id"], r["verification_status"]) for r in verification.rerun_outcomes(requests, seen, tasks, ["a"]).collect())
    assert got == [("old", "VERIFIED_HEALTHY"), ("old2", "VERIFIED_HEALTHY"), ("old3", "TIMEOUT")]


def test_no_decision_is_lost_by_its_stated_time(spark):
    base = shared_dir(spark, "decisions")
    ddl = "approval_id string, seq bigint, command string, reviewer string, decided_at string"
    for row in (("z", 1, "approve", "ann", "2024-01-01T12:00:00+00:00"), ("a", 2, "reject", "bob", "2024-01-01T10:00:00+00:00"),
                ("z", 3, "reject", "eve", "2024-01-01T09:00:00+00:00"), ("b", 4, "approve", "ann", "2024-01-01T08:00:00+00:00")):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(base + "/in")
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    spark.createDataFrame([("z",), ("a",), ("b",)], "approval_id string").write.parquet(base + "/opened")
    life = watch.approval_life(source, spark.readStream.schema("approval_id string").parquet(base + "/opened"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # ends with its input
    try:
        life.writeStream.format("parquet").option("checkpointLocation", base + "/c").trigger(availableNow=True).start(base + "/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    # By the clock all that was approved has expired long ago.
    assert sorted((r["approval_id"], r["status"]) for r in spark.read.parquet(base + "/out").collect()) == [
        ("a", "REJECTED"), ("b", "APPROVED"), ("b", "EXPIRED"), ("z", "APPROVED"), ("z", "EXPIRED")]


def test_bad_attempt_numbers_go_to_quarantine(spark):
    rows = [("d", "r", "t", "failed", n, -1) for n in (0, 1, None)]
    ti = spark.createDataFrame(rows, "dag_id string, dag_run_id string, task_id string, state string, try_number int, map_index int")
    assert logs.failed_attempts(ti).count() == 1
    assert {r["try_number"] for r in logs.unaddressable_attempts(ti).collect()} == {0, None}


@pytest.mark.parametrize("shift", range(6))
def test_secret_over_the_border_of_two_parts_is_masked(spark, shift):
    secrets = ["key-1\nkey-2\nkey-3", "plum"]
    body = ["x"] * shift + ["a key-1", "key-2", "key-3 z", None, "\uffff1 plum", "end"]
    rows = [("d", "r", "t", 1, -1, i, line) for i, line in enumerate(body)]
    lines = spark.createDataFrame(rows, "dag_id string, dag_run_id string, task_id string, try_number int, map_index int, seq long, line string")
    parts = logs.assemble_logs(lines, secrets, part_lines=6).orderBy("part").collect()
    assert [p["lines"] for p in parts] == [6, shift][:1 + (shift > 0)]
    want = "\n".join(x or "" for x in body).replace(secrets[0], "[REDACTED]").replace("plum", "[REDACTED]")
    found = "\n".join(p.log_text for p in parts)
    # Where the border cuts the secret, the mask ends one part and the rest begins the next.
    assert found == (want.replace("[REDACTED] z", "[REDACTED]\n z") if shift in (4, 5) else want)


def test_hot_key_keeps_one_row(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("transaction_id"),
                                    F.timestamp_seconds("id").alias("updated_at"))
    assert X.latest_per_key(rows).count() == 2001


def test_nested_evidence_and_ties(spark):
    frame = lambda f: {"filename": f, "lineno": 3, "name": "g"}
    lines = [
        (1, "plain"), (2, "{broken"), (3, json.dumps({"event": "x", "error_detail": [{"exc_type": "A", "frames": [frame("/v/site-packages/a.py")], "exceptions": [
            {"exc_type": "B", "exc_value": "token=abc", "frames": [frame("dags\\q.py"), {"filename": "lib.py", "lineno": 1.5}]}, {"exc_type": "C", "frames": [frame("dags/q.py")]}]}]})),
        (4, json.dumps({"event": "Task failed with exception", "error_detail": {"exc_type": "D"}})), (5, json.dumps({"error_detail": [{"exc_type": ""}]}))]
    rows = spark.createDataFrame([("d", "r", "t", 1, -1, s, x) for s, x in lines] + [("d", "r", "u", 1, -1, 1, "none")], schemas.LOG_LINES_DDL)
    got = {r["task_id"]: r for r in evidence.extract_failure_contexts(rows).collect()}
    assert (got["t"]["exception_type"], got["t"]["exception_message"], got["t"]["source_file"], got["t"]["source_line"]) == ("B", "token=[REDACTED]", "dags\\q.py", 3)
    assert got["u"]["exception_type"] is None


def test_health(spark):
    tasks = [("ok", t, "success") for t in ("a", "b")] + [("fail", "a", "success"), ("fail", "b", "upstream_failed"), ("miss", "a", "success")]
    tasks += [("skip", "a", "success"), ("skip", "b", "success"), ("skip", "c", "skipped"), ("null", "a", None), ("null", "b", "success")]
    ti = spark.createDataFrame([("d", r, t, s, 1, -1) for r, t, s in tasks], "dag_id string, dag_run_id string, task_id string, state string, try_number int, map_index int")
    ev = spark.createDataFrame([("d", "old", r, "CREATED", "success") for r in ("ok", "fail", "miss", "skip", "null", "none")] + [("d", "ok", "ok", "CREATED", "success")],
                               "dag_id string, original_dag_run_id string, verification_dag_run_id string, trigger_status string, dag_run_state string")
    got = {(r["original_dag_run_id"], r["verification_dag_run_id"]): r["verification_status"] for r in runs.assess_health(ev, runs.task_summary(ti, ["a", "b"])).collect()}
    assert got == {("old", "ok"): "VERIFIED_HEALTHY", ("old", "fail"): "VERIFICATION_FAILED", ("old", "miss"): "INCONCLUSIVE", ("old", "skip"): "INCONCLUSIVE",
                   ("old", "null"): "INCONCLUSIVE", ("old", "none"): "INCONCLUSIVE", ("ok", "ok"): "INCONCLUSIVE"}


def test_similarity_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]

    def row():  # a third of all rows share one pipeline and most words are frequent
        text = None if rng.random() < .05 else " ".join(rng.choice(words[:5] if rng.random() < .6 else words) for _ in range(rng.randint(1, 7)))
        return (f"d{0 if rng.random() < .4 else rng.randint(0, 6)}", f"t{rng.randint(0, 4)}", rng.choice([None, "A", "B", "", "A"]), text)

    current, past = [(i, *row()) for i in range(120)], [(i, *row()) for i in range(300)]
    ddl = "dag_id string, task_id string, exception_type string, exception_message string"
    c, h = spark.createDataFrame(current, "context_id bigint, " + ddl), spark.createDataFrame(past, "seq bigint, " + ddl)
    want = set()
    for i, d, t, e, m in current:
        scored = []
        for q, d2, t2, e2, m2 in past:
            a, b = set(re.findall(r"\w+", m or "")), set(re.findall(r"\w+", m2 or ""))
            score = 2.0 * (d == d2) + 3 * (t == t2) + 3 * bool(e and e == e2) + (4 * len(a & b) / len(a | b) if a | b else 0)
            if score:
                scored.append((round(score, 4), q))
        scored.sort(key=lambda x: -x[0])
        want |= {(i, n + 1, q, s) for n, (s, q) in enumerate(scored[:5])}
    for part in (1, 7, 4096):
        got = {(r["context_id"], r["rank"], r["seq"], r["match_score"]) for r in similarity.find_similar(c, h, 5, part).collect()}
        assert got == want


def test_history_survives_corrupt_lines(spark, tmp_path):
    lines = [r["line"] for r in view(spark, SF, "incident_json").where("okey IN (14, 15, 18, 22, 26)").collect()]
    (tmp_path / "h.jsonl").write_bytes("\n".join(lines).encode() + b'\nnot json\n\xff\n{}\n{"partial":\n')
    valid, rejected = incident_store.load_incidents(spark, str(tmp_path), expected_change=EXPECTED_CHANGE, **INCIDENT_RULES)
    kept = valid.collect()
    assert len(kept) + rejected.count() == len(lines) + 4 and len(kept) >= 3
    assert all("[REDACTED]" in r["incident"]["failure"]["exception_message"] for r in kept)
    assert incident_store.load_incidents(spark, str(tmp_path / "none"))[0].count() == 0


def test_run_watch(spark):
    base = shared_dir(spark, "watch")
    spark.sql("""SELECT * FROM VALUES ('d', 'r1', TIMESTAMP'2024-01-01 00:00:00'), ('d', 'r2', TIMESTAMP'2024-01-01 00:00:10'),
      ('d', 'r3', TIMESTAMP'2024-01-01 00:00:10') AS t(dag_id, dag_run_id, trigger_started_at)""").write.parquet(base + "/t")
    spark.sql("""SELECT * FROM VALUES ('d', 'r1', TIMESTAMP'2024-01-01 00:00:30', 'running'), ('d', 'r1', TIMESTAMP'2024-01-01 00:01:00', 'success'),
      ('d', 'r1', TIMESTAMP'2024-01-01 00:01:30', 'failed'), ('d', 'r2', TIMESTAMP'2024-01-01 00:10:00', 'success'), ('d', 'r3', TIMESTAMP'2024-01-01 00:00:40', 'odd'),
      ('d', 'zz', TIMESTAMP'2024-01-02 00:10:00', 'success') AS t(dag_id, dag_run_id, observed_at, state)""").write.parquet(base + "/o")
    read = lambda p: spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)
    out = watch.watch_runs(read(base + "/t"), read(base + "/o"))
    out.writeStream.format("parquet").option("checkpointLocation", base + "/c").trigger(availableNow=True).start(base + "/out").awaitTermination()
    assert {(r["dag_run_id"], r["outcome"]) for r in spark.read.parquet(base + "/out").collect()} == {("r1", "DECIDED"), ("r2", "TIMEOUT"), ("r3", "INCONCLUSIVE")}


def test_many_loads_leave_a_bounded_number_of_files(spark, tmp_path):
    ddl, path = "id BIGINT, v BIGINT", str(tmp_path / "t")
    targets.create_target(spark.createDataFrame([(i, 0) for i in range(8)], ddl), path, "id", 4)
    for turn in range(1, 13):
        targets.upsert_target(path, spark.createDataFrame([(turn % 8, turn)], ddl), "id", ddl, 4)
        if turn == 11:
            reader = targets.read_target(spark, path, ddl)  # of a turn that is still kept later
        if turn % 4 == 0:
            targets.tidy_target(spark, path, 3)
    assert {r["id"]: r["v"] for r in targets.read_target(spark, path, ddl).collect()} == {0: 8, 1: 9, 2: 10, 3: 11, 4: 12, 5: 5, 6: 6, 7: 7}
    assert {r["id"]: r["v"] for r in reader.collect()} == {0: 8, 1: 9, 2: 10, 3: 11, 4: 4, 5: 5, 6: 6, 7: 7}
    files = [f for f in (tmp_path / "t-manifest").glob("*.parquet")]
    assert len(files) == 3 and len(list((tmp_path / "t").glob("version=*"))) <= 6
    with pytest.raises(ValueError):
        targets.tidy_target(spark, path, 0)


def test_overlapping_playbooks_the_longest_prefix_wins(spark):
    from runledger.operators import playbooks
    row = lambda name, prefix, dag="d": (name, dag, "t", "E", prefix, name, "a", "s", "r", "medium", ["x"], "b", "{}")
    books = spark.createDataFrame([row("short", "Feed"), row("long", "Feed lost"), row("twin_b", "Feed lost now"), row("twin_a", "Feed lost now"),
                                   row("none", None), row("other", "Feed", "d2")], schemas.PLAYBOOKS_DDL)
    cases = [("d", "t", "E", m) for m in ("Feed late", "Feed lost again", "Feed lost now!", "No feed", None)] + [("d", "t", None, "Feed"), ("d2", "t", "E", "Feed"), (None, None, None, None)]
    ctx = spark.createDataFrame(cases, "dag_id STRING, task_id STRING, exception_type STRING, exception_message STRING").select(F.struct("*").alias("context"))
    got = {tuple(r["context"]): r["known"] and r["known"]["playbook"] for r in playbooks.match_playbooks(ctx, books).collect()}
    assert [got[c] for c in cases] == ["short", "long", "twin_a", None, None, None, "other", None]
