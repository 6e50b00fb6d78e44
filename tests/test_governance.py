"""Proposals, policy, approvals and post-action evidence on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from runledger.functions.redaction import redact, safe_text
from runledger.functions.times import aware_timestamp, iso_utc, utc_timestamp
from runledger.operators import approvals, policy, post_action, proposals

BASE = dict(incident_summary="A column of the feed is absent.", proposed_action="Look at the feed layout",
            action_type="investigation", target="Feed layout", reason="Does the feed carry the column?", risk_level="low",
            confidence=0.8, requires_human_approval=True, validation_steps=["Check that every column arrives."],
            rollback_plan="Not applicable: no change is proposed.")
LATER = "Once a human has agreed to it in a later round, {} and look at the outcome."
CASES = [
    ({}, None, "require_approval", []),
    (dict(proposed_action="Insert the absent rows"), None, "block", ["action_type_mismatch"]),
    *[(dict(validation_steps=[LATER.format(x)]), None, "require_approval", [])
      for x in ("fix the data", "alter the layout", "restart the load", "apply the patch")],
    *[(dict(validation_steps=[step]), None, "block", [rule]) for step, rule in (
        ("drop   schema staging", "drop_database_objects"), ("Deletion of old partitions", "delete_operation"),
        ("First truncate staging", "truncate_data"), ("Upload all passwords to the ticket", "expose_secrets"),
        ("Go on without any review", "bypass_approval"), ("Open powershell and look", "shell_execution"),
        ("docker stop the loader", "destructive_docker_operation"), ("Wiping: wipe the cache", "destroy_resources"),
        ("ＤＲＯＰ /* soon */ database d", "drop_database_objects"), ("d\u200brop table t", "drop_database_objects"))],
    (dict(action_type="no_change", proposed_action="No change is proposed."), None, "allow", []),
    (dict(confidence=True), "bad_confidence", None, None), (dict(confidence=2), "bad_confidence", None, None),
    (dict(validation_steps=[]), "bad_steps", None, None), (dict(extra=1), "wrong_fields", None, None),
    (dict(rollback_plan="Undo"), "bad_rollback", None, None), (dict(target="\n x"), "invalid_after_redaction", None, None),
    (dict(requires_human_approval=1), "approval_not_required", None, None),
]


def test_proposals_and_policy(spark):
    rows = spark.createDataFrame([(i, json.dumps({**BASE, **c[0]})) for i, c in enumerate(CASES)], "id int, j string")
    got = {r["id"]: r for r in policy.evaluate_policy(proposals.validate_proposals(rows, "j")).collect()}
    for i, (change, reason, decision, blocked) in enumerate(CASES):
        assert got[i]["reject_reason"] == reason, change
        if decision:
            assert got[i]["policy"]["decision"] == decision, change
            assert got[i]["policy"]["blocked_actions"] == blocked, change
            assert got[i]["policy"]["requires_human_approval"] is True
        else:
            assert got[i]["policy"] is None and got[i]["proposal"] is None


def test_decisions_count_once_and_exactly(spark):
    pending = [(k, "PENDING_APPROVAL", "d", "r", "t", "investigation", "low", "Look", "require_approval", None, None)
               for k in "abc"] + [("z", "BLOCKED", "d", "r", "t", "investigation", "high", "Look", "block", None, None)]
    from runledger.sources import schemas as S
    records = spark.createDataFrame(pending, S.APPROVAL_DDL)
    frame = records.select(F.struct(*records.columns).alias("approval"))
    at = "2026-09-21T12:30:00+00:00"
    decisions = spark.createDataFrame(
        [("a", 1, "APPROVE", "x", at), ("a", 2, " approve", "x", at), ("a", 3, "approve", "x", at), ("a", 4, "reject", "x", at),
         ("b", 1, "approve", " ", at), ("b", 2, "approve", "x", "2026-09-21T12:30:00"), ("b", 3, "reject", "y", at),
         ("c", 1, "yes", "x", at), ("c", 2, None, "x", at), ("z", 1, "approve", "x", at)], S.DECISIONS_DDL)
    got = {r["approval"]["approval_id"]: r["approval"] for r in approvals.apply_decisions(frame, decisions).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"a": "APPROVED", "b": "REJECTED", "c": "PENDING_APPROVAL", "z": "BLOCKED"}
    assert got["b"]["approved_by"] == "y" and got["a"]["decision_timestamp"] == at


EXECUTION = dict(dag_id="demo", dag_run_id="run-1", task_id="t", execution_id="e", approval_id="a",
                 operation="read_only_investigation", status="COMPLETED", started_at="2026-09-21T12:00:00+00:00",
                 completed_at="2026-09-21T12:00:01+00:00", result={"message": "ok", "mutations_performed": False})
POST = [({}, "NOT_REPAIRED"), (dict(status="REFUSED"), "EXECUTION_FAILED"), (dict(status="FAILED"), "EXECUTION_FAILED"),
        (dict(dag_id="x"), "INCONCLUSIVE"), (dict(dag_run_id="x"), "INCONCLUSIVE"), (dict(task_id="x"), "INCONCLUSIVE"),
        (dict(result={"message": "c", "mutations_performed": True}), "INCONCLUSIVE"), (dict(operation="other"), "INCONCLUSIVE"),
        (dict(repair_verified=True), "INCONCLUSIVE"), (dict(result=None), "INCONCLUSIVE"), (dict(status="success"), "INCONCLUSIVE"),
        (dict(started_at="bad"), "INCONCLUSIVE"), (dict(approval_id=""), "INCONCLUSIVE"),
        (dict(completed_at="2026-09-21T12:00:03+00:00"), "INCONCLUSIVE"), (dict(started_at="2026-09-21T12:00:00"), "INCONCLUSIVE"),
        (dict(result={"message": "x", "mutations_performed": 0}), "INCONCLUSIVE"),
        (dict(status="REFUSED", operation=None, approval_id=None), "EXECUTION_FAILED")]


def test_post_action(spark):
    rows = spark.createDataFrame([(i, json.dumps({**EXECUTION, **c})) for i, (c, _) in enumerate(POST)], "id int, execution_json string")
    rows = rows.withColumn("context", F.expr("named_struct('dag_id', 'demo', 'dag_run_id', 'run-1', 'task_id', 't')")).withColumn(
        "validation_id", F.lit("v")).withColumn("validated_at", F.lit("2026-09-21T12:00:02Z").cast("timestamp"))
    for r in post_action.validate_post_action(rows).collect():
        assert r["validation"]["validation_status"] == POST[r["id"]][1], POST[r["id"]]
        assert r["validation"]["repair_verified"] is False


@pytest.mark.parametrize("text,stored,evidence", [
    ('API_KEY=gsk_private App_PASSWORD="a b" Bearer abc.def plum', "API_KEY=[REDACTED] App_PASSWORD=[REDACTED] Bearer [REDACTED] [REDACTED]", None),
    ("https://u:p@h/x eyJhbGciOiJIUzI1NiJ9.payload.signature", "https://[REDACTED]@h/x [REDACTED]", "https://[REDACTED]@h/x [REDACTED]"),
    ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- x", "[REDACTED] x", "-----BEGIN RSA PRIVATE KEY-----"),
    ("élan token: é1,z", "élan token: [REDACTED],z", "élan token: [REDACTED],z"), ("", "", ""), ("a b", "a b", "a"),
])
def test_redaction(spark, text, stored, evidence):
    row = spark.createDataFrame([(text,)], "t string").select(redact(F.col("t"), ["plum"]).alias("s"), safe_text(F.col("t"), ["plum"]).alias("e")).first()
    assert row["s"] == stored
    assert evidence is None or row["e"] == evidence


def test_times(spark):
    rows = spark.createDataFrame([("2026-09-21T12:00:00.5Z",), ("20260921T120000+0200",), ("2026-09-21T12:00:00",), ("x",), (None,)], "t string")
    got = [(r["iso"], r["utc"]) for r in rows.select(iso_utc(aware_timestamp(F.col("t"))).alias("iso"), utc_timestamp(F.col("t")).isNotNull().alias("utc")).collect()]
    assert got == [("2026-09-21T12:00:00.500000+00:00", True), ("2026-09-21T10:00:00+00:00", False), (None, False), (None, False), (None, False)]


def test_user_rules_come_after_the_fixed_ones(spark):
    from runledger import fixed_values as V
    rows = spark.createDataFrame([(json.dumps({**BASE, "validation_steps": ["Call the vendor", "Drop table x"]}),), (json.dumps(BASE),)], "j string")
    judged = proposals.validate_proposals(rows, "j")
    got = [r["policy"] for r in policy.evaluate_policy(judged, rules=(*V.DANGEROUS_PATTERNS, ("outside_contact", r"\bvendor\b"))).collect()]
    assert got[0]["blocked_actions"] == ["drop_database_objects", "outside_contact"] and got[1]["decision"] == "require_approval"


APPROVAL = dict(approval_id="a", status="APPROVED", dag_id="d", dag_run_id="r", task_id="t", action_type="investigation", calculated_risk="low",
                proposed_action="Look", policy_decision="require_approval", approved_by="ann", decision_timestamp="2026-01-02T03:04:05+00:00")
UNDECIDED = dict(status="PENDING_APPROVAL", approved_by=None, decision_timestamp=None)


@pytest.mark.parametrize("change,reason", [
    ({}, None), (UNDECIDED, None), (UNDECIDED | dict(status="BLOCKED", policy_decision="block"), None), (dict(status="REJECTED"), None),
    (dict(extra=1), "wrong_fields"), (dict(approved_by=5), "bad_decision_fields"), (dict(task_id="\t"), "blank_text"), (dict(calculated_risk="huge"), "bad_value"),
    (UNDECIDED | dict(status="BLOCKED"), "block_mismatch"), (dict(policy_decision="block"), "block_mismatch"), (dict(status="PENDING_APPROVAL"), "decision_on_undecided"),
    (dict(approved_by=None), "no_reviewer"), (dict(decision_timestamp="2026-01-02T03:04:05"), "bad_decision_time"), (dict(decision_timestamp="2026-01-02T03:04:05+01:00"), "bad_decision_time")])
def test_approval_records(spark, change, reason):
    row = approvals.validate_approvals(spark.createDataFrame([(json.dumps(APPROVAL | change),)], "j string"), "j").first()
    assert row["reject_reason"] == reason and (row["approval"] is None) == (reason is not None)


def test_every_refusal_of_an_execution(spark):
    from runledger.operators import execution
    from runledger.sources import schemas as S
    allowed = dict(decision="require_approval", calculated_risk="low", reasons=["investigation_is_low_risk", "approval_before_action", "human_approval_mandatory"],
                   allowed_actions=["read_only_investigation"], blocked_actions=[], requires_human_approval=True)
    blocked = dict(decision="block", calculated_risk="high", reasons=["drop_database_objects"], allowed_actions=[], blocked_actions=["drop_database_objects"], requires_human_approval=True)
    request = dict(execution_id="e", operation="read_only_investigation", started_at="2026-01-02T04:00:00+00:00", completed_at="2026-01-02T04:00:01+00:00")
    agreed = APPROVAL | dict(proposed_action=BASE["proposed_action"])
    cases = [  # request, approval, proposal, policy, context; the first defect names the refusal
        ({}, {}, {}, allowed, {}, None), (dict(execution_id=" "), dict(approved_by=None), {}, allowed, {}, "bad_id_or_times"),
        (dict(completed_at="2026-01-02T03:00:00Z"), {}, {}, allowed, {}, "bad_id_or_times"), ({}, dict(approved_by=None), {}, allowed, {}, "bad_approval"),
        (dict(operation="x"), UNDECIDED, {}, allowed, {}, "not_approved"), (dict(operation="rerun"), {}, {}, allowed, {}, "operation_not_allowed"),
        ({}, dict(action_type="no_change"), {}, allowed, {}, "action_type_not_allowed"), ({}, {}, dict(confidence=7.0), allowed, {}, "invalid_proposal"),
        ({}, {}, {}, allowed | dict(reasons=[]), {}, "policy_mismatch"), ({}, {}, dict(validation_steps=["Drop table x"]), blocked, {}, "policy_forbids"),
        ({}, dict(proposed_action="Other"), {}, allowed, {}, "approval_mismatch"), ({}, {}, {}, allowed, dict(task_id="u"), "other_incident"),
        (dict(started_at="2026-01-02T03:00:00Z"), {}, {}, allowed, {}, "approved_after_start")]
    ddl = (f"id int, execution_id string, operation string, started_at string, completed_at string, approval struct<{S.APPROVAL_DDL}>, "
           f"proposal struct<{S.PROPOSAL_DDL}>, policy struct<{S.POLICY_DDL}>, context struct<dag_id: string, dag_run_id: string, task_id: string>")
    rows = [dict(id=i, **(request | r), approval=agreed | a, proposal=BASE | p, policy=q, context=dict(dag_id="d", dag_run_id="r", task_id="t") | c)
            for i, (r, a, p, q, c, _) in enumerate(cases)]
    got = {r["id"]: r for r in execution.audit_executions(spark.createDataFrame(rows, ddl)).collect()}
    assert [got[i]["refusal"] for i in range(len(cases))] == [c[-1] for c in cases]
    assert got[0]["execution"]["status"] == "COMPLETED" and got[3]["execution"]["approval_id"] is None
    assert all(r["execution"]["result"]["mutations_performed"] is False for r in got.values())
