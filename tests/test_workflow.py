"""The incident workflow on a handful of incidents, its resumption, and stored changes of any shape."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runledger.operators import incidents, similarity
from runledger.plans import incident_workflow as WF
from runledger.sources import incident_store, schemas as S
from runledger.sources.stage_tables import StageTables

SOUND_RCA = {"summary": "Late feed", "root_cause": "Upstream", "evidence": [], "recommended_action": "Look", "risk_level": "low",
             "confidence": 0.5, "requires_human_approval": True}
LOOK = {"incident_summary": "The feed is late", "proposed_action": "Look at the feed", "action_type": "investigation", "target": "feed", "reason": "Late",
        "risk_level": "low", "confidence": 0.9, "requires_human_approval": True, "validation_steps": ["Count the rows."],
        "rollback_plan": "Not applicable: no change is proposed."}
CHANGE = '{"target": "conf/feed.json", "before": {"retries": 3, "mode": "slow"}, "after": {"retries": 5, "mode": "fast"}}'
# run: what is special about it.
RUNS = ["plain", "known", "healed", "norca", "drop", "reject", "unasked", "unran", "lost", "late", "foreign", "expired"]
KNOWN = {"known", "healed", "lost", "late", "foreign", "expired"}


def key(run):
    return f"d/{run}/t/1/-1"


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    ts = lambda x: datetime.fromisoformat(f"2024-03-01 {x}")
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    message = lambda run: "Feed lost token=abc" if run in KNOWN else "Other trouble"
    lines = [("d", r, "t", 1, -1, 0, json.dumps({"event": "Task failed with exception", "error_detail": [
        {"exc_type": "FeedError", "exc_value": message(r), "frames": [{"filename": "dags/f.py", "lineno": 3, "name": "go"}]}]})) for r in RUNS]
    responses = [(key(r), json.dumps(SOUND_RCA), json.dumps(LOOK | ({"proposed_action": "DROP TABLE feed"} if r == "drop" else {}))) for r in RUNS if r != "norca"]
    decisions = [(f"ap_{key(r)}", 1, "reject" if r == "reject" else "approve", "ann", "2024-03-01T10:00:00+00:00") for r in RUNS if r != "unasked"]
    decisions += [(f"pb_{key(r)}", 1, "approve", "bob", "2024-03-01T10:10:00Z" if r != "expired" else "2024-03-01T09:00:00Z") for r in KNOWN]
    executions = [(key(r), f"ex_{r}", "read_only_investigation", "2024-03-01T10:05:00Z", "2024-03-01T10:06:00Z") for r in RUNS if r != "unran"]
    changes = lambda r: json.dumps([json.loads(CHANGE) if r != "foreign" else {"target": "conf/feed.json", "before": {}, "after": {"retries": 9}}])
    ran = [(key(r), ts("10:15:00"), "COMPLETED", changes(r), "set") for r in KNOWN if r != "lost"]
    new = {r: f"manual__reliability_{r}" for r in ("healed", "late")}
    reruns = [(key(r), n, ts("10:16:00"), ts("10:17:00"), True) for r, n in new.items()]
    tasks = [("d", n, "a", "success", 1, None, None, -1, ts("10:17:40" if r == "healed" else "10:20:00")) for r, n in new.items()]
    reads = frame(tasks, S.TASK_INSTANCES_DDL + ", read_at TIMESTAMP")
    instances = frame([("d", r, "t", "failed", 1, None, None, -1) for r in RUNS], S.TASK_INSTANCES_DDL).unionByName(reads.drop("read_at"))
    inputs = WF.Inputs(
        runs=frame([("d", r, "failed", ts(f"0{9 - i // 6}:{10 - i % 6:02}:00")) for i, r in enumerate(RUNS)] + [("d", "fine", "success", ts("09:30:00"))], S.RUNS_DDL),
        task_instances=instances, log_lines=frame(lines, S.LOG_LINES_DDL),
        responses=frame(responses, "incident_id STRING, rca_response STRING, proposal_response STRING"), decisions=frame(decisions, S.DECISIONS_DDL),
        executions=frame(executions, "incident_id STRING, execution_id STRING, operation STRING, started_at STRING, completed_at STRING"),
        playbooks=frame([("set_feed", "d", "t", "FeedError", "Feed lost", "conf/feed.json", "Set the feed.", "Feed lost", "Known", "medium", ["Look."], "Put it back.", CHANGE)], S.PLAYBOOKS_DDL),
        playbook_runs=frame(ran, "incident_id STRING, run_at TIMESTAMP, status STRING, changes STRING, message STRING"),
        reruns=frame(reruns, "incident_id STRING, verification_run_id STRING, requested_at TIMESTAMP, trigger_started_at TIMESTAMP, created BOOLEAN"),
        observations=frame([("d", n, ts("10:17:30"), "success") for n in new.values()], S.OBSERVATIONS_DDL), task_reads=reads)
    base = str(tmp_path_factory.mktemp("flow"))
    flow = WF.IncidentWorkflow(spark, inputs, f"{base}/store", StageTables(spark, f"{base}/stages", "l1"), "l1", "2024-03-01T11:00:00Z",
                               required=["a"], recent=50, enveloped=(False, False))
    reports = WF.workflow_reports(flow.run())
    return flow, reports, {r["incident_id"].split("/")[1]: r for r in reports.collect()}


def test_every_incident_ends_as_its_stages_say(loaded):
    _, _, got = loaded
    assert {r: got[r]["error"] for r in RUNS} == dict.fromkeys(RUNS) | {"norca": "rca", "unran": "execution", "foreign": "storage"}
    assert {r: got[r]["final_incident_state"] for r in RUNS} == {
        "plain": "NOT_REPAIRED", "known": "REMEDIATION_APPLIED_PENDING_VALIDATION", "healed": "VERIFIED_HEALTHY", "norca": "INCONCLUSIVE", "drop": "BLOCKED",
        "reject": "REJECTED", "unasked": "INCONCLUSIVE", "unran": "INCONCLUSIVE", "lost": "INCONCLUSIVE", "late": "TIMEOUT",
        "foreign": "REMEDIATION_APPLIED_PENDING_VALIDATION", "expired": "NOT_REPAIRED"}
    assert {r for r in RUNS if got[r]["memory"]["incident_stored"]} == set(RUNS) - {"norca", "unran", "foreign"}
    assert all(r["memory"]["similar_historical_incidents_found"] == 0 for r in got.values())


def test_stages_agree_about_the_incident_and_claim_no_repair(loaded):
    _, _, got = loaded
    for run in ("plain", "known", "drop"):
        r = got[run]
        for stage in (r["approval"], r["execution"], r["validation"]):
            assert (stage["dag_id"], stage["dag_run_id"], stage["task_id"]) == ("d", run, "t")
        assert r["validation"]["repair_verified"] is False
    for run in ("drop", "reject", "unasked"):  # nobody may have executed anything
        assert got[run]["execution"]["status"] == "REFUSED" and got[run]["validation"]["validation_status"] == "EXECUTION_FAILED"
    assert got["unasked"]["approval"]["status"] == "PENDING_APPROVAL"
    assert got["plain"]["playbook_attempt"] is None and got["norca"]["approval"] is None


def test_playbook_needs_its_own_fresh_approval(loaded):
    _, _, got = loaded
    t = got["known"]["playbook_attempt"]
    assert t["approval"]["approval_id"] != got["known"]["approval"]["approval_id"] and t["execution"]["status"] == "COMPLETED"
    assert got["expired"]["playbook_attempt"]["execution"]["status"] == "REFUSED"
    assert got["expired"]["playbook_attempt"]["execution"]["message"] == "approval_expired"
    # Approved, but nobody knows what the run did: never claimed, never retried.
    assert got["lost"]["playbook_attempt"]["error"] == "playbook" and got["lost"]["playbook_attempt"]["execution"] is None
    assert got["healed"]["verification"]["task_states"] == {"a": "success"} and got["healed"]["repair_verified"] is True
    assert got["late"]["verification"]["verification_status"] == "TIMEOUT"


def test_batch_ends_at_the_first_stop(loaded):
    _, reports, got = loaded
    order = sorted(RUNS, key=lambda r: got[r]["position"]["recency"])
    stops = [r for r in order if got[r]["error"] or got[r]["approval"]["status"] != "APPROVED" or got[r]["playbook_attempt"]]
    want = set(order[:order.index(stops[0]) + 1])
    assert {r["incident"]["dag_run_id"] for r in WF.reached(reports).collect()} == want and 1 <= len(want) < len(RUNS)


def test_a_finished_load_is_not_computed_again(spark, loaded):
    flow, _, got = loaded
    gone = WF.IncidentWorkflow(spark, None, flow.store, flow.tables, "l1", flow.as_of)  # no inputs: nothing may be computed
    assert gone.run().count() == len(RUNS)
    made = []
    tables = StageTables(spark, flow.store + "-stages", "x")

    def make():
        made.append(1)
        return spark.range(3)

    def broken():
        return spark.range(3).select(F.raise_error(F.lit("cut off")).alias("id"))

    with pytest.raises(Exception):
        tables.table("a", broken)
    assert tables.finished() == {}
    assert tables.table("a", make).count() == tables.table("a", make).count() == 3 and made == [1]


def test_stored_changes_keep_their_shape_and_history_finds_them(spark, loaded):
    flow, _, _ = loaded
    valid, rejected = incident_store.load_incidents(spark, flow.store, playbooks=flow.inputs.playbooks, required=["a"])
    rows = {r["incident"]["dag_run_id"]: r["incident"] for r in valid.collect()}
    assert set(rows) == set(RUNS) - {"norca", "unran", "foreign"} and rejected.count() == 0
    change = valid.where("incident.dag_run_id = 'known'").select(F.to_json("incident.playbook_attempt.execution.changes").alias("c")).first()["c"]
    assert json.loads(change) == [json.loads(CHANGE)]
    assert rows["known"]["failure"]["exception_message"] == "Feed lost token=[REDACTED]"
    past = similarity.history_of(valid)
    now = spark.createDataFrame([("n", "d", "t", "FeedError", "Feed lost again")], "context_id STRING, dag_id STRING, task_id STRING, exception_type STRING, exception_message STRING")
    found = {r["incident_id"]: r for r in similarity.find_similar(now, past, 20).collect()}
    assert {k for k, r in found.items() if r["repair_verified"]} == {key("healed")} and all(r["historical_only"] for r in found.values())
    assert "exception_message_word_overlap" in found[key("known")]["matched_fields"] and len(found) == len(rows)


def test_only_the_expected_change_is_valid(spark, loaded):
    flow, _, _ = loaded
    valid, _ = incident_store.load_incidents(spark, flow.store, playbooks=flow.inputs.playbooks, required=["a"])
    line = valid.where("incident.dag_run_id = 'known'").select(incidents.incident_json(F.col("incident"), valid.schema["incident"].dataType).alias("line")).first()["line"]
    judge = lambda text: incidents.parse_incidents(
        spark.createDataFrame([(text,)], "line STRING"), "line", playbooks=flow.inputs.playbooks, required=["a"]).first()["reject_reason"]
    assert judge(line) is None
    for old, new, reason in (('"retries":5', '"retries":"5"', "unexpected_change"), ('"mode":"fast"', '"mode":"fast","x":1', "unexpected_change"),
                             ('"playbook":"set_feed"', '"playbook":"other"', "unknown_playbook"), ('"repair_verified":false,"error"', '"repair_verified":true,"error"', "self_verified")):
        assert old in line and judge(line.replace(old, new)) == reason, (old, new)
