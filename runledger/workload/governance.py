"""Queries over proposals, policy, approvals, executions and playbooks.

Stages are tables of their own, as they would be in production: each one is
written once to the shared folder and read by the next.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.functions.times import aware_timestamp, is_fresh, iso_utc, offset_seconds, utc_timestamp
from runledger.operators import approvals as AP
from runledger.operators import execution as EX
from runledger.operators import playbooks as PB
from runledger.operators import policy as PO
from runledger.operators import post_action as PA
from runledger.operators import proposals as PR
from runledger.operators import verification as VR
from runledger.session import cut_lineage
from runledger.sources import schemas as S
from runledger.workload.adapters import NO_CHANGE, SECRETS, cte, view
from runledger.workload.registry import query
from runledger.workload.text import _EVIDENCE

_IDS = ("dag_id", "dag_run_id", "task_id")


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_JSON = "CASE WHEN json_valid({c}) AND {c} NOT LIKE '%NaN%' THEN CAST({c} AS JSON) END"  # NaN is not JSON
_NUMBER = "json_type({j}, '$.confidence') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'DECIMAL')"


def _text_ok(j: str, names) -> str:
    return " AND ".join(f"coalesce(json_type({j}, '$.{n}') = 'VARCHAR' AND trim({j}->>'$.{n}') <> '', false)" for n in names)


def _keys_ok(j: str, names) -> str:
    return f"list_sort(json_keys({j})) = list_sort({_list(names)})"


def _steps_ok(j: str, name: str) -> str:
    return (f"json_type({j}, '$.{name}') = 'ARRAY' AND len(list_filter(CAST(json_extract({j}, '$.{name}[*]') AS JSON[]), "
            f"lambda s: json_type(s) <> 'VARCHAR' OR trim(s->>'$') = '')) = 0")


# --- model responses --------------------------------------------------------------

_RCA_KEYS = V.RCA_TEXT_FIELDS + ("evidence", "risk_level", "confidence", "requires_human_approval")


_RCA = f"""rca_text AS (SELECT okey, CASE WHEN response->>'$.choices[0].finish_reason' = 'stop' THEN response->>'$.choices[0].message.content' END AS t FROM rca_json),
rca_read AS (SELECT okey, {_JSON.format(c="t")} AS j FROM rca_text),
rca_judged AS (SELECT okey, j, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not_an_object'
  WHEN NOT {_keys_ok("j", _RCA_KEYS)} THEN 'wrong_fields'
  WHEN NOT ({_text_ok("j", V.RCA_TEXT_FIELDS)}) THEN 'blank_text'
  WHEN NOT ({_steps_ok("j", "evidence")}) THEN 'bad_evidence'
  WHEN j->>'$.risk_level' NOT IN {_in(V.LEVELS)} THEN 'bad_risk_level'
  WHEN NOT ({_NUMBER.format(j="j")} AND TRY_CAST(j->>'$.confidence' AS DOUBLE) BETWEEN 0 AND 1) THEN 'bad_confidence'
  WHEN json_type(j, '$.requires_human_approval') <> 'BOOLEAN' OR j->>'$.requires_human_approval' <> 'true' THEN 'approval_not_required' END AS reject_reason FROM rca_read)"""


@query("rca_validation", f"""{cte("rca_json")}, {_RCA}
SELECT okey, reject_reason, CASE WHEN reject_reason IS NULL THEN j->>'$.root_cause' END AS root_cause,
CASE WHEN reject_reason IS NULL THEN regexp_replace(array_to_string(CAST(json_extract_string(j, '$.evidence[*]') AS VARCHAR[]), '|'),
 '(password=)[^\\s,;]+', '\\1[REDACTED]', 'g') END AS evidence FROM rca_judged""")
def rca_validation(spark, sf):
    judged = PR.validate_rca(view(spark, sf, "rca_json"), "response", enveloped=True)
    return judged.select("okey", "reject_reason", "rca.root_cause", F.array_join("rca.evidence", "|").alias("evidence"))


_PROPOSAL_KEYS = V.PROPOSAL_TEXT_FIELDS + ("confidence", "requires_human_approval", "validation_steps")
_JUDGED = f"""p AS (SELECT *, {_JSON.format(c="response")} AS j FROM proposal_json),
judged AS (SELECT *, j->>'$.action_type' AS kind, j->>'$.proposed_action' AS action, j->>'$.target' AS target,
  CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'not_an_object'
  WHEN NOT {_keys_ok("j", _PROPOSAL_KEYS)} THEN 'wrong_fields'
  WHEN NOT ({_text_ok("j", V.PROPOSAL_TEXT_FIELDS)}) THEN 'blank_text'
  WHEN j->>'$.action_type' NOT IN {_in(V.ACTION_TYPES)} THEN 'bad_action_type'
  WHEN j->>'$.risk_level' NOT IN {_in(V.LEVELS)} THEN 'bad_risk_level'
  WHEN NOT ({_NUMBER.format(j="j")} AND TRY_CAST(j->>'$.confidence' AS DOUBLE) BETWEEN 0 AND 1) THEN 'bad_confidence'
  WHEN json_type(j, '$.requires_human_approval') <> 'BOOLEAN' OR j->>'$.requires_human_approval' <> 'true' THEN 'approval_not_required'
  WHEN NOT (json_array_length(j, '$.validation_steps') > 0 AND {_steps_ok("j", "validation_steps")}) THEN 'bad_steps'
  WHEN j->>'$.action_type' IN {_in(V.READ_ONLY_ACTION_TYPES)} AND j->>'$.rollback_plan' <> '{NO_CHANGE}' THEN 'bad_rollback'
  END AS reject_reason FROM p)"""


@query("proposal_validation", f"""{cte("proposal_json")}, {_JUDGED}
SELECT okey, reject_reason, CASE WHEN reject_reason IS NULL THEN kind END AS action_type,
CASE WHEN reject_reason IS NULL THEN target END AS target FROM judged""")
def proposal_validation(spark, sf):
    return _proposals(spark, sf).select("okey", "reject_reason", "proposal.action_type", "proposal.target")


def _proposals(spark, sf):
    return PR.validate_proposals(view(spark, sf, "proposal_json"), "response")


@query("compact_contexts", f"""SELECT conv_id, turn, role AS task_id, md5(substring(split_part(r, chr(10), 1), 1, 1000)) AS message,
CASE WHEN turn % 3 = 0 THEN CAST(turn AS VARCHAR) END AS try_number, CAST(NULL AS VARCHAR) AS dag_id
FROM (SELECT *, {_EVIDENCE} AS r FROM conversations)""")
def compact_contexts(spark, sf):
    """Contexts as loose JSON: one attempt number in three is a real integer, the pipeline is a number and so dropped."""
    turn = F.col("turn")
    number = (F.when(turn % 3 == 0, turn.cast("string")).when(turn % 3 == 1, F.concat(turn, F.lit(".0")))
              .otherwise(F.concat(F.lit('"'), turn, F.lit('"'))))
    # to_json escapes the free text; the loose number is spliced in as it is.
    known = F.to_json(F.struct(F.col("role").alias("task_id"), F.col("text").alias("exception_message"),
                               F.lit(5).alias("dag_id"), F.lit("x").alias("unknown_field")))
    rows = spark.read.parquet(f"{sf}/conversations.parquet").withColumn(
        "j", F.concat(F.lit('{"try_number":'), number, F.lit(","), F.substring(known, 2, 1 << 30)))
    return PR.compact_contexts(rows, "j", SECRETS).select(
        "conv_id", "turn", "context.task_id", F.md5("context.exception_message").alias("message"),
        F.col("context.try_number").cast("string").alias("try_number"), "context.dag_id")


# --- policy -------------------------------------------------------------------------

def _fires(pattern: str) -> str:
    return f"len(list_filter(texts, lambda t: regexp_matches(t, '{pattern}'))) > 0"


_FIRED = ", ".join([f"CASE WHEN {_fires(p)} THEN '{rule}' END" for rule, p in V.DANGEROUS_PATTERNS]
                   + [f"CASE WHEN kind IN {_in(V.READ_ONLY_ACTION_TYPES)} AND regexp_matches(lower(action), "
                      f"'{V.WRITE_PATTERN}') THEN '{V.MISMATCH_RULE}' END"])
_LOOKUP = ", ".join(f"('{k}', '{r}', '{d}', '{a}')" for k, (r, d, a) in V.ACTION_POLICY.items())
_POLICY = f"""{_JUDGED},
texts AS (SELECT *, list_transform(list_concat({"[" + ", ".join(f"j->>'$.{f}'" for f in V.PROPOSAL_TEXT_FIELDS) + "]"},
    CAST(json_extract_string(j, '$.validation_steps[*]') AS VARCHAR[])),
    lambda t: trim(regexp_replace(regexp_replace(lower(t), '/\\*.*?\\*/', ' ', 'g'), '\\s+', ' ', 'g'))) AS texts
  FROM judged WHERE reject_reason IS NULL),
fired AS (SELECT *, list_filter([{_FIRED}], lambda r: r IS NOT NULL) AS blocked FROM texts),
table_of(kind, risk, decision, eligible) AS (VALUES {_LOOKUP}),
policy AS (SELECT f.*, CASE WHEN len(blocked) > 0 THEN 'block' ELSE t.decision END AS decision,
  CASE WHEN len(blocked) > 0 THEN 'high' ELSE t.risk END AS risk,
  CASE WHEN len(blocked) > 0 THEN '' ELSE t.eligible END AS allowed FROM fired f JOIN table_of t USING (kind))"""


def _policies(spark, sf):
    judged = cut_lineage(_proposals(spark, sf).drop("response"), "proposals")
    return PO.evaluate_policy(judged.where("reject_reason IS NULL").drop("reject_reason"))


@query("policy_decisions", f"""{cte("proposal_json")}, {_POLICY} SELECT okey, decision, risk AS calculated_risk,
array_to_string(blocked, ',') AS blocked_actions, allowed AS allowed_actions,
CASE WHEN len(blocked) > 0 THEN array_to_string(blocked, ',') ELSE kind || '_is_' || risk || '_risk,' || CASE kind WHEN 'no_change' THEN 'no_operation'
 ELSE 'approval_before_action' END || ',human_approval_mandatory' END AS reasons FROM policy""")
def policy_decisions(spark, sf):
    return _policies(spark, sf).select(
        "okey", "policy.decision", "policy.calculated_risk",
        F.array_join("policy.blocked_actions", ",").alias("blocked_actions"),
        F.array_join("policy.allowed_actions", ",").alias("allowed_actions"), F.array_join("policy.reasons", ",").alias("reasons"))


@query("policy_rule_counts", f"""{cte("proposal_json")}, {_POLICY} SELECT rule, count(*) AS proposals
FROM (SELECT unnest(blocked) AS rule FROM policy) GROUP BY rule""")
def policy_rule_counts(spark, sf):
    return PO.explode_rules(_policies(spark, sf), ["okey"]).groupBy("rule").agg(F.count("*").alias("proposals"))


# --- approvals -----------------------------------------------------------------------

def _approvals(spark, sf):
    """Approval records; some requests carry a policy that is not the evaluated one."""
    rows = cut_lineage(_policies(spark, sf), "policies").select(
        "okey", "proposal", F.struct(*_IDS).alias("context"), F.col("policy").alias("evaluated"), F.concat(F.lit("ap_"), "okey").alias("approval_id"),
        F.when(F.col("okey") % 29 == 0, F.col("policy").withField("decision", F.lit("allow")))
        .otherwise(F.col("policy")).alias("policy"))
    return AP.create_approvals(rows, evaluated="evaluated")


_CREATED = """created AS (SELECT *, 'ap_' || okey AS approval_id,
  CASE WHEN okey % 29 = 0 AND decision <> 'allow' THEN 'policy_mismatch' END AS refused,
  CASE WHEN decision = 'block' THEN 'BLOCKED' ELSE 'PENDING_APPROVAL' END AS initial FROM policy)"""


@query("approval_records", f"""{cte("proposal_json")}, {_POLICY}, {_CREATED}
SELECT okey, refused AS reject_reason, CASE WHEN refused IS NULL THEN initial END AS status,
CASE WHEN refused IS NULL THEN risk END AS calculated_risk FROM created""")
def approval_records(spark, sf):
    return _approvals(spark, sf).select("okey", "reject_reason", "approval.status", "approval.calculated_risk")


_TIME_OK = "record->>'$.decision_timestamp' IN ('2024-03-01T10:00:00+00:00', '2024-03-01T10:00:00Z')"


_APPROVAL_REASON = f"""CASE WHEN json_exists(record, '$.note') THEN 'wrong_fields'
WHEN json_type(record, '$.decision_timestamp') NOT IN ('VARCHAR', 'NULL') THEN 'bad_decision_fields'
WHEN trim(record->>'$.dag_run_id') = '' THEN 'blank_text'
WHEN record->>'$.status' NOT IN {_in(V.APPROVAL_STATUSES)} THEN 'bad_value'
WHEN (record->>'$.policy_decision' = 'block') <> (record->>'$.status' = 'BLOCKED') THEN 'block_mismatch'
WHEN record->>'$.status' IN ('PENDING_APPROVAL', 'BLOCKED') THEN
  CASE WHEN record->>'$.approved_by' IS NOT NULL OR record->>'$.decision_timestamp' IS NOT NULL THEN 'decision_on_undecided' END
WHEN trim(coalesce(record->>'$.approved_by', '')) = '' THEN 'no_reviewer'
WHEN NOT coalesce({_TIME_OK}, false) THEN 'bad_decision_time' END"""


@query("approval_validation", f"""{cte("approval_json")}, a AS (SELECT okey, CAST(record AS JSON) AS record FROM approval_json)
SELECT okey, {_APPROVAL_REASON} AS reject_reason FROM a""")
def approval_validation(spark, sf):
    return AP.validate_approvals(view(spark, sf, "approval_json"), "record").select("okey", "reject_reason")


def _decided(spark, sf):
    made = cut_lineage(_approvals(spark, sf), "approvals").where("reject_reason IS NULL").drop("reject_reason")
    return AP.apply_decisions(made, view(spark, sf, "decisions"))


_DECIDED = """usable AS (SELECT *, CASE WHEN decided_at LIKE '%+02:00' THEN replace(replace(decided_at, 'T12:', 'T10:'), '+02:00', '+00:00')
  ELSE decided_at END AS iso FROM decisions WHERE command IN ('approve', 'reject') AND trim(reviewer) <> '' AND decided_at LIKE '%+0_:00'),
first_decision AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY seq) AS rn FROM usable) WHERE rn = 1),
decided AS (SELECT c.* EXCLUDE (initial), CASE WHEN initial = 'BLOCKED' OR d.command IS NULL THEN initial
    WHEN d.command = 'approve' THEN 'APPROVED' ELSE 'REJECTED' END AS status,
  CASE WHEN initial <> 'BLOCKED' THEN d.reviewer END AS approved_by, CASE WHEN initial <> 'BLOCKED' THEN d.iso END AS decision_timestamp
  FROM created c LEFT JOIN first_decision d USING (approval_id) WHERE c.refused IS NULL)"""


@query("approval_decisions", f"""{cte("proposal_json", "decisions")}, {_POLICY}, {_CREATED}, {_DECIDED}
SELECT approval_id, status, approved_by, decision_timestamp FROM decided""")
def approval_decisions(spark, sf):
    return _decided(spark, sf).select("approval.approval_id", "approval.status", "approval.approved_by",
                                      "approval.decision_timestamp")


@query("decision_times", f"""{cte("decisions")} SELECT approval_id, seq,
CASE WHEN decided_at LIKE '%+0_:00' THEN CASE WHEN decided_at LIKE '%+02:00' THEN '7200' ELSE '0' END END AS offset_seconds,
CASE WHEN decided_at LIKE '%+02:00' THEN replace(replace(decided_at, 'T12:', 'T10:'), '+02:00', '+00:00')
WHEN decided_at LIKE '%+00:00' THEN decided_at END AS iso,
decided_at LIKE '%+00:00' AS is_utc,
coalesce(CASE WHEN decided_at LIKE '%+0_:00' THEN CAST(decided_at AS TIMESTAMPTZ) BETWEEN TIMESTAMPTZ '2024-03-01 10:00:00+00'
 AND TIMESTAMPTZ '2024-03-01 10:15:00+00' END, false) AS fresh FROM decisions""")
def decision_times(spark, sf):
    at = aware_timestamp(F.col("decided_at"))
    now = F.lit("2024-03-01T10:15:00Z").cast("timestamp")
    return view(spark, sf, "decisions").select(
        "approval_id", "seq", offset_seconds(F.col("decided_at")).cast("string").alias("offset_seconds"),
        iso_utc(at).alias("iso"), utc_timestamp(F.col("decided_at")).isNotNull().alias("is_utc"),
        is_fresh(now, at).alias("fresh"))


# --- executions ------------------------------------------------------------------------

def _requests(spark, sf):
    """One requested investigation per decided approval; every kind of refusal occurs."""
    k = F.col("okey")
    rows = cut_lineage(_decided(spark, sf), "decided")
    ctx = F.when(k % 53 == 0, F.col("context").withField("dag_run_id", F.lit("run_other"))).otherwise(F.col("context"))
    # Approved before somebody added a step that no policy allows.
    stopped = F.struct(F.lit("block").alias("decision"), F.lit("high").alias("calculated_risk"), F.array(F.lit("drop_database_objects")).alias("reasons"),
                       F.array().cast("array<string>").alias("allowed_actions"), F.array(F.lit("drop_database_objects")).alias("blocked_actions"),
                       F.lit(True).alias("requires_human_approval")).cast(S.struct_ddl(S.POLICY_DDL))
    p = F.col("proposal")
    proposal = (F.when(k % 71 == 0, p.withField("confidence", F.lit(2.0)))
                .when(k % 73 == 0, p.withField("validation_steps", F.array(F.lit("Drop table x"))).withField("proposed_action", F.lit("Look"))).otherwise(p))
    own = F.when(k % 71 == 0, F.lit(None)).when(k % 73 == 0, stopped).otherwise(F.col("evaluated"))
    given = F.when(k % 73 == 0, stopped).otherwise(F.col("policy"))
    policy = F.when(k % 59 == 0, given.withField("reasons", F.array(F.lit("other")))).otherwise(given)
    a = F.col("approval")
    approval = (F.when(k % 67 == 0, a.withField("approved_by", F.lit(" "))).when(k % 61 == 0, a.withField("proposed_action", F.lit("Other"))).otherwise(a))
    return rows.select(
        "okey", approval.alias("approval"), proposal.alias("proposal"), own.alias("evaluated"), policy.alias("policy"), ctx.alias("context"),
        F.when(k % 47 == 0, " ").otherwise(F.concat(F.lit("ex_"), k)).alias("execution_id"),
        F.when(k % 37 == 0, "rerun_task").otherwise(V.READ_ONLY_OPERATION).alias("operation"),
        F.when(k % 41 == 0, "2024-03-01T09:59:00+00:00").otherwise("2024-03-01T11:00:00+00:00").alias("started_at"),
        F.when(k % 43 == 0, "2024-03-01T09:00:00Z").otherwise("2024-03-01T11:00:05Z").alias("completed_at"))


_AUDIT = f"""{_CREATED}, {_DECIDED},
audit AS (SELECT *, CASE
  WHEN okey % 47 = 0 OR okey % 43 = 0 THEN 'bad_id_or_times'
  WHEN okey % 67 = 0 THEN 'bad_approval'
  WHEN status <> 'APPROVED' THEN 'not_approved'
  WHEN okey % 37 = 0 THEN 'operation_not_allowed'
  WHEN kind <> 'investigation' THEN 'action_type_not_allowed'
  WHEN okey % 71 = 0 THEN 'invalid_proposal'
  WHEN okey % 59 = 0 THEN 'policy_mismatch'
  WHEN okey % 73 = 0 THEN 'policy_forbids'
  WHEN okey % 61 = 0 THEN 'approval_mismatch'
  WHEN okey % 53 = 0 THEN 'other_incident'
  WHEN okey % 41 = 0 THEN 'approved_after_start' END AS refusal FROM decided)"""


def _executions(spark, sf):
    return EX.audit_executions(_requests(spark, sf), evaluated="evaluated")


@query("execution_audit", f"""{cte("proposal_json", "decisions")}, {_POLICY}, {_AUDIT}
SELECT okey, refusal, CASE WHEN refusal IS NULL THEN 'COMPLETED' ELSE 'REFUSED' END AS status,
CASE WHEN coalesce(refusal, '') NOT IN ('bad_id_or_times', 'bad_approval') THEN approval_id END AS approval_id,
CASE WHEN okey % 37 <> 0 THEN 'read_only_investigation' END AS operation,
CASE WHEN okey % 41 = 0 THEN '2024-03-01T09:59:00+00:00' ELSE '2024-03-01T11:00:00+00:00' END AS started_at FROM audit""")
def execution_audit(spark, sf):
    return _executions(spark, sf).select("okey", "refusal", "execution.status", "execution.approval_id",
                                         "execution.operation", "execution.started_at")


@query("execution_audit_joined", f"""{cte("proposal_json", "decisions")}, {_POLICY}, {_AUDIT}
SELECT coalesce(refusal, 'accepted') AS outcome, count(*) AS requests FROM audit GROUP BY 1""")
def execution_audit_joined(spark, sf):
    """The same audit with its inputs joined from stage tables by their ids."""
    rows = _requests(spark, sf).withColumn("proposal_id", F.col("okey"))
    executions = rows.select("okey", "proposal_id", F.col("approval.approval_id").alias("approval_id"),
                             "execution_id", "operation", "started_at", "completed_at")
    joined = EX.match_requests(executions, rows.select("approval"), rows.select("proposal_id", "proposal", "policy"),
                               rows.select("proposal_id", "context"))
    return EX.audit_executions(joined).groupBy(F.coalesce("refusal", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("requests"))


_E = "e"
_EID = " AND ".join(f"json_type({_E}, '$.{f}') = 'VARCHAR' AND trim({_E}->>'$.{f}') <> '' AND {_E}->>'$.{f}' = {f}" for f in _IDS)
_POST = f"""x AS (SELECT *, CAST(execution_json AS JSON) AS e FROM execution_json),
y AS (SELECT *, e->>'$.status' AS st, e->>'$.operation' AS op, e->>'$.result.mutations_performed' AS mut,
  CASE WHEN e->>'$.started_at' SIMILAR TO '.*(Z|[+]00:00)' THEN CAST(replace(e->>'$.started_at', 'Z', '+00:00') AS TIMESTAMPTZ) END AS t0,
  CAST(e->>'$.completed_at' AS TIMESTAMPTZ) AS t1 FROM x),
post AS (SELECT *, CASE
  WHEN trim(dag_run_id) = '' THEN 'bad_context_ids'
  WHEN json_exists(e, '$.repair_verified') THEN 'wrong_fields'
  WHEN trim(e->>'$.execution_id') = '' THEN 'bad_execution_id'
  WHEN st NOT IN {_in(V.EXECUTION_STATUSES)} THEN 'bad_status'
  WHEN NOT ({_EID}) THEN 'other_incident'
  WHEN NOT (json_type(e, '$.approval_id') = 'VARCHAR' OR (st = 'REFUSED' AND json_type(e, '$.approval_id') = 'NULL'))
    OR NOT (json_type(e, '$.operation') = 'VARCHAR' OR (st = 'REFUSED' AND json_type(e, '$.operation') = 'NULL')) THEN 'missing_metadata'
  WHEN json_type(e, '$.result') <> 'OBJECT' OR json_type(e, '$.result.mutations_performed') <> 'BOOLEAN' THEN 'malformed_result'
  WHEN t0 IS NULL THEN 'bad_times'
  WHEN t1 < t0 OR t1 > CAST('2024-03-01 11:07:30+00' AS TIMESTAMPTZ) THEN 'times_out_of_order'
  WHEN op = 'read_only_investigation' AND mut = 'true' THEN 'read_only_mutated'
  WHEN st = 'REFUSED' AND mut = 'true' THEN 'refused_mutated' END AS defect FROM y)"""


@query("post_action", f"""{cte("execution_json")}, {_POST} SELECT okey,
CASE WHEN defect IS NOT NULL THEN 'INCONCLUSIVE' WHEN st IN ('REFUSED', 'FAILED') THEN 'EXECUTION_FAILED'
WHEN op = 'read_only_investigation' AND mut = 'false' THEN 'NOT_REPAIRED' ELSE 'INCONCLUSIVE' END AS validation_status,
CASE WHEN defect IS NOT NULL THEN defect WHEN st IN ('REFUSED', 'FAILED') THEN 'execution_did_not_complete'
WHEN op = 'read_only_investigation' AND mut = 'false' THEN 'read_only_completed' ELSE 'completion_is_not_health' END AS reason,
CASE WHEN defect IS NULL THEN CASE WHEN st = 'COMPLETED' THEN 'true' ELSE 'false' END END AS execution_completed,
CASE WHEN defect IS NULL THEN mut END AS mutations_performed,
CASE WHEN coalesce(defect, '') NOT IN ('bad_context_ids', 'wrong_fields', 'bad_execution_id') THEN e->>'$.execution_id' END AS execution_id
FROM post""")
def post_action(spark, sf):
    rows = view(spark, sf, "execution_json").withColumn("context", F.struct(*_IDS))
    v = F.col("validation")
    return PA.validate_post_action(rows).select(
        "okey", v["validation_status"].alias("validation_status"), v["reason"].alias("reason"),
        v["execution_completed"].cast("string").alias("execution_completed"),
        v["mutations_performed"].cast("string").alias("mutations_performed"), v["execution_id"].alias("execution_id"))


# --- playbooks --------------------------------------------------------------------------

def _cases(spark, sf):
    return view(spark, sf, "cases").select(
        "okey", F.struct(*_IDS, "exception_type", "exception_message").alias("context"))


_MATCHED = """matched AS (SELECT c.*, p.playbook, p.target, p.proposed_action FROM cases c LEFT JOIN playbooks p
  ON p.dag_id = c.dag_id AND p.task_id = c.task_id AND p.exception_type = c.exception_type
  AND starts_with(c.exception_message, p.message_prefix))"""


@query("playbook_match", f"{cte('cases', 'playbooks')}, {_MATCHED} SELECT okey, playbook FROM matched")
def playbook_match(spark, sf):
    return PB.match_playbooks(_cases(spark, sf), view(spark, sf, "playbooks")).select("okey", "known.playbook")


@query("playbook_proposals", f"""{cte('cases', 'playbooks')}, {_MATCHED} SELECT okey, playbook, target, proposed_action,
'configuration_change' AS action_type, 'require_approval' AS decision, 'medium' AS calculated_risk, playbook AS allowed_actions
FROM matched WHERE playbook IS NOT NULL""")
def playbook_proposals(spark, sf):
    playbooks = view(spark, sf, "playbooks")
    rows = PB.propose_playbooks(_cases(spark, sf), playbooks).where("valid")
    return PO.evaluate_policy(rows, playbooks=playbooks).select(
        "okey", "playbook", "proposal.target", "proposal.proposed_action", "proposal.action_type",
        "policy.decision", "policy.calculated_risk", F.array_join("policy.allowed_actions", ",").alias("allowed_actions"))


def _playbook_requests(spark, sf):
    """A request per failure; what is wrong with it depends on its key."""
    playbooks = cut_lineage(view(spark, sf, "playbooks"), "playbooks")
    k, p, policy, ctx = F.col("okey"), PB.fixed_proposal(F.col("known")), F.col("expected_policy"), F.col("context")
    approval = F.struct(
        F.concat(F.lit("pa_"), k).alias("approval_id"),
        F.when(k % 5 == 0, "REJECTED").otherwise("APPROVED").alias("status"), ctx["dag_id"].alias("dag_id"),
        F.when(k % 11 == 0, "run_other").otherwise(ctx["dag_run_id"]).alias("dag_run_id"),
        ctx["task_id"].alias("task_id"), p["action_type"].alias("action_type"),
        policy["calculated_risk"].alias("calculated_risk"), p["proposed_action"].alias("proposed_action"),
        policy["decision"].alias("policy_decision"), F.when(k % 19 == 0, F.lit(None)).otherwise("ann").alias("approved_by"),
        F.lit("2024-03-01T10:00:00+00:00").alias("decision_timestamp"))
    rows = PB.with_expectations(_cases(spark, sf), playbooks)
    return playbooks, cut_lineage(rows, "expected").select(
        "okey", "context", F.when(k % 13 == 0, p.withField("target", F.lit("config/elsewhere.json"))).otherwise(p).alias("proposal"),
        F.when(k % 23 == 0, policy.withField("allowed_actions", F.array(F.lit("configuration_change")))).otherwise(policy).alias("policy"),
        approval.alias("approval"),
        F.when(k % 17 == 0, "old").otherwise(F.concat(F.lit("pa_"), k)).alias("current_approval_id"),
        F.timestamp_seconds(F.lit(1709287200) + (k % 20) * 60).alias("now"))


_AUTHORIZE = f"""{_MATCHED}, authorized AS (SELECT *, CASE WHEN playbook IS NULL THEN 'no_playbook'
  WHEN okey % 19 = 0 THEN 'bad_approval'
  WHEN okey % 5 = 0 OR okey % 17 = 0 OR okey % 11 = 0 THEN 'approval_not_current'
  WHEN okey % 20 > 15 THEN 'approval_expired'
  WHEN okey % 13 = 0 OR okey % 23 = 0 THEN 'not_the_fixed_proposal' END AS refusal FROM matched)"""


@query("playbook_authorization", f"""{cte('cases', 'playbooks')}, {_AUTHORIZE} SELECT okey, playbook, refusal,
CASE WHEN refusal IS NULL THEN 'AUTHORIZED' ELSE 'REFUSED' END AS "authorization" FROM authorized""")
def playbook_authorization(spark, sf):
    playbooks, rows = _playbook_requests(spark, sf)
    return PB.authorize_playbooks(rows, playbooks).select("okey", "playbook", "refusal", "authorization")


@query("rerun_authorization", f"""{cte('cases', 'playbooks')}, {_AUTHORIZE} SELECT okey,
CASE WHEN playbook IS NULL THEN 'no_playbook' WHEN okey % 7 = 3 THEN 'bad_run_id' WHEN refusal IS NOT NULL THEN refusal
WHEN okey % 29 = 0 THEN 'bad_attempt' WHEN okey % 31 = 0 THEN 'remediation_not_completed'
WHEN okey % 3 = 2 THEN 'remediation_not_completed' END AS refusal FROM authorized""")
def rerun_authorization(spark, sf):
    playbooks, rows = _playbook_requests(spark, sf)
    k, ctx = F.col("okey"), F.col("context")
    number = F.regexp_extract(F.col("proposal.target"), r"(\d+)", 1)
    # The change as stored, in another key order; every third one is not the expected change.
    changes = F.concat(F.lit('[{"after":{"fail":'), F.when(k % 3 == 2, "true").otherwise("false"),
                       F.lit('},"before":{"fail":true},"target":"config/input_'), number, F.lit('.json"}]'))
    rows = rows.select(
        "*", F.when(k % 7 == 3, ctx["dag_run_id"]).otherwise(F.concat(F.lit(V.VERIFICATION_RUN_PREFIX), k)).alias("verification_run_id"),
        F.when(k % 29 == 0, "other").otherwise(F.get("policy.allowed_actions", F.lit(0))).alias("attempt_playbook"),
        F.when(k % 31 == 0, "FAILED").otherwise("COMPLETED").alias("attempt_status"),
        ctx["dag_id"].alias("attempt_dag_id"), ctx["task_id"].alias("attempt_task_id"),
        changes.alias("attempt_changes"), F.lit(None).cast("string").alias("attempt_error"),
        F.lit(False).alias("attempt_verified"))
    return VR.authorize_reruns(rows, playbooks).select("okey", "refusal")
