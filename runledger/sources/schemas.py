"""Explicit schemas of the input and state tables."""

from functools import lru_cache

from pyspark.sql.types import _parse_datatype_string


@lru_cache(maxsize=None)
def _schema(ddl: str):
    return _parse_datatype_string(ddl)


TRANSACTIONS_DDL = (
    "transaction_id BIGINT, customer_id STRING, amount DECIMAL(18,2), status STRING, "
    "transaction_date DATE, updated_at TIMESTAMP")
WATERMARK_DDL = "pipeline_name STRING, last_processed_at TIMESTAMP"
RUNS_DDL = "dag_id STRING, dag_run_id STRING, state STRING, start_date TIMESTAMP"
TASK_INSTANCES_DDL = (
    "dag_id STRING, dag_run_id STRING, task_id STRING, state STRING, try_number INT, "
    "start_date TIMESTAMP, end_date TIMESTAMP, map_index INT")
OBSERVATIONS_DDL = "dag_id STRING, dag_run_id STRING, observed_at TIMESTAMP, state STRING"
LOG_LINES_DDL = (
    "dag_id STRING, dag_run_id STRING, task_id STRING, try_number INT, map_index INT, "
    "seq BIGINT, line STRING")
DECISIONS_DDL = "approval_id STRING, seq BIGINT, command STRING, reviewer STRING, decided_at STRING"

CONTEXT_DDL = (
    "dag_id STRING, dag_run_id STRING, task_id STRING, try_number BIGINT, exception_type STRING, "
    "exception_message STRING, source_file STRING, source_line BIGINT, failed_function STRING, "
    "error_timestamp STRING")
RCA_DDL = (
    "summary STRING, root_cause STRING, evidence ARRAY<STRING>, recommended_action STRING, "
    "risk_level STRING, confidence DOUBLE, requires_human_approval BOOLEAN")
PROPOSAL_DDL = (
    "incident_summary STRING, proposed_action STRING, action_type STRING, target STRING, reason STRING, "
    "risk_level STRING, confidence DOUBLE, requires_human_approval BOOLEAN, "
    "validation_steps ARRAY<STRING>, rollback_plan STRING")
POLICY_DDL = (
    "decision STRING, calculated_risk STRING, reasons ARRAY<STRING>, allowed_actions ARRAY<STRING>, "
    "blocked_actions ARRAY<STRING>, requires_human_approval BOOLEAN")
APPROVAL_DDL = (
    "approval_id STRING, status STRING, dag_id STRING, dag_run_id STRING, task_id STRING, "
    "action_type STRING, calculated_risk STRING, proposed_action STRING, policy_decision STRING, "
    "approved_by STRING, decision_timestamp STRING")
EXECUTION_DDL = (
    "execution_id STRING, approval_id STRING, operation STRING, status STRING, dag_id STRING, "
    "dag_run_id STRING, task_id STRING, started_at STRING, completed_at STRING, "
    "result STRUCT<message: STRING, mutations_performed: BOOLEAN>")
PLAYBOOKS_DDL = (
    "playbook STRING, dag_id STRING, task_id STRING, exception_type STRING, message_prefix STRING, "
    "target STRING, proposed_action STRING, incident_summary STRING, reason STRING, risk_level STRING, "
    "validation_steps ARRAY<STRING>, rollback_plan STRING, expected_change STRING")

INCIDENT_DDL = (
    "incident_id STRING, recorded_at STRING, dag_id STRING, dag_run_id STRING, task_id STRING, "
    "historical_only BOOLEAN, "
    "failure STRUCT<exception_type: STRING, exception_message: STRING, source_file: STRING, "
    "source_line: BIGINT, failed_function: STRING>, "
    "rca STRUCT<summary: STRING, root_cause: STRING, confidence: DOUBLE>, "
    "remediation STRUCT<action_type: STRING, proposed_action: STRING, risk_level: STRING>, "
    "policy STRUCT<decision: STRING, calculated_risk: STRING>, "
    "approval STRUCT<status: STRING, approved_by: STRING, decision_timestamp: STRING>, "
    "execution STRUCT<operation: STRING, status: STRING, mutations_performed: BOOLEAN>, "
    "validation STRUCT<validation_status: STRING, repair_verified: BOOLEAN, reason: STRING>")
ATTEMPT_DDL = (
    f"playbook STRING, proposal STRUCT<{PROPOSAL_DDL}>, policy STRUCT<{POLICY_DDL}>, "
    f"approval STRUCT<{APPROVAL_DDL}>, "
    "execution STRUCT<playbook: STRING, status: STRING, dag_id: STRING, task_id: STRING, "
    "changes: VARIANT, message: STRING>, final_state STRING, repair_verified BOOLEAN, error STRING")
VERIFICATION_DDL = (
    "original_dag_run_id STRING, verification_dag_run_id STRING, dag_id STRING, trigger_status STRING, "
    "dag_run_state STRING, task_states MAP<STRING,STRING>, repair_verified BOOLEAN, "
    "verification_status STRING, reason STRING")
OUTCOME_DDL = "state STRING, repair_verified BOOLEAN"


def struct(ddl: str):
    """Parsed form of one of the schemas above."""
    return _schema(ddl)


def struct_ddl(ddl: str) -> str:
    return f"STRUCT<{ddl}>"
