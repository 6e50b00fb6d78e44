"""Input tables derived from the benchmark tables.

Each view is one SQL text, valid in Spark and in the checking engine alike, so
both sides start from the same rows. Every view covers its whole base table;
operators never appear here, only column expressions and key joins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from runledger.session import spread

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
               "embeddings", "pages", "benchmark", "labels", "conversations")

PIPELINE = "daily_transactions"
MARK = "2024-01-10 00:00:00"
REQUIRED_TASKS = ("task_1", "task_2")
WATCH_SECONDS = 86_400
SECRETS = ("hunter2-hunter2", "plum")


def pick(expr: str, options, cast: str = "") -> str:
    """``CASE`` over ``expr % len(options)``."""
    arms = " ".join(f"WHEN {i} THEN {value}" for i, value in enumerate(options))
    return f"(CASE {expr} % {len(options)} {arms} END)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


KINDS = ("investigation", "code_change", "configuration_change", "data_correction", "no_change")
LEVELS = ("low", "medium", "high")
ACTIONS = (
    "Look at the feed layout", "Review the recent run history", "Update production schema",
    "DROP TABLE customers", "Delete old rows", "Truncate the staging area", "Wipe the cache",
    "Remove the failing pipelines", "Turn off the firewall", "Print all API keys",
    "Skip the review", "Run bash to check", "git reset --hard", "docker compose down",
    "Set the flag to false", "Compare counts with yesterday", "Auto-approve the change",
)
STEPS = (
    "Check that every column arrives.", "After a future approved change, rerun the task and confirm success.",
    "DROP /* now */ SCHEMA public", "Check the report totals.", "Expose passwords", "kubectl delete pods",
    "Observe two further runs.",
)
PROPOSAL_DEFECTS = 9  # of 23 residues
NO_CHANGE = "Not applicable: no change is proposed."

VIEWS: dict[str, str] = {}

VIEWS["raw_transactions"] = """
SELECT user_id * 100 + CAST(substring(props, 7, length(props) - 7) AS BIGINT) AS transaction_id,
       CASE WHEN user_id % 10 = 0 THEN 'TEST' || user_id WHEN user_id % 23 = 0 THEN NULL ELSE 'C' || user_id END AS customer_id,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS amount,
       CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' ELSE 'COMPLETED' END AS status,
       CAST(ts AS DATE) AS transaction_date, CAST(ts AS TIMESTAMP) AS updated_at
FROM {events}"""

VIEWS["watermarks"] = f"""
SELECT '{PIPELINE}' AS pipeline_name, CAST('{MARK}' AS TIMESTAMP) AS last_processed_at
UNION ALL SELECT 'hourly_customers' AS pipeline_name, CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS last_processed_at"""

VIEWS["runs"] = """
SELECT 'dag_' || (o_custkey % 20) AS dag_id, 'run_' || o_orderkey AS dag_run_id,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS state,
       CAST(o_orderdate AS TIMESTAMP) AS start_date
FROM {orders}"""

VIEWS["task_instances"] = """
SELECT 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || l.l_orderkey AS dag_run_id,
       'task_' || l.l_linenumber AS task_id,
       CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' AND l.l_linenumber >= 2 THEN 'failed'
            WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_linenumber >= 3 THEN 'upstream_failed'
            ELSE 'success' END AS state,
       1 AS try_number, CAST(l.l_shipdate AS TIMESTAMP) AS start_date,
       CAST(NULL AS TIMESTAMP) AS end_date, -1 AS map_index
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey"""

VIEWS["observations"] = """
SELECT 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || e.user_id AS dag_run_id, CAST(e.ts AS TIMESTAMP) AS observed_at,
       CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'success'
            WHEN 'error' THEN 'failed' ELSE 'restarting' END AS state, e.user_id AS user_id
FROM {events} e JOIN {orders} o ON o.o_orderkey = e.user_id"""

VIEWS["triggers"] = """
SELECT 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || e.user_id AS dag_run_id, e.user_id AS user_id,
       min(CAST(e.ts AS TIMESTAMP)) AS trigger_started_at
FROM {events} e JOIN {orders} o ON o.o_orderkey = e.user_id GROUP BY 1, 2, 3"""

# The tasks of triggered runs, read around the deadline: some before the run has settled, some too late.
VIEWS["task_reads"] = """
SELECT 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || l.l_orderkey AS dag_run_id, 'task_' || l.l_linenumber AS task_id,
       CASE WHEN l.l_linenumber > 5 AND l.l_returnflag = 'A' THEN 'failed' ELSE 'success' END AS state,
       CASE WHEN l.l_orderkey % 29 = 0 THEN 3 ELSE -1 END AS map_index,
       t.started + (l.l_orderkey % 4) * INTERVAL '8' HOUR + l.l_linenumber * INTERVAL '1' MINUTE AS read_at
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
JOIN (SELECT user_id, min(CAST(ts AS TIMESTAMP)) AS started FROM {events} GROUP BY user_id) t ON t.user_id = l.l_orderkey"""

_FRAME = """'{{"filename":"' || {f} || '","lineno":' || (event_id % 90) || ',"name":"step_' || (event_id % 6) || '"}}'"""


def _frames(*files: str) -> str:
    inner = " || ',' || ".join(_FRAME.replace("{f}", f) for f in files)
    return f"""'"frames":[' || {inner} || ']'"""


_LIB = "'/usr/lib/site-packages/lib_' || (event_id % 3) || '.py'"
_OWN = "'dags/flow_' || (event_id % 4) || '.py'"

# One log line per event: plain text, JSON without detail, an empty detail, a
# library-only chain, and a nested chain whose inner exception is our own code.
VIEWS["log_lines"] = f"""
SELECT 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || o.o_orderkey AS dag_run_id,
       'task_' || (1 + o.o_orderkey % 7) AS task_id, 1 AS try_number, -1 AS map_index, e.event_id AS seq,
       CASE event_type
         WHEN 'view' THEN 'plain line ' || event_id || ' token=' || (event_id % 1000) || ' plum'
         WHEN 'click' THEN '{{{{"event":"progress ' || event_id || '"}}}}'
         WHEN 'signup' THEN '{{{{"event":"noise","error_detail":[{{{{"exc_type":"","exc_value":null,"frames":[]}}}}]}}}}'
         WHEN 'purchase' THEN '{{{{"timestamp":"t' || event_id || '","event":"Task failed with exception","error_detail":[{{{{'
              || '"exc_type":"LibError' || (event_id % 5) || '","exc_value":"password=p' || event_id || ' lost",'
              || {_frames(_LIB, _LIB)} || '}}}}]}}}}'
         ELSE '{{{{"timestamp":"t' || event_id || '","event":"' || (CASE WHEN value > 20 THEN 'Task failed with exception' ELSE 'warning' END)
              || '","error_detail":{{{{"exc_type":"Outer","exc_value":"outer ' || event_id || '",' || {_frames(_LIB)}
              || ',"exceptions":[{{{{"exc_type":"Inner' || (event_id % 7) || '","exc_value":"inner ' || event_id || '",'
              || {_frames(_LIB, _OWN)} || '}}}}]}}}}}}}}' END AS line
FROM {{events}} e JOIN {{orders}} o ON o.o_orderkey = CAST(floor(e.event_id / 4) AS BIGINT)"""

# One failure per run.
VIEWS["cases"] = f"""
SELECT o.o_orderkey AS okey, 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || o.o_orderkey AS dag_run_id,
       'task_' || (o.o_orderkey % 7) AS task_id,
       {pick("o.o_orderkey", [text(x) for x in ("ValueError", "KeyError", "TimeoutError", "IOError")])} AS exception_type,
       c.c_mktsegment || ' ' || o.o_orderpriority || ' e' || (o.o_orderkey % 50) AS exception_message,
       o.o_orderstatus AS phase
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey"""

_K = "o_orderkey"
_DEFECT = f"({_K} % 23)"
_CONFIDENCE = (f"(CASE {_DEFECT} WHEN 0 THEN 'true' WHEN 1 THEN '2' WHEN 6 THEN 'NaN' ELSE '0.' || "
               f"(CASE WHEN {_K} % 100 < 10 THEN '0' ELSE '' END) || ({_K} % 100) END)")


def _proposal_fields(kind: str, action: str, target: str) -> str:
    """JSON text of one proposal."""
    return (
        "'{{\"incident_summary\":\"Run ' || " + _K + " || ' failed\",\"proposed_action\":\"' || " + action +
        " || '\",\"action_type\":\"' || " + kind + " || '\"'"
        f" || (CASE {_DEFECT} WHEN 3 THEN '' ELSE ',\"target\":\"' || " + target + " || '\"' END)"
        f" || ',\"reason\":\"' || (CASE {_DEFECT} WHEN 5 THEN '  ' ELSE 'Evidence ' || {_K} END)"
        " || '\",\"risk_level\":\"' || " + pick(_K, [text(x) for x in LEVELS]) +
        " || '\",\"confidence\":' || " + _CONFIDENCE +
        f" || ',\"requires_human_approval\":' || (CASE {_DEFECT} WHEN 7 THEN 'false' ELSE 'true' END)"
        f" || ',\"validation_steps\":' || (CASE {_DEFECT} WHEN 2 THEN '[]' ELSE '[\"' || " +
        pick(_K, [text(x) for x in STEPS]) + " || '\",\"Check the totals again.\"]' END)"
        f" || ',\"rollback_plan\":\"' || (CASE WHEN {_DEFECT} = 8 THEN 'Undo it.' WHEN " + kind +
        f" IN ('investigation', 'no_change') THEN '{NO_CHANGE}' ELSE 'Restore the previous value.' END) || '\"'"
        f" || (CASE {_DEFECT} WHEN 4 THEN ',\"extra\":1' ELSE '' END) || '}}}}'")


VIEWS["proposal_json"] = f"""
SELECT {_K} AS okey, 'dag_' || (o_custkey % 20) AS dag_id, 'run_' || {_K} AS dag_run_id, 'task_' || ({_K} % 7) AS task_id,
       {_proposal_fields(pick(_K, [text(x) for x in KINDS]), pick(_K, [text(x) for x in ACTIONS]), "'target ' || (" + _K + " % 11)")} AS response
FROM {{orders}}"""

VIEWS["rca_json"] = f"""
SELECT {_K} AS okey,
       '{{{{"choices":[{{{{"finish_reason":"' || (CASE {_DEFECT} WHEN 9 THEN 'length' ELSE 'stop' END)
       || '","message":{{{{"content":"{{{{' || '\\"summary\\":\\"Run ' || {_K} || ' failed\\"'
       || (CASE {_DEFECT} WHEN 3 THEN '' ELSE ',\\"root_cause\\":\\"Late input ' || ({_K} % 13) || '\\"' END)
       || ',\\"evidence\\":' || (CASE {_DEFECT} WHEN 2 THEN '[\\" \\"]' WHEN 10 THEN '[]' WHEN 11 THEN '[1]'
                                 ELSE '[\\"password=x' || {_K} || ' seen\\",\\"count differs\\"]' END)
       || ',\\"recommended_action\\":\\"' || (CASE {_DEFECT} WHEN 5 THEN '' ELSE 'Look at the input' END)
       || '\\",\\"risk_level\\":\\"' || {pick(_K, [text(x) for x in LEVELS + ("severe",)])}
       || '\\",\\"confidence\\":' || {_CONFIDENCE}
       || ',\\"requires_human_approval\\":' || (CASE {_DEFECT} WHEN 7 THEN '\\"true\\"' ELSE 'true' END)
       || (CASE {_DEFECT} WHEN 4 THEN ',\\"extra\\":1' ELSE '' END) || '}}}}"}}}}}}}}]}}}}' AS response
FROM {{orders}}"""

_DECISION = f"""
SELECT 'ap_' || {_K} AS approval_id, {_K} * 3 + @n AS seq, @command AS command, @reviewer AS reviewer, @at AS decided_at
FROM {{orders}}"""
_COMMANDS = (("'approve'", "'APPROVE'", "' approve'", "''", "'reject'", "'approve'"),
             ("'reject'", "'approve'", "'reject'", "'approve'", "'approve'", "'approve'"), ("'approve'",))
_REVIEWERS = (f"CASE WHEN {_K} % 6 = 5 THEN ' ' ELSE 'reviewer_' || ({_K} % 9) END", f"'reviewer_' || ({_K} % 9)",
              "'lead'")
_TIMES = (f"'2024-03-01T10:0' || ({_K} % 10) || ':00+00:00'",
          f"CASE WHEN {_K} % 6 = 3 THEN '2024-03-01T10:00:00' ELSE '2024-03-01T10:0' || ({_K} % 10) || ':00+00:00' END",
          f"'2024-03-01T12:3' || ({_K} % 10) || ':00+02:00'")
VIEWS["decisions"] = "\nUNION ALL".join(
    _DECISION.replace("@n", str(n)).replace("@command", pick(_K, _COMMANDS[n])).replace("@reviewer", _REVIEWERS[n])
    .replace("@at", _TIMES[n]) for n in range(3))

# Approval records as JSON text, with every kind of inconsistency.
VIEWS["approval_json"] = f"""
SELECT {_K} AS okey,
       '{{{{"approval_id":"ap_' || {_K} || '","status":"' || {pick(_K, [text(x) for x in ("PENDING_APPROVAL", "APPROVED", "REJECTED", "BLOCKED", "DONE")])}
       || '","dag_id":"dag_' || (o_custkey % 20) || '","dag_run_id":"' || (CASE {_K} % 37 WHEN 0 THEN ' ' ELSE 'run_' || {_K} END)
       || '","task_id":"task_' || ({_K} % 7) || '","action_type":"' || {pick(_K, [text(x) for x in KINDS])}
       || '","calculated_risk":"' || {pick(_K, [text(x) for x in LEVELS])} || '","proposed_action":"Look"'
       || ',"policy_decision":"' || {pick(_K, [text(x) for x in ("allow", "require_approval", "block", "require_approval", "allow", "require_approval", "block")])}
       || '","approved_by":' || {pick(_K, ["'null'", "'null'", "'\"ann\"'", "'\"bob\"'", "'\" \"'", "'null'"])}
       || ',"decision_timestamp":' || {pick(_K, ["'null'", "'null'", "'\"2024-03-01T10:00:00+00:00\"'", "'\"2024-03-01T10:00:00Z\"'", "'null'", "'\"2024-03-01T10:00:00\"'", "'5'", "'null'"])}
       || (CASE {_K} % 31 WHEN 0 THEN ',"note":"x"' ELSE '' END) || '}}}}' AS record
FROM {{orders}}"""

# Execution results as JSON text beside the context they should belong to.
VIEWS["execution_json"] = f"""
SELECT {_K} AS okey, 'dag_' || (o_custkey % 20) AS dag_id, (CASE {_K} % 61 WHEN 0 THEN '' ELSE 'run_' || {_K} END) AS dag_run_id,
       'task_' || ({_K} % 7) AS task_id,
       '{{{{"execution_id":"' || (CASE {_K} % 43 WHEN 0 THEN ' ' ELSE 'ex_' || {_K} END)
       || '","approval_id":' || (CASE {_K} % 19 WHEN 0 THEN 'null' WHEN 1 THEN '7' ELSE '"ap_' || {_K} || '"' END)
       || ',"operation":' || (CASE {_K} % 17 WHEN 0 THEN 'null' WHEN 1 THEN '"other_operation"' ELSE '"read_only_investigation"' END)
       || ',"status":"' || {pick(_K, [text(x) for x in ("COMPLETED", "COMPLETED", "REFUSED", "FAILED", "COMPLETED", "REFUSED", "success")])}
       || '","dag_id":"dag_' || (o_custkey % 20) || '","dag_run_id":"run_' || (CASE {_K} % 41 WHEN 0 THEN {_K} + 1 ELSE {_K} END)
       || '","task_id":"task_' || ({_K} % 7)
       || '","started_at":"2024-03-01T11:00:00' || {pick(_K, ["'+00:00'", "'Z'", "'+00:00'", "'+00:00'", "''", "'Z'", "'+01:00'", "'+00:00'", "'+00:00'", "'Z'", "'Z'"])}
       || '","completed_at":"2024-03-01T11:0' || ({_K} % 10) || ':00+00:00"'
       || ',"result":' || {pick(_K, ["'null'"] + ["'{{\"message\":\"done\",\"mutations_performed\":false}}'"] * 10 + ["'{{\"message\":\"done\",\"mutations_performed\":true}}'", "'{{\"message\":\"done\",\"mutations_performed\":0}}'"])}
       || (CASE {_K} % 29 WHEN 0 THEN ',"repair_verified":true' ELSE '' END) || '}}}}' AS execution_json,
       'va_' || {_K} AS validation_id, CAST('2024-03-01 11:07:30' AS TIMESTAMP) AS validated_at
FROM {{orders}}"""

# One known playbook per nation row.
VIEWS["playbooks"] = f"""
SELECT 'restore_input_' || n_nationkey AS playbook, 'dag_' || (n_nationkey % 20) AS dag_id, 'task_' || (n_nationkey % 7) AS task_id,
       {pick("n_nationkey", [text(x) for x in ("ValueError", "KeyError", "TimeoutError", "IOError")])} AS exception_type,
       {pick("n_nationkey", [text(x) for x in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")])} AS message_prefix,
       'config/input_' || n_nationkey || '.json' AS target,
       'Restore input ' || n_nationkey || ' to its saved value.' AS proposed_action,
       'Input ' || n_nationkey || ' is missing a field.' AS incident_summary,
       'The failure matches the known signature.' AS reason, 'medium' AS risk_level,
       array('Confirm the saved value is in place.', 'A later approved run must succeed.') AS validation_steps,
       'A human can put the former value back.' AS rollback_plan,
       '{{{{"target": "config/input_' || n_nationkey || '.json", "before": {{{{"fail": true}}}}, "after": {{{{"fail": false}}}}}}}}' AS expected_change
FROM {{nation}}"""


# Incident records as JSON text: sound ones, every kind of broken one, and the
# optional sections. Template braces are written as @< and @>.
_INCIDENT = """
SELECT okey, '@<"incident_id":"in_' || okey || '","recorded_at":"2024-03-01T12:00:00' || (CASE okey % 37 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+00:00' END)
 || '","dag_id":"' || dag_id || '","dag_run_id":"' || dag_run_id || '","task_id":"' || task_id || '","historical_only":' || (CASE okey % 41 WHEN 0 THEN 'false' ELSE 'true' END)
 || ',"failure":@<"exception_type":"' || exception_type || '","exception_message":"' || exception_message || ' token=t' || okey
 || '","source_file":null,"source_line":' || (CASE okey % 43 WHEN 0 THEN '-1' WHEN 1 THEN '4.5' WHEN 2 THEN 'null' ELSE '' || (okey % 300) END) || ',"failed_function":"step"@>'
 || ',"rca":@<"summary":"' || (CASE okey % 47 WHEN 0 THEN ' ' ELSE 'Late input' END) || '","root_cause":"Upstream","confidence":' || (CASE okey % 53 WHEN 0 THEN 'true' WHEN 1 THEN '1.5' ELSE '0.5' END) || '@>'
 || ',"remediation":@<"action_type":"investigation","proposed_action":"Look at it","risk_level":"' || (CASE okey % 59 WHEN 0 THEN 'severe' ELSE 'low' END) || '"@>'
 || ',"policy":@<"decision":"' || (CASE okey % 61 WHEN 0 THEN 'block' ELSE 'require_approval' END) || '","calculated_risk":"low"@>'
 || ',"approval":@<"status":"' || approval || '","approved_by":' || (CASE WHEN approval = 'APPROVED' AND okey % 67 <> 0 THEN '"ann"' ELSE 'null' END)
 || ',"decision_timestamp":' || (CASE WHEN approval <> 'APPROVED' THEN 'null' WHEN okey % 71 = 0 THEN '"2024-03-01T13:00:00+00:00"' ELSE '"2024-03-01T11:00:00+00:00"' END) || '@>'
 || ',"execution":@<"operation":"' || operation || '","status":"' || execution || '","mutations_performed":' || (CASE okey % 73 WHEN 0 THEN 'true' ELSE 'false' END) || '@>'
 || ',"validation":@<"validation_status":"' || (CASE okey % 79 WHEN 0 THEN 'VERIFIED_HEALTHY' ELSE 'NOT_REPAIRED' END) || '","repair_verified":' || (CASE WHEN okey % 79 = 0 AND okey % 2 = 0 THEN 'true' ELSE 'false' END) || ',"reason":"None made."@>'
 || (CASE okey % 31 WHEN 0 THEN ',"note":"x"' ELSE '' END)
 || (CASE WHEN okey % 6 IN (1, 2) THEN ',"playbook_attempt":@<"playbook":"' || (CASE okey % 83 WHEN 0 THEN 'other' ELSE 'restore_input' END)
   || '","proposal":@<"incident_summary":"Input gone","proposed_action":"Restore the input.","action_type":"configuration_change","target":"config/input.json","reason":"Known","risk_level":"medium","confidence":1.0,"requires_human_approval":true,"validation_steps":["Check it."],"rollback_plan":"Put it back."@>'
   || ',"policy":@<"decision":"require_approval","calculated_risk":"medium","reasons":["known"],"allowed_actions":["restore_input"],"blocked_actions":[],"requires_human_approval":true@>'
   || ',"approval":@<"approval_id":"pa","status":"APPROVED","dag_id":"' || dag_id || '","dag_run_id":"' || (CASE okey % 17 WHEN 0 THEN 'run_other' ELSE dag_run_id END) || '","task_id":"' || task_id
   || '","action_type":"configuration_change","calculated_risk":"medium","proposed_action":"Restore the input.","policy_decision":"require_approval","approved_by":"ann","decision_timestamp":"2024-03-01T11:30:00+00:00"@>'
   || ',"execution":@<"playbook":"restore_input","status":"' || (CASE okey % 5 WHEN 0 THEN 'REFUSED' ELSE 'COMPLETED' END) || '","dag_id":"' || dag_id || '","task_id":"' || task_id
   || '","changes":[@<"target":"config/input.json","before":@<"fail":true@>,"after":@<"fail":' || (CASE okey % 19 WHEN 0 THEN 'true' ELSE 'false' END) || '@>@>],"message":"password=p' || okey || '"@>'
   || ',"final_state":"' || (CASE okey % 5 WHEN 0 THEN 'NOT_REPAIRED' ELSE 'REMEDIATION_APPLIED_PENDING_VALIDATION' END) || '","repair_verified":' || (CASE okey % 89 WHEN 0 THEN 'true' ELSE 'false' END) || ',"error":null@>' ELSE '' END)
 || (CASE WHEN okey % 6 = 2 THEN ',"verification":@<"original_dag_run_id":"' || dag_run_id || '","verification_dag_run_id":"' || (CASE okey % 13 WHEN 0 THEN dag_run_id ELSE 'new_' || okey END)
   || '","dag_id":"' || dag_id || '","trigger_status":"CREATED","dag_run_state":"success","task_states":@<"task_1":"success","task_2":"' || (CASE okey % 11 WHEN 0 THEN 'failed' ELSE 'success' END)
   || '"@>,"repair_verified":true,"verification_status":"VERIFIED_HEALTHY","reason":"all fine"@>,"final_outcome":@<"state":"' || (CASE okey % 23 WHEN 0 THEN 'TIMEOUT' ELSE 'VERIFIED_HEALTHY' END) || '","repair_verified":true@>' ELSE '' END)
 || (CASE okey % 97 WHEN 0 THEN '' ELSE '@>' END) AS line
FROM (SELECT o.o_orderkey AS okey, 'dag_' || (o.o_custkey % 20) AS dag_id, 'run_' || o.o_orderkey AS dag_run_id, 'task_' || (o.o_orderkey % 7) AS task_id,
  @types AS exception_type, c.c_mktsegment || ' ' || o.o_orderpriority || ' e' || (o.o_orderkey % 50) AS exception_message,
  (CASE o.o_orderkey % 4 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'PENDING_APPROVAL' ELSE 'APPROVED' END) AS approval,
  (CASE WHEN o.o_orderkey % 4 > 1 OR o.o_orderkey % 101 = 0 THEN 'COMPLETED' ELSE 'REFUSED' END) AS execution,
  (CASE o.o_orderkey % 3 WHEN 0 THEN 'other_operation' ELSE 'read_only_investigation' END) AS operation
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey) t"""
VIEWS["incident_json"] = (_INCIDENT.replace("@types", pick("o.o_orderkey", [text(x) for x in ("ValueError", "KeyError", "TimeoutError", "IOError")]))
                          .replace("@<", "{{").replace("@>", "}}"))
EXPECTED_CHANGE = '{"target": "config/input.json", "before": {"fail": true}, "after": {"fail": false}}'
INCIDENT_RULES = {"playbooks": ("restore_input",), "required": REQUIRED_TASKS}


# --- inputs of the incident workflow: one incident for each failed task attempt ---------

_FAILED_ITEM = "l.l_returnflag = 'A' AND l.l_linestatus = 'F' AND l.l_linenumber >= 2"
VIEWS["attempt_keys"] = f"""
SELECT DISTINCT l.l_orderkey AS okey, o.o_custkey % 20 AS dag_no, l.l_linenumber AS task_no, 'dag_' || (o.o_custkey % 20) AS dag_id,
       'run_' || l.l_orderkey AS dag_run_id, 'task_' || l.l_linenumber AS task_id,
       'dag_' || (o.o_custkey % 20) || '/run_' || l.l_orderkey || '/task_' || l.l_linenumber || '/1/-1' AS incident_id
FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey WHERE {_FAILED_ITEM}"""

# Three lines of each attempt: plain text with secrets, a library's warning or progress, then mostly the failure itself.
_TYPES = [text(x) for x in ("ValueError", "KeyError", "TimeoutError", "IOError")]
_LINES = ("'started token=' || okey || ' plum'",
          """CASE okey % 3 WHEN 0 THEN '{{"event":"progress"}}' ELSE '{{"timestamp":"t1","event":"warning","error_detail":[{{"exc_type":"LibError","exc_value":"early '
   || okey || '","frames":[{{"filename":"/usr/lib/site-packages/lib.py","lineno":7,"name":"call"}}]}}]}}' END""",
          """CASE okey % 11 WHEN 0 THEN 'gave up' ELSE '{{"timestamp":"t2","event":"Task failed with exception","error_detail":{{"exc_type":"Wrapper","exc_value":"outer","frames":[],"exceptions":[{{"exc_type":"'
   || """ + pick("okey", _TYPES) + """ || '","exc_value":"Input ' || (okey % 5) || ' lost password=p' || okey || '","frames":[{{"filename":"dags/flow.py","lineno":' || (okey % 90) || ',"name":"step"}}]}}]}}}}' END""")
VIEWS["attempt_lines"] = "\nUNION ALL ".join(
    f"SELECT dag_id, dag_run_id, task_id, 1 AS try_number, -1 AS map_index, CAST({n} AS BIGINT) AS seq, {line} AS line FROM {{attempt_keys}}"
    for n, line in enumerate(_LINES))

# What a playbook sets is a boolean, a number or a text.
_BEFORE, _AFTER = (pick("task_no", [text(x) for x in values]) for values in (
    ('{{"on": true}}', '{{"retries": 3}}', '{{"mode": "slow"}}'), ('{{"on": false}}', '{{"retries": 5}}', '{{"mode": "fast"}}')))
VIEWS["known_playbooks"] = f"""
SELECT DISTINCT 'set_' || dag_no || '_' || task_no || '_' || type_no AS playbook, 'dag_' || dag_no AS dag_id, 'task_' || task_no AS task_id,
       {pick("type_no", _TYPES)} AS exception_type, CASE WHEN dag_no % 2 = 0 THEN 'Input ' ELSE 'Input 0' END AS message_prefix,
       'config/' || dag_no || '_' || task_no || '.json' AS target, 'Set the input of ' || dag_no || '_' || task_no || '.' AS proposed_action,
       'Input of ' || dag_no || '_' || task_no || ' is lost.' AS incident_summary, 'The failure matches the known signature.' AS reason,
       'medium' AS risk_level, array('Confirm the saved value is in place.', 'A later approved run must succeed.') AS validation_steps,
       'A human can put the former value back.' AS rollback_plan,
       '{{{{"target": "config/' || dag_no || '_' || task_no || '.json", "before": ' || {_BEFORE} || ', "after": ' || {_AFTER} || '}}}}' AS expected_change
FROM (SELECT c_custkey % 20 AS dag_no, 1 + CAST(floor(c_custkey / 20) AS BIGINT) % 7 AS task_no, CAST(floor(c_custkey / 140) AS BIGINT) % 4 AS type_no FROM {{customer}}) c"""

# Six of ten runs are answered by a sound investigation, the others by the mixed proposals above.
VIEWS["answers"] = f"""
SELECT p.okey, '{{{{"choices":[{{{{"finish_reason":"' || (CASE p.okey % 31 WHEN 0 THEN 'length' ELSE 'stop' END)
       || '","message":{{{{"content":"{{{{\\"summary\\":\\"Late input\\",\\"root_cause\\":\\"Upstream\\",\\"evidence\\":[],\\"recommended_action\\":\\"Look\\",\\"risk_level\\":\\"low\\",\\"confidence\\":'
       || (CASE p.okey % 29 WHEN 0 THEN '2' ELSE '0.5' END) || ',\\"requires_human_approval\\":true}}}}"}}}}}}}}]}}}}' AS rca_response,
       CASE WHEN p.okey % 10 < 6 THEN '{{{{"incident_summary":"Run ' || p.okey || ' failed","proposed_action":"Look at the feed layout","action_type":"investigation","target":"feed","reason":"It is late",'
         || '"risk_level":"low","confidence":0.8,"requires_human_approval":true,"validation_steps":["Check that every column arrives."],"rollback_plan":"{NO_CHANGE}"}}}}'
       ELSE p.response END AS proposal_response
FROM {{proposal_json}} p"""

VIEWS["responses"] = """
SELECT k.incident_id, a.rca_response, a.proposal_response
FROM {attempt_keys} k JOIN {answers} a ON a.okey = k.okey WHERE k.okey % 101 <> 0"""

VIEWS["workflow_decisions"] = """
SELECT 'ap_' || k.incident_id AS approval_id, d.seq, d.command, d.reviewer, d.decided_at
FROM {decisions} d JOIN {attempt_keys} k ON d.approval_id = 'ap_' || k.okey
UNION ALL SELECT 'pb_' || incident_id AS approval_id, 1 AS seq, CASE okey % 7 WHEN 0 THEN 'reject' ELSE 'approve' END AS command, 'ann' AS reviewer,
  '2024-03-01T11:10:00+00:00' AS decided_at FROM {attempt_keys} WHERE okey % 11 <> 5"""

VIEWS["workflow_executions"] = """
SELECT incident_id, CASE okey % 47 WHEN 0 THEN ' ' ELSE 'ex_' || incident_id END AS execution_id,
       CASE okey % 37 WHEN 0 THEN 'rerun_task' ELSE 'read_only_investigation' END AS operation,
       CASE okey % 41 WHEN 0 THEN '2024-03-01T09:59:00+00:00' ELSE '2024-03-01T11:00:00+00:00' END AS started_at,
       '2024-03-01T11:00:05Z' AS completed_at
FROM {attempt_keys} WHERE okey % 13 <> 0"""

VIEWS["playbook_runs"] = f"""
SELECT incident_id, CASE CAST(floor(okey / 5) AS BIGINT) % 7 WHEN 0 THEN CAST('2024-03-01 11:40:00' AS TIMESTAMP) ELSE CAST('2024-03-01 11:20:00' AS TIMESTAMP) END AS run_at,
       CASE okey % 9 WHEN 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
       '[{{{{"after": ' || (CASE WHEN okey % 19 = 0 THEN '{{{{"on": 1}}}}' ELSE {_AFTER} END) || ', "before": ' || {_BEFORE} || ', "target": "config/' || dag_no || '_' || task_no || '.json"}}}}]' AS changes,
       'done with password=q' || okey AS message
FROM {{attempt_keys}} WHERE okey % 17 <> 0"""

VIEWS["reruns"] = """
SELECT incident_id, CASE okey % 6 WHEN 5 THEN dag_run_id ELSE 'manual__reliability_' || okey || '_' || task_no END AS verification_run_id,
       CAST('2024-03-01 11:22:00' AS TIMESTAMP) AS requested_at, CAST('2024-03-01 11:23:00' AS TIMESTAMP) AS trigger_started_at,
       okey % 8 <> 3 AS created, dag_id, okey
FROM {attempt_keys} WHERE okey % 4 <> 1"""

VIEWS["rerun_observations"] = """
SELECT dag_id, verification_run_id AS dag_run_id, CAST('2024-03-01 11:23:10' AS TIMESTAMP) AS observed_at, 'running' AS state FROM {reruns}
UNION ALL SELECT dag_id, verification_run_id AS dag_run_id,
  CASE okey % 12 WHEN 0 THEN CAST('2024-03-01 11:25:00' AS TIMESTAMP) ELSE CAST('2024-03-01 11:23:40' AS TIMESTAMP) END AS observed_at,
  CASE okey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'restarting' ELSE 'success' END AS state FROM {reruns}"""

VIEWS["rerun_tasks"] = """
SELECT dag_id, verification_run_id AS dag_run_id, 'task_1' AS task_id, 'success' AS state, 1 AS try_number, requested_at AS start_date,
       CAST(NULL AS TIMESTAMP) AS end_date, -1 AS map_index, CAST('2024-03-01 11:23:50' AS TIMESTAMP) AS read_at FROM {reruns}
UNION ALL SELECT dag_id, verification_run_id AS dag_run_id, 'task_2' AS task_id, CASE okey % 14 WHEN 0 THEN 'failed' ELSE 'success' END AS state, 1 AS try_number,
       requested_at AS start_date, CAST(NULL AS TIMESTAMP) AS end_date, CASE okey % 15 WHEN 0 THEN 2 ELSE -1 END AS map_index,
       CASE okey % 18 WHEN 0 THEN CAST('2024-03-01 11:25:10' AS TIMESTAMP) ELSE CAST('2024-03-01 11:24:00' AS TIMESTAMP) END AS read_at FROM {reruns}"""


def tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def needed(template: str) -> list[str]:
    """Tables and views that a view reads."""
    return sorted({n for n in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", template) if n in BASE_TABLES or n in VIEWS})


# Views whose rows cost much CPU downstream; a single small file would keep
# them in one task.
_HEAVY = ("proposal_json", "rca_json", "approval_json", "execution_json", "incident_json")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table as a DataFrame."""
    template = VIEWS[name]
    rendered = template.replace("\\", "\\\\")
    base = tables(spark, sf_dir, needed(template))
    if name in _HEAVY:
        base["orders"] = spread(base["orders"])
    return spark.sql(rendered, **base)


def cte(*names: str) -> str:
    """The derived tables, and those they read, as a ``WITH`` clause for the checking engine."""
    def rendered(name):
        return VIEWS[name].format(**{t: t for t in (*BASE_TABLES, *VIEWS)}).replace("array(", "list_value(")

    def with_inputs(name):
        return [x for n in needed(VIEWS[name]) if n in VIEWS for x in with_inputs(n)] + [name]

    parts = [f"{n} AS ({rendered(n)})" for n in dict.fromkeys(x for name in names for x in with_inputs(name))]
    return "WITH " + ",\n".join(parts)


def laid(df: DataFrame, path: str) -> str:
    """Write a derived table where the library's readers find it."""
    df.write.parquet(path)
    return path
