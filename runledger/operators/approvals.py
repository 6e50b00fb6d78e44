"""Approval records and the decisions applied to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.functions import checks as C
from runledger.functions.times import aware_timestamp, iso_utc, utc_timestamp
from runledger.operators.policy import evaluate_policy, same_policy
from runledger.sources import schemas as S

_REQUIRED_TEXT = ("approval_id", "status", "dag_id", "dag_run_id", "task_id", "action_type",
                  "calculated_risk", "proposed_action", "policy_decision")


def approval_defect(a: Column) -> Column:
    """First defect of a typed approval record, or null."""
    undecided = C.holds(a["status"].isin("PENDING_APPROVAL", "BLOCKED"))
    empty = a["approved_by"].isNull() & a["decision_timestamp"].isNull()
    return C.first_failure(
        (a.isNotNull(), "missing_record"),
        (C.all_hold(*[C.nonblank(a[f]) for f in _REQUIRED_TEXT]), "blank_text"),
        (a["policy_decision"].isin(*V.POLICY_DECISIONS) & a["calculated_risk"].isin(*V.LEVELS)
         & a["action_type"].isin(*V.ACTION_TYPES) & a["status"].isin(*V.APPROVAL_STATUSES), "bad_value"),
        ((a["policy_decision"] == "block") == (a["status"] == "BLOCKED"), "block_mismatch"),
        (~undecided | empty, "decision_on_undecided"),
        (undecided | C.nonblank(a["approved_by"]), "no_reviewer"),
        (undecided | utc_timestamp(a["decision_timestamp"]).isNotNull(), "bad_decision_time"))


def validate_approvals(rows: DataFrame, json_column: str) -> DataFrame:
    """Judge approval records given as JSON text: exact fields, then content."""
    names = [f.name for f in S.struct(S.APPROVAL_DDL).fields]
    staged = C.computed(rows, "_obj", C.fields(C.json_value(F.col(json_column))))
    o = F.col("_obj")
    # A value of another JSON type must not read as an allowed null.
    nullable_ok = C.all_hold(*[C.is_text(o[f]) | C.is_absent_or_null(o[f])
                               for f in ("approved_by", "decision_timestamp")])
    staged = C.computed(staged, "approval", F.struct(*[C.text_of(o[n]).alias(n) for n in names]))
    reason = (F.when(o.isNull(), "not_an_object").when(~C.has_exact_fields(o, names), "wrong_fields")
              .when(~nullable_ok, "bad_decision_fields").otherwise(approval_defect(F.col("approval"))))
    return (C.computed(staged, "reject_reason", reason)
            .withColumn("approval", F.when(F.col("reject_reason").isNull(), F.col("approval"))).drop("_obj"))


def create_approvals(rows: DataFrame, context: str = "context", proposal: str = "proposal",
                     policy: str = "policy", approval_id: str = "approval_id",
                     playbooks: DataFrame | None = None, evaluated: str | None = None) -> DataFrame:
    """Pending or blocked approval records.

    The supplied policy is not trusted: it is compared with an own evaluation,
    and a decision that differs creates no record. ``evaluated`` names a column
    this job already got from :func:`evaluate_policy`, to evaluate only once.
    """
    checked = (evaluate_policy(rows, proposal, "_own_policy", playbooks) if evaluated is None
               else rows.withColumn("_own_policy", F.col(evaluated)))
    ctx, p, own = F.col(context), F.col(proposal), F.col("_own_policy")
    record = F.struct(
        F.col(approval_id).alias("approval_id"),
        F.when(own["decision"] == "block", "BLOCKED").otherwise("PENDING_APPROVAL").alias("status"),
        ctx["dag_id"].alias("dag_id"), ctx["dag_run_id"].alias("dag_run_id"), ctx["task_id"].alias("task_id"),
        p["action_type"].alias("action_type"), own["calculated_risk"].alias("calculated_risk"),
        p["proposed_action"].alias("proposed_action"), own["decision"].alias("policy_decision"),
        F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("string").alias("decision_timestamp"))
    staged = C.computed(checked, "approval", record)
    reason = (F.when(own.isNull(), "invalid_proposal")
              .when(~same_policy(F.col(policy), own), "policy_mismatch")
              .otherwise(approval_defect(F.col("approval"))))
    return (C.computed(staged, "reject_reason", reason)
            .withColumn("approval", F.when(F.col("reject_reason").isNull(), F.col("approval")))
            .drop("_own_policy"))


def effective_decisions(decisions: DataFrame) -> DataFrame:
    """First decision per approval that counts, by arrival order.

    Commands must match exactly. A decision without a reviewer or without a
    zoned time is rejected and leaves the approval open for a later one.
    """
    decided = aware_timestamp(F.col("decided_at"))
    usable = decisions.where(F.col("command").isin("approve", "reject")
                             & C.nonblank(F.col("reviewer")) & decided.isNotNull())
    return (usable.select("approval_id", "seq", "command", "reviewer", iso_utc(decided).alias("decided_iso"))
            .groupBy("approval_id")
            .agg(F.min(F.struct("seq", "command", "reviewer", "decided_iso")).alias("first")))


def apply_decisions(approvals: DataFrame, decisions: DataFrame, approval: str = "approval") -> DataFrame:
    """Approval records after their first effective decision; only pending ones change."""
    a, first = F.col(approval), F.col("first")
    joined = approvals.join(effective_decisions(decisions).withColumnRenamed("approval_id", "_decided_id"),
                            a["approval_id"] == F.col("_decided_id"), "left")
    changes = C.holds(a["status"] == "PENDING_APPROVAL") & first.isNotNull() & approval_defect(a).isNull()
    decided = (a.withField("status", F.when(first["command"] == "approve", "APPROVED").otherwise("REJECTED"))
               .withField("approved_by", first["reviewer"])
               .withField("decision_timestamp", first["decided_iso"]))
    return C.computed(joined, "_after", F.when(changes, decided).otherwise(a)).select(
        *[F.col("_after").alias(c) if c == approval else c for c in approvals.columns])
