"""Judging model responses: root-cause records, proposals and raw contexts.

Input is a table with the response as JSON text. Each job adds the typed record
and a reason code; :func:`runledger.functions.checks.split_valid` then yields
the valid rows and a quarantine that never carries rejected text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.functions import checks as C
from runledger.functions.redaction import safe_record, safe_text
from runledger.sources import schemas as S

_RCA_FIELDS = V.RCA_TEXT_FIELDS + ("evidence", "risk_level", "confidence", "requires_human_approval")
_PROPOSAL_FIELDS = V.PROPOSAL_TEXT_FIELDS + ("confidence", "requires_human_approval", "validation_steps")


def response_content(text: Column) -> Column:
    """JSON text inside a completed response envelope; null if it did not finish."""
    body = C.json_value(text)
    choice = F.try_variant_get(body, "$.choices[0]", "map<string,variant>")
    message = C.fields(choice["message"])
    done = C.text_of(choice["finish_reason"]) == "stop"
    return F.when(C.holds(done), C.text_of(message["content"]))


def _typed(obj: Column, ddl: str) -> Column:
    """Build a struct of the schema from strictly typed JSON fields."""
    cast = {"string": C.text_of, "bigint": C.int_of, "boolean": C.bool_of, "double": C.number_of,
            "array<string>": lambda v: F.when(C.is_text_list(v), C.as_type(v, "array<string>"))}
    return F.struct(*[cast[f.dataType.simpleString()](obj[f.name]).alias(f.name) for f in S.struct(ddl).fields])


def rca_defect(r: Column) -> Column:
    """First defect of a typed root-cause record, or null."""
    return C.first_failure(
        (C.all_hold(*[C.nonblank(r[f]) for f in V.RCA_TEXT_FIELDS]), "blank_text"),
        (C.nonblank_all(r["evidence"]), "bad_evidence"),
        (r["risk_level"].isin(*V.LEVELS), "bad_risk_level"),
        (C.between_0_and_1(r["confidence"]), "bad_confidence"),
        (r["requires_human_approval"], "approval_not_required"))


def proposal_defect(p: Column) -> Column:
    """First defect of a typed proposal, or null."""
    read_only = p["action_type"].isin(*V.READ_ONLY_ACTION_TYPES)
    return C.first_failure(
        (C.all_hold(*[C.nonblank(p[f]) for f in V.PROPOSAL_TEXT_FIELDS]), "blank_text"),
        (p["action_type"].isin(*V.ACTION_TYPES), "bad_action_type"),
        (p["risk_level"].isin(*V.LEVELS), "bad_risk_level"),
        (C.between_0_and_1(p["confidence"]), "bad_confidence"),
        (p["requires_human_approval"], "approval_not_required"),
        ((F.size(p["validation_steps"]) > 0) & C.nonblank_all(p["validation_steps"]), "bad_steps"),
        (~C.holds(read_only) | (p["rollback_plan"] == V.NO_CHANGE_ROLLBACK), "bad_rollback"))


def _judge(rows: DataFrame, content: Column, out: str, ddl: str, names, defect, secrets) -> DataFrame:
    dtype = S.struct(ddl)
    staged = C.computed(rows, "_obj", C.fields(C.json_value(content)))
    staged = C.computed(staged, "_raw", _typed(F.col("_obj"), ddl))
    staged = C.computed(staged, "_defect", F.when(F.col("_obj").isNull(), "not_an_object")
                        .when(~C.has_exact_fields(F.col("_obj"), names), "wrong_fields")
                        .otherwise(defect(F.col("_raw"))))
    # Only what will be shown counts, so the redacted record is judged again.
    staged = C.computed(staged, out, F.when(F.col("_defect").isNull(), safe_record(F.col("_raw"), dtype, secrets)))
    again = F.when(F.col("_defect").isNull() & defect(F.col(out)).isNotNull(), "invalid_after_redaction")
    reason = F.coalesce(F.col("_defect"), again)
    return (C.computed(staged, "reject_reason", reason)
            .withColumn(out, F.when(F.col("reject_reason").isNull(), F.col(out)))
            .drop("_obj", "_raw", "_defect"))


def validate_rca(rows: DataFrame, json_column: str, secrets: Iterable[str] = (), enveloped: bool = False) -> DataFrame:
    content = response_content(F.col(json_column)) if enveloped else F.col(json_column)
    return _judge(rows, content, "rca", S.RCA_DDL, _RCA_FIELDS, rca_defect, tuple(secrets))


def validate_proposals(rows: DataFrame, json_column: str, secrets: Iterable[str] = (),
                       enveloped: bool = False) -> DataFrame:
    content = response_content(F.col(json_column)) if enveloped else F.col(json_column)
    return _judge(rows, content, "proposal", S.PROPOSAL_DDL, _PROPOSAL_FIELDS, proposal_defect, tuple(secrets))


def compact_contexts(rows: DataFrame, json_column: str, secrets: Iterable[str] = ()) -> DataFrame:
    """Keep only the known context fields, each of its proper JSON type, redacted."""
    secrets = tuple(secrets)
    obj = C.fields(C.json_value(F.col(json_column)))
    staged = C.computed(rows, "_obj", obj)
    o = F.col("_obj")
    context = F.struct(*[
        (C.int_of(o[f.name]) if f.name in V.CONTEXT_INT_FIELDS else safe_text(C.text_of(o[f.name]), secrets))
        .alias(f.name) for f in S.struct(S.CONTEXT_DDL).fields])
    return (staged.withColumn("context", F.when(o.isNotNull(), context))
            .withColumn("reject_reason", F.when(o.isNull(), "not_an_object")).drop("_obj"))
