"""Queries over transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.operators import quality as Q
from runledger.operators import transactions as X
from runledger.plans.incremental_load import LoadPaths, create_pipeline, plan_load, run_load
from runledger.session import shared_dir
from runledger.sources.tables import read_transactions
from runledger.sources.tables import stored_watermark
from runledger.workload.adapters import MARK, PIPELINE, cte, laid, view
from runledger.workload.registry import query

_BASE = cte("raw_transactions", "watermarks")
_MARK = f"(SELECT last_processed_at FROM watermarks WHERE pipeline_name = '{PIPELINE}')"


def _cleaned(condition: str) -> str:
    return f"""SELECT transaction_id, customer_id, amount, status, transaction_date, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY updated_at DESC) AS rn FROM raw_transactions
  WHERE {condition} AND status = 'COMPLETED' AND amount IS NOT NULL AND customer_id NOT LIKE 'TEST%') WHERE rn = 1"""


_LOAD = f"""{_BASE},
staged AS ({_cleaned("updated_at > " + _MARK)}),
before_load AS ({_cleaned("updated_at <= " + _MARK)}),
loaded AS (SELECT * FROM before_load WHERE transaction_id NOT IN (SELECT transaction_id FROM staged)
           UNION ALL SELECT * FROM staged)"""


def _inputs(spark, sf):
    """Raw rows, the stored marks, and the target as an earlier load left it."""
    raw = view(spark, sf, "raw_transactions")
    marks = view(spark, sf, "watermarks")
    mark = F.lit(MARK).cast("timestamp")
    earlier = X.business_rules(raw.where(F.col("updated_at") <= mark)).select(*X.COLUMNS)
    before = X.latest_per_key(earlier, tie_break=("amount", "customer_id", "transaction_date"))
    return raw, marks, before


def _plan(spark, sf):
    raw, marks, before = _inputs(spark, sf)
    return plan_load(raw, before, marks, PIPELINE)


def _shown(df):
    return df.select("transaction_id", "customer_id", F.col("amount").cast("double").alias("amount"), "status",
                     F.col("transaction_date").cast("string").alias("transaction_date"),
                     F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


_SHOWN = """SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount, status,
  CAST(transaction_date AS VARCHAR) AS transaction_date, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at"""


@query("new_data_gate", f"""{_BASE} SELECT count(*) AS new_rows, count(*) > 0 AS has_new
FROM raw_transactions WHERE updated_at > {_MARK}""")
def new_data_gate(spark, sf):
    return _plan(spark, sf)["gate"]


@query("dedupe_latest", f"{_LOAD} {_SHOWN} FROM staged")
def dedupe_latest(spark, sf):
    return _shown(_plan(spark, sf)["staged"])


@query("expected_metrics", f"""{_LOAD} SELECT count(*) AS record_count,
CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total_amount FROM staged""")
def expected_metrics(spark, sf):
    return X.metrics(_plan(spark, sf)["staged"]).withColumn("total_amount", F.col("total_amount").cast("double"))


@query("upsert_result", f"{_LOAD} {_SHOWN} FROM loaded")
def upsert_result(spark, sf):
    return _shown(_plan(spark, sf)["target"])


@query("target_metrics", f"""{_LOAD} SELECT count(*) AS record_count,
CAST(coalesce(sum(l.amount), 0) AS DOUBLE) AS total_amount FROM loaded l JOIN staged s USING (transaction_id)""")
def target_metrics(spark, sf):
    plan = _plan(spark, sf)
    return X.target_metrics(plan["target"], plan["staged"]).withColumn(
        "total_amount", F.col("total_amount").cast("double"))


def _reconcile_sql(target: str) -> str:
    return f"""{_LOAD}, target AS ({target}),
e AS (SELECT count(*) AS n, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS a FROM staged),
t AS (SELECT count(*) AS n, CAST(coalesce(sum(target.amount), 0) AS DOUBLE) AS a
      FROM target JOIN staged USING (transaction_id))
SELECT e.n AS expected_count, t.n AS actual_count, e.a AS expected_amount, t.a AS actual_amount,
CASE WHEN e.n <> t.n THEN 'COUNT_MISMATCH' WHEN e.a <> t.a THEN 'AMOUNT_MISMATCH' ELSE 'PASSED' END AS status FROM e, t"""


@query("reconcile", _reconcile_sql("SELECT * FROM loaded"))
def reconcile(spark, sf):
    return _plan(spark, sf)["outcome"]


@query("reconcile_before_upsert", _reconcile_sql("SELECT * FROM before_load"))
def reconcile_before_upsert(spark, sf):
    """The stale target lacks the new keys: the counts differ."""
    raw, marks, before = _inputs(spark, sf)
    staged = X.clean(raw, stored_watermark(marks, PIPELINE))
    return X.reconcile(X.metrics(staged), X.target_metrics(before, staged))


@query("reconcile_insert_only", _reconcile_sql(
    "SELECT * FROM before_load UNION ALL SELECT * FROM staged WHERE transaction_id NOT IN "
    "(SELECT transaction_id FROM before_load)"))
def reconcile_insert_only(spark, sf):
    """A load that inserts but never updates: counts agree, amounts do not."""
    raw, marks, before = _inputs(spark, sf)
    staged = X.clean(raw, stored_watermark(marks, PIPELINE))
    target = before.unionByName(staged.join(before.select(X.KEY), X.KEY, "left_anti"))
    return X.reconcile(X.metrics(staged), X.target_metrics(target, staged))


@query("next_watermark", f"""{_LOAD} SELECT pipeline_name, strftime(CASE WHEN pipeline_name = '{PIPELINE}'
THEN coalesce((SELECT max(updated_at) FROM staged), last_processed_at) ELSE last_processed_at END,
'%Y-%m-%d %H:%M:%S.%f') AS last_processed_at FROM watermarks""")
def next_watermark(spark, sf):
    return _plan(spark, sf)["watermarks"].select(
        "pipeline_name", F.date_format("last_processed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_processed_at"))


@query("incremental_load", f"{_LOAD} {_SHOWN} FROM loaded")
def incremental_load(spark, sf):
    """The whole load with its tables written: staging, bucketed target, mark."""
    raw, _, before = _inputs(spark, sf)
    paths = LoadPaths(shared_dir(spark, "load"), buckets=16)
    raw = read_transactions(spark, laid(raw.select(*X.COLUMNS), f"{paths.root}/raw"))
    mark = create_pipeline(spark, paths, PIPELINE, MARK, initial=before)
    outcome = run_load(spark, raw, paths, mark, "first", PIPELINE)
    if outcome["status"] != "PASSED":
        raise RuntimeError(f"reconciliation: {outcome['status']}")
    from runledger.sources.schemas import TRANSACTIONS_DDL
    from runledger.sources.targets import read_target
    return _shown(read_target(spark, paths.target, TRANSACTIONS_DDL))


# --- produced values ---------------------------------------------------------------

@query("double_values", """SELECT l_orderkey, l_linenumber,
list_transform([l_linenumber, l_linenumber + 1, CAST(l_quantity AS INTEGER)], lambda x: x * 2)[1] AS first_value,
list_transform([l_linenumber, l_linenumber + 1, CAST(l_quantity AS INTEGER)], lambda x: x * 2)[3] AS last_value
FROM lineitem""")
def double_values(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber",
        Q.doubled(F.array("l_linenumber", F.col("l_linenumber") + 1, F.col("l_quantity").cast("int"))).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", F.get("v", F.lit(0)).alias("first_value"),
                       F.get("v", F.lit(2)).alias("last_value"))


_PRODUCED = "[2 * (l_linenumber % 3), 4, 6]"


@query("dq_expectations", f"""WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber,
CASE WHEN l_returnflag = 'N' THEN [2, 4] ELSE {_PRODUCED} END AS v FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber,
CASE WHEN len(v) <> 3 THEN 'wrong_count' WHEN len(list_filter(v, lambda x: x <= 0)) > 0 THEN 'not_positive'
WHEN v <> [2, 4, 6] THEN 'unexpected_values' END AS failed_expectation FROM p""")
def dq_expectations(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "N", F.array(F.lit(2), F.lit(4)))
         .otherwise(F.array(2 * (F.col("l_linenumber") % 3), F.lit(4), F.lit(6))).alias("v"))
    return Q.value_expectations(rows, "v", (2, 4, 6)).select(
        "l_orderkey", "l_partkey", "l_linenumber", "failed_expectation")


@query("table_expectations", """SELECT l_orderkey, count(*) = 3 AS count_ok,
bool_and(l_linenumber * 2 - 2 > 0) AS all_positive FROM lineitem GROUP BY l_orderkey""")
def table_expectations(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", (F.col("l_linenumber") * 2 - 2).alias("v"))
    return Q.table_expectations(rows, ["l_orderkey"], "v", 3)
