"""Queries over free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.functions.redaction import redact, safe_text, shape
from runledger.functions.text import normalize_texts, word_tokens
from runledger.workload.adapters import SECRETS
from runledger.workload.registry import query

_SECRETS = sorted(SECRETS, key=len, reverse=True)
_KNOWN = "text"
for _s in _SECRETS:
    _KNOWN = f"replace({_KNOWN}, '{_s}', '[REDACTED]')"


def _sub(expr: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"


def _shape(name: str) -> str:
    return shape(name, r"\b", r"\b", r"\s", r"\w").replace("'", "''")


_VENDOR = _sub(_KNOWN, _shape("vendor key"), V.MASK)


def _common(expr: str) -> str:
    expr = _sub(expr, _shape("signed token"), V.MASK)
    expr = _sub(expr, "(?i)" + _shape("bearer"), f"Bearer {V.MASK}")
    return _sub(expr, _shape("login in a URL"), rf"\1{V.MASK}@")


_STORED = _sub(_common(_VENDOR), "(?i)" + _shape("stored label") + _shape("value"), rf"\1{V.MASK}")
_STORED = _sub(_STORED, "(?s)" + _shape("private key"), V.MASK)
_EVIDENCE = _sub(_common(_KNOWN), "(?i)" + _shape("evidence label") + _shape("value"), rf"\1{V.MASK}")


@query("redact_documents", f"""SELECT doc_id, md5(r) AS redacted,
CAST((length(r) - length(replace(r, '[REDACTED]', ''))) / 10 AS BIGINT) AS masks
FROM (SELECT doc_id, {_STORED} AS r FROM documents)""")
def redact_documents(spark, sf):
    """Whole texts, without the limit of the record store."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", redact(F.col("text"), SECRETS, limit=None).alias("r"))
    return docs.select("doc_id", F.md5("r").alias("redacted"),
                       F.regexp_count("r", F.lit(r"\[REDACTED\]")).cast("bigint").alias("masks"))


@query("safe_text_documents", f"""SELECT doc_id, substring(split_part(r, chr(10), 1), 1, 1000) AS evidence, md5(r) AS whole
FROM (SELECT doc_id, {_EVIDENCE} AS r FROM documents)""")
def safe_text_documents(spark, sf):
    """The short evidence, and a digest of the whole text under the same rules."""
    text = F.col("text")
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", safe_text(text, SECRETS).alias("evidence"), F.md5(safe_text(text, SECRETS, limit=None, all_lines=True)).alias("whole"))


@query("word_tokens", """SELECT doc_id, len(w) AS words, md5(array_to_string(list_sort(w), ' ')) AS digest FROM (
SELECT doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS w FROM documents)""")
def tokens(spark, sf):
    words = word_tokens(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query("normalize_conversations", """SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(
replace(lower(text), 'ß', 'ss'), '(?s)/\\*.*?\\*/', ' ', 'g'), '\\s+', ' ', 'g'))) AS normalized FROM conversations""")
def normalize_conversations(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", F.md5(F.get(normalize_texts(F.array("text")), F.lit(0))).alias("normalized"))
