"""From raw documents to token ids: four stages, each of one operator of ``runledger.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All but the last return the columns of ``documents``. Documents are told apart by
doc_id; null ids match null ids. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import bpe, mixing, near_dedup, toxicity
from runledger.llm.common import stored, table, tuned
from runledger.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Pre-tokens a worker remembers while encoding; its executor has held the shuffles of the stages before.
KEPT_WORDS = 300_000
#: Scores from here on reject a document.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the network on the labelled documents and drop what it rejects; a score below ``TOXIC`` stays."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=COLUMNS, name="toxicity_score")
    return scored.where(F.col("toxicity_score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at 0.8 or more the smallest doc_id stays; equal rows stay once.

    Documents without words are linked with nothing and stay.
    """
    docs = tuned(spark) and docs.select(*COLUMNS)
    kept = near_dedup.link(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    docs = docs.select(*COLUMNS)
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")).where("copies > 0").withColumnRenamed("doc_id", "mixed_id")
    rows = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("mixed_id")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of each document of the mix."""
    tuned(spark)
    return bpe.encode(docs, vocabulary_path(), kept=KEPT_WORDS).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("encode", encode)]

#: Neither a network nor byte pairs can be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
