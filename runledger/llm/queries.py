"""The registered queries of this subpackage; each reads its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.llm import (
    bpe, chat, exact_topk, fill_middle, graph_search, importance, mixing, near_dedup, oracles, sharding, simhash, token_counts, toxicity, warc,
)
from runledger.llm.common import table

QUERIES = {}
ORACLES = {"op12_importance_resampling": oracles.IMPORTANCE, "op13_fill_middle": oracles.FILL_MIDDLE}


def vocabulary_path() -> str:
    """Where the vocabulary of the queries lies; imported here, as only they need that package."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = chat.END + chat.START + "assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.read_back(chat.render(chat.events_of(turns.unionByName(planted)))))


@query
def op2_mix_sources(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query
def op3_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_minhash_near_dedup(spark, sf):
    return near_dedup.link(table(spark, sf, "documents"), width=2, percent=80)


@query
def op5_graph_neighbours(spark, sf):
    return graph_search.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op6_minimax_shards(spark, sf):
    return sharding.shard(table(spark, sf, "documents"), 24)


@query
def op7_bpe_round_trip(spark, sf):
    path = vocabulary_path()
    both = bpe.decode_ids(bpe.encode(table(spark, sf, "documents"), path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_token_counts(spark, sf):
    counted = token_counts.count_tokens(table(spark, sf, "documents"), vocabulary_path())
    return counted.withColumn("over_limit", token_counts.over_limit(F.col("n_tokens"), 1024))


@query
def op9_warc_packages(spark, sf):
    packages = warc.write_packages(table(spark, sf, "pages"), warc.archive_folder(spark))
    return warc.read_packages(packages).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


@query
def op10_segment_topk(spark, sf):
    return exact_topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op11_simhash_near_dedup(spark, sf):
    return simhash.link(table(spark, sf, "documents"))


@query
def op12_importance_resampling(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op13_fill_middle(spark, sf):
    made = fill_middle.transform(table(spark, sf, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
