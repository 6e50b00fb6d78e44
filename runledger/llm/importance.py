"""Operator 12, importance resampling towards a target distribution by bit-sliced aggregation.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; features are
all single words and pairs of neighbours, dealt into ``BUCKETS`` by crc32. A bucket's gain
compares its share of the target's features with its share of all documents' features, in
thousandths of a natural logarithm, rounded down. A document's weight is the mean gain of
its features, rounded down.

* Bucket counts: each task sums its texts and sends one row a bucket, so the shuffle has
  at most ``BUCKETS`` rows for each task, and the gains are a list of that length.
* Weights: the counts of a document are sliced into planes of ``BUCKETS`` bits, plane i
  holding bit i of every count. The gains are sliced likewise, in two's complement, the
  top plane weighing negatively. AND of two planes and popcount say how many buckets have both
  bits; these numbers times powers of two add up to the exact sum of gains.
* Sampling: Gumbel noise from a hash of doc_id turns weights into keys whose largest are a
  sample without replacement. Scores are counted by value first, in two steps, so that
  only documents above the border are put in order, one value of the score at a time.

Null texts have no words: no features, weight 0. A null doc_id hashes as the empty text and
comes before others among equal scores. Repeated rows are documents of their own, with
neighbouring ranks. Without documents of ``LEAST_WORDS`` words none is drawn; empty tables
give no rows, and an empty target leaves only the smoothing. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import chunks, drop_worker_caches, give_back, stored

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Documents whose counts are sliced at once.
BLOCK = 64
#: Scores that share a coarse step of the ranking.
COARSE = 256

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets_of(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a text, and the bucket of each feature."""
    words = text.translate(_LETTERS).split()
    crc = zlib.crc32
    alone = [crc(w) for w in words]
    # The checksum goes on from that of the first word.
    pairs = [crc(b" " + w, c) for w, c in zip(words[1:], alone)]
    return len(words), np.array(alone + pairs, np.int64) % buckets


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: features of all texts in each bucket that has any."""
    def run(batches):
        drop_worker_caches()
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text", 1 << 20):
            for t in _texts(batch):
                total += np.bincount(buckets_of(t, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
        give_back()

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket; collects one number a bucket from either side."""
    both = (raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full")
            .select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    s, t = [0] * buckets, [0] * buckets
    for row in both.collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log(((y + 1) * all_s) / ((x + 1) * all_t))) for x, y in zip(s, t)]


def planes(values: np.ndarray, n: int) -> np.ndarray:
    """Bit planes of rows of non-negative integers: (rows, n planes, 64-bit words)."""
    bits = (values[:, None, :] >> np.arange(n)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little")
    return np.pad(packed, [(0, 0), (0, 0), (0, -packed.shape[-1] % 8)]).view(np.uint64)


def sliced_gains(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The planes of the gains in two's complement, and what a bit of each weighs."""
    width = max(v.bit_length() for v in values) + 1
    weighs = [1 << j for j in range(width - 1)] + [-(1 << (width - 1))]
    return planes(np.array([[v % (1 << width) for v in values]]), width)[0], np.array(weighs, np.int64)


def sums(counts: np.ndarray, gain_planes: np.ndarray, weighs: np.ndarray) -> np.ndarray:
    """The sum of count times gain over the buckets, for each row of ``counts``."""
    depth = int(counts.max(initial=0)).bit_length()
    sliced, total = planes(counts, depth), np.zeros(len(counts), np.int64)
    for i in range(depth):
        both = np.bitwise_count(sliced[:, i, None, :] & gain_planes[None]).sum(axis=-1, dtype=np.int64)
        total += (both @ weighs) << i
    return total


def weigh(docs: DataFrame, gain: list[int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of each row."""
    gain_planes, weighs = sliced_gains(gain)
    buckets = len(gain)

    def run(batches):
        drop_worker_caches()
        for batch in chunks(batches, "text", 1 << 20):
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = [buckets_of(t, buckets) for t in _texts(part)]
                n = np.array([len(b) for _, b in found], np.int64)
                place = np.concatenate([b + i * buckets for i, (_, b) in enumerate(found)])
                counts = np.bincount(place, minlength=len(found) * buckets).reshape(-1, buckets)
                weight = sums(counts, gain_planes, weighs) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([w for w, _ in found], pa.int64()), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])
        give_back()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the hash of an id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... by falling score for the drawn rows, else null.

    ``ahead`` is the number of rows with a higher score: summed over coarse steps of ``COARSE``
    values first, then inside a step. Both are small, as scores are thousandths of logarithms.
    """
    may = F.col("n_words") >= least_words
    values = stored(scored.where(may).groupBy("score").agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("score") / COARSE)), "score_values")
    above = lambda w: F.coalesce(F.sum("n").over(w.orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = values.groupBy(F.col("step").alias("at")).agg(F.sum("n").alias("n")).select(F.col("at").alias("step"), above(W.partitionBy(F.lit(0))).alias("over"))
    room = values.agg(F.floor(F.sum("n") * percent / 100).alias("room"))
    fine = values.withColumn("at", F.col("score")).withColumn("inside", above(W.partitionBy("step")))
    border = fine.join(coarse, "step").join(F.broadcast(room)).select("score", (F.col("inside") + F.col("over")).alias("ahead"), "room").where("ahead < room")
    # One row for each value of the score above the border: bounded by the range of logarithms, not by the rows.
    marked = stored(scored.join(F.broadcast(stored(border, "score_border")), "score", "left").withColumn("in", may & F.col("ahead").isNotNull()), "scored_rows")
    nth = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "n_features", "n_words"))
    rank = F.col("ahead") + nth
    top = marked.where("in").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("room"), F.col("rank")))
    return top.unionByName(marked.where("not in").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of each row of ``docs``."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    scored = stored(weigh(docs, gain, id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "weights")
    return drawn(scored).select("doc_id", "n_features", "weight", "score", "rank")
