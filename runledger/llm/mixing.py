"""Operator 2, mixing sources to target weights by Pareto order sampling.

A source's target is its weight's part of ``share`` times all sizes, at most ``cap``
times the source's own size; what stands above a cap is shared again by weight until
no target is above. A source whose target is r times its size takes floor(r) whole
copies of every document and fills the rest, a fraction f of its size, by a sample
without replacement:

* inclusion probabilities follow size, p = min(1, c * size), with c solved so that
  the expected size is f times the source's. Documents with p = 1 are certain, which
  leaves small documents to decide the last words;
* Pareto order sampling ranks each other document by its random odds u / (1 - u) over
  its inclusion odds p / (1 - p), u being a hash of doc_id and the seed, and takes the
  lowest ranks. The size is fixed in words: a document is taken while the middle of
  its words lies within the words still wanted, so the mix misses a target by half of
  the document at the border at most.

A source may hold any part of the rows: its ranks are summed in ``BINS`` slices of
the rank scale first, and only the slice that holds the border is put in order.

Null texts have size 0. Documents of size 0 take nothing; they keep the whole copies of their
source (``copies``). A null source is a source of its own and the last. Repeated rows
are drawn as one: rows equal in doc_id and size rank alike and ties are cut by place,
so the result is the same as a set. Empty tables and tables without words give targets
of 0. Reruns agree, as nothing but doc_id, size, source and the seed decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import stored, word_count

BINS = 1 << 14
#: Weights of the sources by code point, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source in ``sizes`` (source, size).

    Sources in the order of their caps per weight: the level that fills the total
    caps a prefix of them. The windows run over one row for each source.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weighted = sums.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * F.lit(cap)
    order = every.orderBy(most / F.col("weight"), "place")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(share)
    leveled = weighted.withColumn("level", (total - F.coalesce(F.sum(most).over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # The first source that its level does not cap sets the level of all that follow.
    free = F.min(F.when(F.col("level") * F.col("weight") < most, F.struct("place_in_order", "level"))).over(every)
    ranked = leveled.withColumn("place_in_order", F.row_number().over(order)).withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("place_in_order") < F.col("free.place_in_order")), most).otherwise(
        F.col("free.level") * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def inclusion(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``copies``, ``wanted`` (words beyond the copies) and ``scale`` (c) of each source.

    Windows run over the different sizes of a source, which the longest text bounds.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = goals.withColumn("copies", F.floor(rate)).withColumn(
        "wanted", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    counted = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    steps = counted.join(plan, counted["source"].eqNullSafe(plan["source"])).select(
        counted["source"], "size", "n", "wanted")
    larger = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.currentRow, W.unboundedFollowing)
    words = F.col("size").cast("double") * F.col("n")
    scale = (F.col("wanted") - F.coalesce(F.sum(words).over(larger), F.lit(0.0))) / F.sum(words * F.col("size")).over(rest)
    # All larger sizes are certain and this one is not: the first such size has the scale.
    found = (steps.withColumn("scale", scale).where(F.col("scale") * F.col("size") < 1)
             .groupBy("source").agg(F.max_by("scale", "size").alias("scale")))
    return plan.alias("p").join(found.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")), "left").select(
        "p.source", "source_size", "target", "copies", "wanted", F.coalesce("scale", F.lit(1.0)).alias("scale"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 0,
        id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``copies`` (how often the mix has the document) and ``taken`` (its words)."""
    rows = stored(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    sizes = rows.select("source", "size")
    plan = stored(inclusion(sizes, targets(sizes, weights, share, cap)), "mix_plan")
    p = F.least(F.lit(1.0), F.col("scale") * F.col("size"))
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    odds = F.when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))
    # odds / (1 + odds) puts the ranks on a scale from 0 to 1.
    ranked = (rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
              .withColumn("rank", F.when((F.col("size") > 0) & (F.col("wanted") > 0), odds / (1 + odds)).otherwise(F.lit(1.0)))
              .withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS))))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    upto = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The border lies in the first slice that reaches the words wanted; certain documents (slice 0) may reach them too.
    border = (bins.withColumn("upto", upto).where((F.col("upto") < F.col("wanted")) & (F.col("upto") + F.col("words") >= F.col("wanted")))
              .select(F.col("source").alias("of"), F.col("bin").alias("border"), "upto"))
    placed = ranked.join(border, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    whole = F.coalesce(F.col("bin") < F.col("border"), (F.col("bin") < BINS) & (F.col("wanted") > 0))
    inner = placed.where("bin = border")
    running = W.partitionBy("source").orderBy("rank", F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    middle = F.col("upto") + F.sum("size").over(running.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") / 2
    extra = inner.withColumn("extra", (middle <= F.col("wanted")).cast("long")).unionByName(
        placed.where("border is null or bin <> border").withColumn("extra", whole.cast("long")))
    copies = F.col("copies") + F.col("extra")
    return extra.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
