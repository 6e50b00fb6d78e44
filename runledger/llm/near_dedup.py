"""Operator 4, MinHash near-dedup by a signature-coordinate inverted join.

Each text becomes its set of distinct word shingles (64-bit hashes) and each
different set one class, so that exact copies are one row from here on. A class has
a MinHash signature of ``SIZE`` coordinates and is posted under every
coordinate-value pair. Two classes are a candidate if at least ``MATCHES``
coordinates collide:

* prefix: postings are ordered by the length of their list, rare first. Classes
  with that many collisions share a posting among the first SIZE - MATCHES + 1 of
  each, so only these are joined; postings held by one class fill the prefix first
  and are never joined.
* skip: the long lists behind the prefix are not merged; the collisions of a pair
  are counted by comparing its two signatures.

Candidates are confirmed on the full sets. A link at the very threshold (0.8) is
missed with probability 2e-7, a closer pair less often.

Lists of many classes are not expanded into all pairs. In each of ``STARS`` rounds
every list compares its members with one hub, and confirmed links merge components;
then lists that still hold several components compare their members of different
components, all of them: short lists by rows, longer ones inside the list and without a row for each pair. Two members of one component need no comparison, so no
link between components is lost.

Texts without words and null texts have an empty set and are linked with nothing:
component_id is their own doc_id. Repeated rows give repeated results. A null
doc_id is never the least unless the whole component has none; ``kept`` compares
null-safely, so a row alone with a null id is kept. Empty tables give no rows, extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import chunks, drop_worker_caches, give_back, stored
from runledger.llm.components import components
from runledger.llm.shingles import minima, shingle_sets

#: Signature coordinates and the collisions asked of a candidate.
SIZE, MATCHES = 32, 13
#: Rounds in which a list is compared with one hub.
STARS = 2
#: Words of 64 bits in the filter of wanted ids, the only thing broadcast: 16 bytes each and some overhead of Spark.
FILTER = 1 << 20
#: Members up to which a list gives pairs as rows, at most 28; longer ones are compared inside their list.
SHORT_LIST = 8
#: Shingles of one part of a list.
PART = 1 << 19


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _class(shingles) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``cls`` (which set it is, null if empty), ``n`` (its size) and ``sig`` of each text."""
    def run(batches):
        drop_worker_caches()
        for batch in chunks(batches, "text"):
            sets = shingle_sets(_bytes(batch.column("text")), width)
            sig = iter(minima(sets, SIZE).view("int64").tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([_class(s) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64()),
                 pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["id", "cls", "n", "sig"])
        give_back()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, cls binary, n long, sig array<long>")


def full_sets(holders: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles`` of each text that has the set its row names (node, cls, text)."""
    def run(batches):
        for batch in chunks(batches, "text"):
            sets = shingle_sets(_bytes(batch.column("text")), width)
            same = [_class(s) == c for s, c in zip(sets, batch.column("cls").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").filter(pa.array(same, pa.bool_())),
                 pa.array([s.view("int64") for s, ok in zip(sets, same) if ok], pa.list_(pa.int64()))], ["node", "shingles"])
        give_back()

    return holders.select("node", "cls", "text").mapInArrow(run, "node long, shingles array<long>")


def prefix_postings(classes: DataFrame) -> DataFrame:
    """``key``, ``node`` and ``n``: the postings of each class's prefix that other classes hold as well."""
    posted = classes.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    shared = posted.join(lists, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("held", "key"))).alias("own"))
    # Postings that only this class holds come first in the order and use up the prefix.
    room = F.lit(SIZE - MATCHES + 1) - (F.lit(SIZE) - F.size("own"))
    prefix = shared.where(room > 0).select("node", F.explode(F.slice("own", F.lit(1), room)).alias("p"))
    return prefix.select(F.col("p.key").alias("key"), "node").join(classes.select("node", "n"), "node")


def _collisions(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def passing(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose id may be a ``least`` of ``wanted``: a bitmap of ``FILTER`` words over hashed ids.

    None that is wanted is lost. Others pass as often as bits are set: 3 % at two million wanted ids.
    """
    bit = lambda id: F.pmod(F.xxhash64(id), F.lit(64 * FILTER))
    place = (F.col("bit") % 64).cast("int")
    marks = wanted.select(bit("least").alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    marked = texts.select("id", "text", bit("id").alias("bit")).withColumn("word", F.floor(F.col("bit") / 64))
    return marked.join(F.broadcast(marks), "word").where(F.getbit("bits", place) == 1).select("id", "text")


def sets_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node`` and ``shingles`` of the classes in ``nodes``, from one text of each.

    The scan of the texts drops what is not wanted by a filter of hashed ids whose size is bounded;
    only texts that pass meet the list of wanted ones, by a join that Spark chooses.
    """
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", "cls", "least"), "wanted")
    return stored(full_sets(passing(texts, wanted).join(wanted, F.col("id").eqNullSafe(F.col("least"))), width).dropDuplicates(["node"]), "sets")


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose signatures collide often enough and whose full sets are near."""
    of = lambda t, x, value: t.select(F.col("node").alias(x), F.col(value).alias(f"{value}_{x}"))
    likely = stored(pairs.join(of(classes, "a", "sig"), "a").join(of(classes, "b", "sig"), "b")
                    .where(_collisions("sig_a", "sig_b") >= MATCHES).select("a", "b"), "likely")
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(ends, classes, texts, width)
    both = likely.join(of(sets, "b", "shingles"), "b").join(of(sets, "a", "shingles"), "a")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def near_in_list(key: int, items: pa.StructArray, percent: int, across: bool) -> list[tuple[int, int]]:
    """Pairs of nodes of different components in one list (or two parts of it) that are near by their short hashes.

    Members outside the largest component are counted against all others by way of the
    list's own inverted index. A pair is reported by its least common list only.
    """
    node, label, n, part = (np.asarray(items.field(x)) for x in ("node", "label", "n", "part"))
    own, short = items.field("own").to_pylist(), items.field("short")
    length = np.asarray(pc.list_value_length(short))
    flat = np.asarray(short.flatten())
    _, term = np.unique(flat, return_inverse=True)
    holder = np.repeat(np.arange(len(node)), length)[np.argsort(term, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(term)))
    begin = np.append(0, np.cumsum(length))
    names, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
    minor, out = inverse != count.argmax(), []
    for i in np.flatnonzero(minor).tolist():
        terms = term[begin[i]:begin[i + 1]]
        many = first[terms + 1] - first[terms]
        at = np.repeat(first[terms] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        common = np.bincount(holder[at], minlength=len(node))
        near = (common * 100 >= (n[i] + n - common) * percent) & (label != label[i])
        near &= (part != part[i]) == across
        near[:i] &= ~minor[:i]
        for j in np.flatnonzero(near).tolist():
            if min(set(own[i]) & set(own[j])) == key:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return out


def across_components(held: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Likely pairs (a, b) of different components among the members of each list in ``held`` (key, node, n, label).

    A list is handled in parts of about ``PART`` shingles, two parts at a time, so no task holds
    more than that, and only pairs that are near become rows.
    """
    nodes = stored(held.groupBy("node", "n", "label").agg(F.collect_list("key").alias("own")), "members")
    sets = sets_of(nodes.select("node"), classes, texts, width)
    short = F.transform("shingles", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    full = nodes.join(sets.select("node", short.alias("short")), "node")
    parts = held.groupBy("key").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    spread = (full.withColumn("key", F.explode("own")).join(parts, "key")
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    grouped = spread.groupBy("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high")).agg(
        F.collect_list(F.struct("node", "label", "n", "part", "own", "short")).alias("items"))

    def run(batches):
        for batch in batches:
            for i, (key, low, high) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("key", "low", "high")))):
                found = near_in_list(key, batch.column("items").slice(i, 1).flatten(), percent, low != high)
                columns = zip(*found) if found else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])
        give_back()

    return grouped.mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, width: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row, linked at ``percent`` of Jaccard similarity."""
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = stored(signatures(texts, width), "signatures")
    # A class is named by a number from here on; it is written with it and so keeps it.
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn(
        "node", F.monotonically_increasing_id()), "classes")
    posts = stored(prefix_postings(classes), "postings")
    labels = None
    rank = lambda turn: F.lit(0).cast("long") if turn == 0 else F.xxhash64("key", "node", F.lit(turn))
    for turn in range(STARS + 1):
        held = posts.withColumn("label", F.col("node")) if labels is None else posts.join(labels, "node", "left").withColumn(
            "label", F.coalesce("label", "node"))
        several = [F.min("label").alias("low"), F.max("label").alias("high")]
        if turn < STARS:
            lists = held.groupBy("key").agg(*several, F.min(F.struct(rank(turn), "node", "n", "label")).alias("hub")).where("low < high")
            pairs = held.join(lists, "key").where("label <> hub.label").where(_near_sizes("n", "hub.n", percent)).select(
                F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        else:
            # The hubs have met all members of their lists; what is left are pairs of others.
            hubs = posts.groupBy("key").agg(*(F.min(F.struct(rank(t).alias("rank"), "node")).alias(f"hub{t}") for t in range(STARS)))
            others = reduce(DataFrame.where, [F.col("node") != F.col(f"hub{t}.node") for t in range(STARS)], held.join(hubs, "key"))
            others = stored(others.select("key", "node", "n", "label"), "others")
            lists = others.groupBy("key").agg(*several, F.count("*").alias("held")).where("low < high")
            left = stored(others.join(lists.select("key", "held"), "key"), "left")
            short, long_ = left.where(F.col("held") <= SHORT_LIST).drop("held"), left.where(F.col("held") > SHORT_LIST).drop("held")
            met = short.join(short.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other")), "key")
            pairs = met.where("label <> other and node < b").where(_near_sizes("n", "m", percent)).select(F.col("node").alias("a"), "b").distinct()
            pairs = pairs.unionByName(across_components(long_, classes, texts, width, percent)).distinct()
        links = confirmed(pairs, classes, texts, width, percent)
        # The labels stand for all links found before: stars, which take fewer rounds to merge than the links again.
        labels = stored(components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")
    marked = classes.join(labels, "node", "left").select("cls", "least", F.coalesce("label", "node").alias("label"))
    smallest = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    place = marked.join(smallest, "label").select("cls", "component_id")
    out = rows.select("id", "cls", "n").join(place, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
