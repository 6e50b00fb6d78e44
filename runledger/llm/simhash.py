"""Operator 11, SimHash near-dedup by pivot distance tables.

A text's fingerprint has 64 bits: A-Z lower-cased, words split at ASCII white space,
every run of three words hashed by XXH64, and a bit is set if it is set in over half
the hashes. Equal fingerprints are one class from here on. Two classes are linked if at
most ``RADIUS`` = 2 bits differ.

* References: ``REFERENCES``, 65 fixed fingerprints, the first j bits set for j = 0 to
  64. The pivot table holds each class's Hamming distances to all of them.
* Candidates: a bit in which two classes differ changes how their distances step from one
  reference to the next, there only. So of the three ``FAMILIES`` of successive
  references at least one shows two linked classes the very same steps. Classes are
  posted under the steps of each family and meet in these lists.
* Discard: by the triangle inequality linked classes differ by at most 2 in every
  coordinate of the table; a pair with a larger difference anywhere is dropped (the
  first such coordinate ends the test). Of unrelated pairs in a list less than one in a
  thousand is left.
* Verify: survivors are compared bit by bit.

A list of more than ``LIST`` classes (many near copies, or very many classes) is not
paired. Its members take further references: every fingerprint at most one bit away from a
member, with the distances 0 and 1. Two classes at most 2 bits apart have such a reference
between them, and whoever shares one is linked by the triangle inequality, so nothing is
lost; a reference has at most 65 classes around it, whatever the data, and hands all of them
to the least. The work is bounded by ``3 * LIST / 2`` pairs or 65 postings for each class.

Null texts count as empty; texts without words have fingerprint zero, which is linked like
any other. Repeated rows give repeated results. A null doc_id is never the least unless
the whole component has none. Empty tables give no rows, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import chunks, drop_worker_caches, give_back, stored
from runledger.llm.components import components

RADIUS, WIDTH, SEED = 2, 3, 42
#: Members up to which a list is paired.
LIST = 32
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


REFERENCES = [_signed((1 << j) - 1) for j in range(65)]
FAMILIES = [(0, 22), (22, 43), (43, 64)]

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: bytes, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """The hash of each run of ``width`` words; of the whole sequence if there are fewer."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, seed)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip((ends - lengths).tolist(), ends[width - 1:].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """The bits set in over half the hashes; zero without any."""
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), BLOCK):
        lanes = np.array(hashes[at:at + BLOCK], "<u8").view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fp`` (64 bits as a long) of each row."""
    def run(batches):
        drop_worker_caches()
        for batch in chunks(batches, "text", 1 << 20):
            found = [fingerprint(shingle_hashes(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], ["id", "fp"])
        give_back()

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def distances(fp: Column) -> Column:
    """A row of the pivot table: the Hamming distance to each reference."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("tinyint") for r in REFERENCES))


def steps(table: Column, family: tuple[int, int]) -> Column:
    """How the distances move along the references of a family, seen from its first."""
    first, last = family
    return F.transform(F.slice(table, first + 2, last - first), lambda d: d - F.get(table, F.lit(first)))


def discarded(a: Column, b: Column, radius: int = RADIUS) -> Column:
    """Whether two rows of the pivot table differ too much in some coordinate."""
    return F.exists(F.lit(list(range(len(REFERENCES)))), lambda j: F.abs(F.get(a, j) - F.get(b, j)) > radius)


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def listed(classes: DataFrame) -> DataFrame:
    """``key``, ``held``, ``fp`` and ``table``: the postings of each class in lists that hold others as well."""
    keys = F.array(*(F.xxhash64(F.lit(g), steps(F.col("table"), family)) for g, family in enumerate(FAMILIES)))
    posted = stored(classes.select("fp", "table", F.explode(keys).alias("key")), "pivot_postings")
    held = posted.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    return stored(posted.join(held, "key"), "pivot_lists")


def links_in_lists(lists: DataFrame) -> DataFrame:
    """Links (a, b) inside short lists: pairs whose tables agree within the radius, verified."""
    members = lists.groupBy("key").agg(F.collect_list(F.struct("fp", "table")).alias("m"))
    near = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (x["fp"] < y["fp"]) & ~discarded(x["table"], y["table"]) & (apart(x["fp"], y["fp"]) <= RADIUS)),
        lambda y: F.struct(x["fp"].alias("a"), y["fp"].alias("b")))))
    return members.select(F.explode(near).alias("p")).select("p.a", "p.b")


def links_around(crowd: DataFrame) -> DataFrame:
    """Links (a, b) of classes in long lists, by the references at most one bit away from each."""
    spots = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)))
    around = crowd.select("fp", F.explode(spots).alias("spot")).groupBy("spot").agg(F.collect_list("fp").alias("m"))
    stars = around.where(F.size("m") > 1).select(F.explode("m").alias("a"), F.array_min("m").alias("b"))
    return stars.where((F.col("a") != F.col("b")) & (apart(F.col("a"), F.col("b")) <= RADIUS))


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """Distinct links (a, b) between the fingerprints ``fp`` of ``classes``; enough of them to give every component."""
    lists = listed(classes.select("fp", distances(F.col("fp")).alias("table")))
    crowd = lists.where(F.col("held") > LIST).select("fp").distinct()
    return links_in_lists(lists.where(F.col("held") <= LIST)).unionByName(links_around(crowd)).distinct()


def link(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the least doc_id reachable) of each row."""
    rows = stored(fingerprints(docs, id, text), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint_classes")
    labels = components(link_fingerprints(classes))
    marked = stored(classes.join(labels, classes.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    smallest = marked.groupBy("label").agg(F.min("least").alias("component_id"))
    place = marked.join(smallest, "label").select("fp", "component_id")
    return rows.join(place, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
