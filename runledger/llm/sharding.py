"""Operator 6, sharding by a minimax contiguous partition; DataFrame functions only.

Equal texts are a group and stay together. Groups stand in the order of their digest
and fall into ``UNITS`` units by its leading bits: the units are the ordered atomic
sizes, and as a unit follows from the text alone no group is cut. Over the unit sizes
the least capacity is found by binary search, each capacity checked by filling shards
greedily; the cuts are then made with that capacity, each as near to an even part of
what is left as the later shards allow. The array of unit sizes is one row of at most
``UNITS`` numbers, whatever the input.

The law is ``bytes``: the largest shard is as small as any such cut allows. Sizes
differ by a unit (1 / UNITS of the bytes on average) unless one group alone is larger
than an even part.

Rows are numbered in each shard in two steps, counts of (unit, lane) cells first and
places within a cell then, where the lane is a hash of doc_id: a group that holds a
third of all rows is spread over ``LANES`` tasks.

Null texts count as empty ones (8 bytes, checksum 0) and are one group with them.
Repeated rows take slots next to each other; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import stored

UNITS, LANES, OVERHEAD = 1 << 14, 256, 8


def unit_of(text: Column, units: int = UNITS) -> Column:
    """The unit of a text: the leading bits of its digest."""
    return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 32 - (units.bit_length() - 1)).cast("int")


def _state(**fields: Column) -> Column:
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def _filled(sizes: Column, capacity: Column) -> Column:
    """Shards that greedy filling needs at this capacity."""
    return F.aggregate(sizes, _state(n=F.lit(1), fill=F.lit(0).cast("long")), lambda s, x: F.when(
        s["fill"] + x["size"] <= capacity, _state(n=s["n"], fill=s["fill"] + x["size"]),
    ).otherwise(_state(n=s["n"] + 1, fill=x["size"])), lambda s: s["n"])


def least_capacity(sizes: DataFrame, shards: int) -> DataFrame:
    """One row: ``sizes`` as an ordered array ``units``, their ``total`` and the least feasible ``capacity``."""
    row = sizes.agg(F.array_sort(F.collect_list(F.struct("unit", "size"))).alias("units"), F.sum("size").alias("total"), F.max("size").alias("largest"))
    low = F.greatest(F.col("largest"), F.ceil(F.col("total") / shards).cast("long"))

    def halve(s, _):
        middle = F.floor((s["low"] + s["high"]) / 2).cast("long")
        return F.when(s["low"] >= s["high"], s).when(
            _filled(F.col("units"), middle) <= shards, _state(low=s["low"], high=middle),
        ).otherwise(_state(low=middle + 1, high=s["high"]))

    bounds = _state(low=low, high=low + F.col("largest"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("largest") + 1)).cast("int"))
    return row.where("largest is not null").withColumn("capacity", F.aggregate(steps, bounds, halve, lambda s: s["high"]))


def cuts(capacity: DataFrame, shards: int) -> DataFrame:
    """``unit`` and ``shard``: contiguous shards within the capacity, near to even parts of what is left.

    A shard closes before a unit that would overfill it, or where it stands at least
    as near to an even part without the unit as with it. It does not close early if
    the units still to come would not fit into the shards left.
    """
    none = F.lit([]).cast("array<int>")

    def back(s, x):
        return F.when(s["fill"] + x["size"] <= F.col("capacity"), _state(fill=s["fill"] + x["size"], lasts=s["lasts"])).otherwise(
            _state(fill=x["size"], lasts=F.concat(s["lasts"], F.array(x["unit"]))))

    # The last unit of each shard but the last when filling from the far end: the first shards must reach so far.
    reach = F.aggregate(F.reverse("units"), _state(fill=F.lit(0).cast("long"), lasts=none), back, lambda s: F.reverse(s["lasts"]))
    row = capacity.withColumn("reach", reach).withColumn("spare", F.lit(shards - 1) - F.size("reach"))
    state = _state(shard=F.lit(0), fill=F.lit(0).cast("long"), done=F.lit(0).cast("long"), firsts=none)

    def forth(s, x):
        even = (F.col("total") - (s["done"] - s["fill"])) / (F.lit(shards) - s["shard"])
        fits_later = F.when(s["shard"] < F.col("spare"), F.lit(True)).otherwise(F.get(F.col("reach"), s["shard"] - F.col("spare")) < x["unit"])
        nearer = (s["fill"] + x["size"] - even) >= (even - s["fill"])
        close = (s["fill"] > 0) & (s["shard"] < shards - 1) & ((s["fill"] + x["size"] > F.col("capacity")) | (fits_later & nearer))
        done = s["done"] + x["size"]
        return F.when(close, _state(shard=s["shard"] + 1, fill=x["size"], done=done, firsts=F.concat(s["firsts"], F.array(x["unit"])))).otherwise(
            _state(shard=s["shard"], fill=s["fill"] + x["size"], done=done, firsts=s["firsts"]))

    firsts = F.aggregate("units", state, forth, lambda s: s["firsts"])
    # Stored, as the optimizer would otherwise repeat the folds for every unit.
    return stored(row.select("units", firsts.alias("firsts")), "shard_cuts").select(F.explode("units").alias("u"), "firsts").select(
        F.col("u.unit").alias("unit"), F.size(F.filter("firsts", lambda x: x <= F.col("u.unit"))).alias("shard"))


def shard(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of each row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(
        F.col(id).alias("doc_id"), (F.octet_length(whole) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"),
        unit_of(whole).alias("unit"), F.pmod(F.xxhash64(F.col(id)), F.lit(LANES)).cast("int").alias("lane")), "shard_rows")
    cells = rows.groupBy("unit", "lane").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    units = cells.groupBy("unit").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"))
    units = stored(units, "shard_units")
    placed = units.select("unit", "rows").join(cuts(stored(least_capacity(units.select("unit", "size"), shards), "shard_capacity"), shards), "unit")
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    offset = placed.select("unit", "shard", F.coalesce(F.sum("rows").over(before("shard").orderBy("unit")), F.lit(0)).alias("unit_at"))
    lanes = cells.select("unit", "lane", F.coalesce(F.sum("rows").over(before("unit").orderBy("lane")), F.lit(0)).alias("lane_at"))
    slots = lanes.join(offset, "unit").select("unit", "lane", "shard", (F.col("unit_at") + F.col("lane_at")).alias("at"))
    nth = F.row_number().over(W.partitionBy("unit", "lane").orderBy("text_crc32", "size", "doc_id"))
    return rows.join(slots, ["unit", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + nth - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
