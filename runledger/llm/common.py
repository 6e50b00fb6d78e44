"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import cut_lineage

#: Rows and bytes of one Arrow batch; long texts make small batches.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def tuned(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: survives lost executors, cuts lineage."""
    return cut_lineage(df, purpose)


def worker_cache(name: str, make: Callable):
    """A value kept by one Python worker between its tasks."""
    home = sys.modules.setdefault("_runledger_worker", types.ModuleType("_runledger_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def drop_worker_caches(*keep: str) -> None:
    """Forget what earlier operators left in this Python worker, but for the values named; workers are reused between jobs."""
    home = sys.modules.get("_runledger_worker")
    for name in [n for n in vars(home or types) if home and not n.startswith("__") and n not in keep]:
        delattr(home, name)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a reused worker that waits would keep it from its executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def sizes(values: pa.Array) -> pa.Array:
    """Bytes of each string, 4 for each element of a list, 0 for null."""
    listed = pa.types.is_list(values.type)
    n = pc.list_value_length(values) if listed else pc.binary_length(values)
    return pc.fill_null(pc.multiply(n.cast(pa.int64()), 4 if listed else 1), 0)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``limit`` bytes in each; a longer value stands alone."""
    for batch in batches:
        at, filled = 0, 0
        for i, n in enumerate(sizes(batch.column(column)).to_pylist()):
            if filled and filled + n > limit:
                yield batch.slice(at, i - at)
                at, filled = i, 0
            filled += n
        if at < batch.num_rows:
            yield batch.slice(at)


def word_count(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
