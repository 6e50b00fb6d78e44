"""Writing staging, target and state tables.

A target is stored in key buckets, and each bucket in versions. A load writes a new
version of the buckets its staged rows fall into and then switches the manifest,
which names the version that counts of every bucket. Nothing is overwritten in
place: a load that fails before the switch leaves the target as it was, and is
simply rerun. One load at a time writes to a target.

:func:`tidy_target` bounds what is left behind: the turns of the manifest before the last
ones, and the versions that none of the turns kept names. A reader that began at a kept turn is not cut off.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET, VERSION = "key_bucket", "version"


def rebuild(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched_buckets(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets that hold the keys of ``rows``: at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col(key), buckets)).distinct().collect())


def _manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}-manifest"


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The last turn and the version of each bucket: one row for each bucket."""
    turns = spark.read.schema(f"turn LONG, {BUCKET} INT, {VERSION} STRING").parquet(_manifest_path(path))
    last = turns.agg(F.max("turn")).first()[0]
    return last, {r[BUCKET]: r[VERSION] for r in turns.where(F.col("turn") == last).collect()}


def _switch(spark: SparkSession, path: str, turn: int, versions: dict[int, str], mode: str = "append") -> None:
    """Make ``versions`` the state of the target: one file, which is there whole or not at all."""
    rows = [(turn, bucket, version) for bucket, version in sorted(versions.items())]
    spark.createDataFrame(rows, f"turn LONG, {BUCKET} INT, {VERSION} STRING").coalesce(1).write.mode(mode).parquet(_manifest_path(path))


def _write_version(rows: DataFrame, path: str) -> str:
    """Write rows with their bucket as a new version; a large bucket becomes several files."""
    version = f"v-{uuid.uuid4().hex}"
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/{VERSION}={version}")
    return version


def create_target(df: DataFrame, path: str, key: str, buckets: int) -> None:
    version = _write_version(df.withColumn(BUCKET, bucket_of(F.col(key), buckets)), path)
    _switch(df.sparkSession, path, 0, dict.fromkeys(range(buckets), version), "overwrite")


def read_target(spark: SparkSession, path: str, ddl: str, buckets: Iterable[int] | None = None) -> DataFrame:
    """The target, or only some of its buckets; other buckets and versions are never scanned."""
    _, versions = _manifest(spark, path)
    wanted = versions if buckets is None else {b: versions[b] for b in buckets}
    holds: dict[str, list[int]] = {}
    for bucket, version in wanted.items():
        holds.setdefault(version, []).append(bucket)
    folders = [f"{path.rstrip('/')}/{VERSION}={v}" for v in sorted(holds or {next(iter(versions.values())): []})]
    rows = spark.read.schema(f"{ddl}, {VERSION} STRING, {BUCKET} INT").option("basePath", path).parquet(*folders)
    current = [(F.col(VERSION) == v) & F.col(BUCKET).isin(sorted(held)) for v, held in sorted(holds.items())]
    return rows.where(reduce(lambda a, b: a | b, current, F.lit(False))).drop(VERSION)


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidy_target(spark: SparkSession, path: str, keep_turns: int = 3) -> dict[str, int]:
    """Remove manifest files and versions that only turns before the last ``keep_turns`` need.

    Counts of what was removed. Listed are the manifest, one file a turn since the last
    tidying, and the version folders. A version written but never named, by a load that
    broke off, goes as well; so do not run it while a load is writing.
    """
    if keep_turns < 1:
        raise ValueError("the last turn must be kept")
    turns = spark.read.schema(f"turn LONG, {BUCKET} INT, {VERSION} STRING").parquet(_manifest_path(path)).select("*", "_metadata.file_path")
    last = turns.agg(F.max("turn")).first()[0]
    kept = F.col("turn") > last - keep_turns
    named = {r[VERSION] for r in turns.where(kept).select(VERSION).distinct().collect()}
    stale = [r["file_path"] for r in turns.groupBy("file_path").agg(F.max("turn").alias("turn")).where(~kept).select("file_path").collect()]
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = [str(f.getPath().toString()) for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    unnamed = [f for f in there if f.rsplit("/", 1)[-1].startswith(f"{VERSION}=") and f.rsplit("=", 1)[-1] not in named]
    for gone in stale + unnamed:
        _delete(spark, gone)
    return {"manifest_files": len(stale), "versions": len(unnamed)}


def upsert_target(path: str, staged: DataFrame, key: str, ddl: str, buckets: int) -> None:
    """Insert new keys and replace existing ones, bucket by bucket; a null key replaces a null key.

    Another bucket count than the stored one is refused: keys would be looked for in wrong buckets.
    """
    spark = staged.sparkSession
    turn, versions = _manifest(spark, path)
    if len(versions) != buckets:
        raise ValueError(f"the target has {len(versions)} buckets, not {buckets}")
    touched = touched_buckets(staged, key, buckets)
    if not touched:
        return
    incoming = staged.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    arriving = incoming.select(F.col(BUCKET).alias("_bucket"), F.col(key).alias("_key"))
    kept = read_target(spark, path, ddl, touched).join(
        arriving, (F.col(BUCKET) == F.col("_bucket")) & F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    version = _write_version(kept.unionByName(incoming), path)
    _switch(spark, path, turn + 1, versions | dict.fromkeys(touched, version))
