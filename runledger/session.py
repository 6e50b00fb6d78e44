"""Session settings the library relies on, and where it may write scratch data."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A JSON object with a repeated key keeps the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # The JVM never compiles methods above 8000 bytes of bytecode; beyond that,
    # splitting the long check cascades into small methods is many times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    local session without that setting falls back to a temporary folder; on a
    cluster a machine-local path would vanish with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="runledger-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for a scan that has fewer splits than there are cores.

    A scan of a large table has plenty of splits and is left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut_lineage(df, purpose: str):
    """Write ``df`` to the shared folder and read it back.

    Used where several later branches need one expensive result: the written
    table survives executor loss, unlike cached blocks.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
