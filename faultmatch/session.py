"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # scoring is heavy per byte: do not merge small shuffles into a single task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # the tables are stored in dictionaries, the texts made of them take many times their files' size:
    # a broadcast is planned for files well below the threshold, else when the size of the rows is known
    "spark.sql.sources.fileCompressionFactor": "50.0",
    # ranks are trimmed before the shuffle up to this k
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: str | int = "*", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("faultmatch")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for lineage cuts and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a folder
    of the warehouse serves, which all executors share as well.
    """
    current = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and current is None:
        named = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_faultmatch")
    if current is None:
        spark.sparkContext.setCheckpointDir(named)
    return named or current


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{os.urandom(8).hex()}")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a reused intermediate result reliably, so that losing executors costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """A wide table that several steps read, worked out once and kept as Parquet in the shared folder, of which each step reads its columns."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_broadcastable_slices(df: DataFrame, key: str, max_rows: int = 20_000) -> list[DataFrame]:
    """Split a rule-like table into slices that are each small enough to broadcast.

    The row count is checked first.  Up to ``max_rows`` the table is one
    broadcast; beyond that it becomes as many hash slices as needed.
    """
    n = df.count()
    slices = max(1, -(-n // (max_rows // 2 if n > max_rows else max_rows)))
    if slices == 1:
        return [F.broadcast(df)]
    return [
        F.broadcast(df.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i)) for i in range(slices)
    ]
