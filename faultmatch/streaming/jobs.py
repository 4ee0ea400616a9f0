"""Streaming twins of the batch aggregates.

Every job runs with ``availableNow``: it takes what the source holds and keeps its
progress, state and result under ``path``.  Started again with the same path, it
reads only what is new.  Without a path it starts afresh in a new folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from faultmatch import fixed_values as fv
from faultmatch.functions import text as tx
from faultmatch.operators import feedback as fb, vectors as ve
from faultmatch.session import new_path


def read_files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    table = spark._jvm.org.apache.hadoop.fs.Path(folder, pattern)
    if "*" not in pattern and table.getFileSystem(spark._jsc.hadoopConfiguration()).isDirectory(table):
        # a table of many files is a folder of that name, into which the filter on file names does not look
        stream = reader.parquet(os.path.join(folder, pattern))
    else:
        stream = reader.option("pathGlobFilter", pattern).parquet(folder)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def _versions(spark: SparkSession, folder: str, complete: bool = False) -> list[int]:
    """Numbers of the result folders, oldest first; with ``complete``, of those fully written."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    if complete:
        found = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in found)


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run_updates(stream: DataFrame, path: str, keys: list[str]) -> None:
    """Merge every updated aggregate row into the result, one version a micro-batch.

    A version holds the newest value of every key.  A batch that runs twice
    merges into the version before it again and overwrites its own.  The last
    two versions stay, so the result does not grow with the number of batches.
    """
    out = os.path.join(path, "out")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, out, complete=True) if v < number]
        rows = batch.persist()
        merged = rows
        if before:
            old = spark.read.schema(batch.schema).parquet(os.path.join(out, f"version={before[-1]}"))
            merged = rows.unionByName(old.join(rows.select(*keys), keys, "left_anti"))
        merged.write.mode("overwrite").parquet(os.path.join(out, f"version={number}"))
        rows.unpersist()
        for version in before[:-1]:
            _drop(spark, os.path.join(out, f"version={version}"))

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", os.path.join(path, "progress"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Newest value of every key."""
    out = os.path.join(path, "out")
    versions = _versions(spark, out, complete=True)
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(os.path.join(out, f"version={versions[-1]}"))


def _materialise(stream: DataFrame, keys: list[str], name: str, path: str | None) -> DataFrame:
    path = path or new_path(stream.sparkSession, name)
    run_updates(stream, path, keys)
    return latest(stream.sparkSession, path, stream.schema)


def security_per_hour(log: DataFrame, late: str = "2 hours", path: str | None = None) -> DataFrame:
    """Events per type and hour; events later than ``late`` are dropped."""
    hours = log.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "event_type").agg(
        F.count("*").alias("events")
    )
    return _materialise(
        hours.select(F.col("w.start").alias("hour"), "event_type", "events"), ["hour", "event_type"], "security-hours", path,
    )


def solution_stats(feedback: DataFrame, path: str | None = None) -> DataFrame:
    """Continuously updated feedback statistics per solution."""
    return _materialise(fb.solution_stats(feedback), ["solution_hash"], "solution-stats", path)


def user_windows(log: DataFrame, late: str = "2 hours", path: str | None = None) -> DataFrame:
    """Limited-type events per user in sliding 24-hour windows that move by the hour.

    Coarser than the exact per-request count of the batch check: the window end
    is the next full hour.
    """
    counted = (
        log.filter(F.col("event_type").isin(fv.RATE_LIMITED_TYPES))
        .withWatermark("created_at", late)
        .groupBy(F.window("created_at", "24 hours", "1 hour").alias("w"), "user_id")
        .agg(F.count("*").alias("queries"))
    )
    rows = counted.select(F.col("w.end").alias("window_end"), "user_id", "queries")
    return _materialise(rows, ["window_end", "user_id"], "user-windows", path).withColumn(
        "allowed", F.col("queries") < fv.MAX_DAILY_QUERIES
    )


def category_hours(feedback: DataFrame, late: str = "2 hours", path: str | None = None) -> DataFrame:
    """Hourly counts per category, the input of the trend functions."""
    hours = (
        feedback.withColumn("category", tx.categorize("error_signature"))
        .withWatermark("created_at", late)
        .groupBy("category", F.window("created_at", "1 hour").alias("w"))
        .agg(F.count("*").alias("n"))
    )
    return _materialise(hours.select("category", F.col("w.start").alias("hour"), "n"), ["category", "hour"], "category-hours", path)


def index_vectors(stream: DataFrame, path: str, key: str = "kb_id") -> DataFrame:
    """Incremental index: each batch adds the vectors that are not indexed yet."""
    spark = stream.sparkSession
    out = os.path.join(path, "index")

    def add(batch: DataFrame, number: int) -> None:
        rows = ve.build_index(batch, key).dropDuplicates([key])
        mine = f"batch={number}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(out)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(folder):
            done = spark.read.option("basePath", out).parquet(out).filter(F.col("batch") != number)
            rows = rows.join(done.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(os.path.join(out, mine))

    query = (
        stream.writeStream.option("checkpointLocation", os.path.join(path, "progress"))
        .trigger(availableNow=True)
        .foreachBatch(add)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out).drop("batch")
