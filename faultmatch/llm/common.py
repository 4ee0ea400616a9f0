"""Reading, batching and placing work, shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from faultmatch.session import configure, cut, new_path

#: Documents of an Arrow batch. It bounds what a Python worker holds of the input at a time.
BATCH_ROWS = 512
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and batches small enough for very long texts."""
    configure(spark)
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "1.0")  # whole texts are stored nearly as they are
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Python workers import this package from where the driver has it, or from what --py-files ships
    env = spark.sparkContext.environment
    places = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in places:
        env["PYTHONPATH"] = os.pathsep.join([*places, ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages survive lost executors.

    Its shuffle files are no longer needed; Spark drops them once the driver has collected its garbage.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Map Arrow batches. ``make`` runs once a task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


__all__ = ["BATCH_ROWS", "ready", "table", "written", "cut", "new_path", "per_batch", "texts_of", "F"]
