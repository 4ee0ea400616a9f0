"""Reading and writing the fixed-schema tables as parquet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from faultmatch import fixed_values as fv
from faultmatch.functions import security as sec
from faultmatch.schemas import TABLES


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def init_tables(spark: SparkSession, base: str) -> list[str]:
    """Create every missing table as empty parquet; existing ones are left alone."""
    made = []
    for name in TABLES:
        path = os.path.join(base, name)
        exists = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = exists.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(exists):
            spark.createDataFrame([], schema_of(name)).write.parquet(path)
            made.append(name)
    return made


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(schema_of(name)).parquet(os.path.join(base, name))


def append(df: DataFrame, base: str, name: str) -> None:
    """Append rows under the table's schema; absent columns become null, unknown ones are refused."""
    fit(df, name).write.mode("append").parquet(os.path.join(base, name))


def fit(df: DataFrame, name: str) -> DataFrame:
    fields = schema_of(name).fields
    unknown = sorted(set(df.columns) - {f.name for f in fields})
    if unknown:
        raise ValueError(f"{name} has no columns {', '.join(unknown)}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def kb_scan(kb: DataFrame) -> DataFrame:
    """Knowledge rows that have a text."""
    return kb.select("kb_id", "error_hash", "error_signature", "error_text", "created_at").filter(
        F.col("error_text").isNotNull()
    )


def feedback_rows(ratings: DataFrame) -> DataFrame:
    """Rating events completed with the fixed defaults of a new feedback row."""
    return fit(ratings.withColumns({k: F.lit(v) for k, v in fv.FEEDBACK_DEFAULTS.items()}), "feedback")


def security_events(validated: DataFrame, strict: bool = False) -> DataFrame:
    """Audit rows of validated input; verdicts that log nothing drop out."""
    return (
        validated.withColumn("event_type", sec.event_type("verdict"))
        .filter(F.col("event_type").isNotNull())
        .select(
            F.col("query_id").alias("event_id"),
            F.col("ts").alias("created_at"),
            "event_type",
            F.coalesce("user_id", F.lit("unknown")).alias("user_id"),
            F.coalesce("session_id", F.lit("unknown")).alias("session_id"),
            sec.event_details("verdict", "raw_text").alias("details"),
            sec.severity("event_type", strict).alias("severity"),
        )
    )


def path_rows(steps: DataFrame, created_at: Column) -> DataFrame:
    """One tree path per walk from its step rows.

    Where the steps carry them, the walk keeps its session, error and author,
    and lasts as long as its steps together.
    """
    visited = F.transform(
        F.sort_array(F.collect_list(F.struct("step_no", "node_id", "decision"))),
        lambda s: F.struct(s["node_id"].alias("node_id"), s["decision"].alias("decision")),
    )
    kept = [F.min(c).alias(c) for c in ("session_id", "error_hash", "created_by") if c in steps.columns]
    if "seconds" in steps.columns:
        kept.append(F.sum("seconds").cast("int").alias("duration_seconds"))
    return steps.groupBy("path_id").agg(
        visited.alias("path"),
        F.bool_and("was_successful").alias("was_successful"),
        F.count("*").cast("int").alias("nodes_visited"),
        *kept,
    ).withColumn("created_at", created_at)
