"""Input validation with the audit log, and statistics over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import security as sec
from faultmatch.operators.ranking import running_sums



def recent_counts(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Limited-type log events of the same user in the 24 hours up to each request.

    Requests and events are merged on one time line per user; the count is the
    difference of two running sums.  The sums are built hour by hour, so one very
    busy user spreads over many tasks.
    """
    user = F.coalesce("user_id", F.lit("unknown")).alias("user_id")
    events = log.filter(F.col("event_type").isin(fv.RATE_LIMITED_TYPES)).select(
        F.lit(None).cast("string").alias("query_id"), user, F.col("created_at").alias("t"),
        F.lit(1).alias("kind"), F.lit(1).alias("one"),
    )
    opens = requests.select(
        "query_id", user, F.expr("ts - INTERVAL 24 HOURS").alias("t"), F.lit(0).alias("kind"), F.lit(0).alias("one")
    )
    closes = requests.select("query_id", user, F.col("ts").alias("t"), F.lit(2).alias("kind"), F.lit(0).alias("one"))
    line = events.unionByName(opens).unionByName(closes)
    seen = running_sums(
        line, ["user_id"], [F.col("t"), F.col("kind")], F.date_trunc("hour", "t"), {"seen": F.col("one")}
    )
    return (
        seen.filter(F.col("kind") != 1)
        .groupBy("query_id")
        .agg(F.sum(F.when(F.col("kind") == 2, F.col("seen")).otherwise(-F.col("seen"))).alias("recent_queries"))
    )


def counts_as_of(log: DataFrame, as_of: str) -> DataFrame:
    """Limited-type events per user in the 24 hours before one moment."""
    return (
        log.filter(F.col("event_type").isin(fv.RATE_LIMITED_TYPES))
        .filter(F.col("created_at") >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL 24 HOURS"))
        .filter(F.col("created_at") <= F.expr(f"TIMESTAMP '{as_of}'"))
        .groupBy("user_id")
        .agg(F.count("*").alias("recent_queries"))
    )


def validate(
    incoming: DataFrame, log: DataFrame | None = None, limit: int = fv.MAX_DAILY_QUERIES, strict: bool = False,
    max_length: int | None = None,
) -> DataFrame:
    """Verdict, message and clean text per row; without a log nobody is over the limit.

    Input of any length is judged, unless ``max_length`` refuses what is longer.
    """
    if log is None:
        rows = incoming.withColumn("recent_queries", F.lit(0).cast("long"))
    else:
        rows = incoming.join(recent_counts(incoming.select("query_id", "user_id", "ts"), log), "query_id")
    judge = sec.verdict_strict if strict else sec.verdict
    rows = rows.withColumn("verdict", judge("raw_text", F.col("recent_queries") >= limit, max_length))
    message = F.create_map(*[F.lit(x) for pair in fv.VERDICT_MESSAGES.items() for x in pair])
    clean = F.when(F.col("verdict").isin("QUERY", "ACCEPTED"), sec.sanitize("raw_text")).otherwise(F.col("raw_text"))
    return (
        rows.withColumn("is_valid", sec.is_accepted("verdict"))
        .withColumn("message", F.try_element_at(message, F.col("verdict")))
        .withColumn("clean_text", clean)
    )


def within(df: DataFrame, as_of: str, window: str, column: str = "created_at") -> DataFrame:
    """Rows of the trailing window; the comparison reaches the parquet scan."""
    return df.filter(F.col(column) >= F.expr(f"TIMESTAMP '{as_of}' - INTERVAL {window}"))


def log_stats(log: DataFrame, *keys) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count("*").alias("total_events"),
        F.sum(F.when(F.col("severity") == "HIGH", 1).otherwise(0)).alias("high_severity"),
        F.sum(F.when(F.col("severity") == "MEDIUM", 1).otherwise(0)).alias("medium_severity"),
        F.sum(F.when(F.col("event_type") == "SQL_INJECTION_ATTEMPT", 1).otherwise(0)).alias("sql_attempts"),
        F.sum(F.when(F.col("event_type") == "RATE_LIMIT_EXCEEDED", 1).otherwise(0)).alias("rate_limits"),
    )
