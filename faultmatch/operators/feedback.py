"""Feedback statistics and their joins to the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, text as tx


def helpful(c: str = "was_helpful"):
    """1.0 for a helpful rating; unknown counts as not helpful."""
    return F.when(F.col(c), 1.0).otherwise(0.0)


def solution_stats(feedback: DataFrame) -> DataFrame:
    """Success rate, count and conflict rate per solution."""
    return feedback.groupBy("solution_hash").agg(
        F.avg(helpful()).alias("success_rate"),
        F.count("*").alias("feedback_count"),
        F.avg(F.when(F.col("was_helpful"), 0.0).otherwise(1.0)).alias("conflict_rate"),
    )


def with_stats(kb: DataFrame, feedback: DataFrame) -> DataFrame:
    """Knowledge rows with coalesced statistics; ``raw_rate`` stays null for unrated rows."""
    return join_stats(kb, solution_stats(feedback))


def join_stats(kb: DataFrame, s: DataFrame) -> DataFrame:
    return (
        kb.join(s, kb["error_hash"] == s["solution_hash"], "left")
        .drop("solution_hash")
        .withColumn("raw_rate", F.col("success_rate"))
        .withColumn("success_rate", F.coalesce("success_rate", F.lit(0.5)))
        .withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)))
        .withColumn("has_conflicts", F.coalesce("conflict_rate", F.lit(0.0)) > fv.CONFLICT_THRESHOLD)
        .drop("conflict_rate")
    )


def recalculated_confidence(feedback: DataFrame) -> DataFrame:
    return solution_stats(feedback).withColumn(
        "confidence", sc.confidence("success_rate", "feedback_count", F.col("conflict_rate"))
    )


def proven_rates(feedback: DataFrame, minimum: int = 3) -> DataFrame:
    """Rates of solutions rated at least ``minimum`` times."""
    return (
        solution_stats(feedback)
        .filter(F.col("feedback_count") >= minimum)
        .select("solution_hash", "success_rate", "feedback_count")
    )


def taught(teachings: DataFrame) -> DataFrame:
    """Teach batch with signature, hash and steps; batches without a step are refused."""
    return (
        teachings.withColumn("steps", tx.teach_steps("steps_text"))
        .filter((F.size("steps") > 0) & ~tx.is_blank("raw_text"))
        .withColumn("error_signature", tx.normalize("raw_text"))
        .withColumn("error_hash", tx.fingerprint("error_signature"))
    )


def conflict_lookup(teach: DataFrame, kb: DataFrame, feedback: DataFrame) -> DataFrame:
    """Ratings of the knowledge rows that share the taught hash or signature.

    Feedback is summed per hash and knowledge rows are counted per
    (hash, signature) before either side meets the batch, so a solution with
    millions of ratings takes part as one row.
    """
    sums = feedback.groupBy("solution_hash").agg(F.sum(helpful()).alias("good"), F.count("*").alias("n"))
    rated = (
        kb.groupBy("error_hash", "error_signature").agg(F.count("*").alias("rows"))
        .join(sums, F.col("error_hash") == F.col("solution_hash"))
        .select(
            F.col("error_hash").alias("kb_hash"),
            F.col("error_signature").alias("kb_signature"),
            (F.col("rows") * F.col("good")).alias("good"),
            (F.col("rows") * F.col("n")).alias("n"),
        )
    )
    keys = teach.select("error_hash", "error_signature").distinct()
    by_hash = keys.join(rated, F.col("error_hash") == F.col("kb_hash"))
    by_signature = keys.join(rated, F.col("error_signature") == F.col("kb_signature"))
    hits = by_hash.unionByName(by_signature).dropDuplicates(
        ["error_hash", "error_signature", "kb_hash", "kb_signature"]
    )
    totals = hits.groupBy("error_hash", "error_signature").agg(
        F.sum("good").alias("helpful_ratings"), F.sum("n").alias("ratings")
    )
    return teach.select("teach_id", "error_hash", "error_signature").join(
        totals, ["error_hash", "error_signature"]
    )


def conflict_check(teach: DataFrame, kb: DataFrame, feedback: DataFrame) -> DataFrame:
    """Existing success rate per teaching; below 0.6 it is a conflict, unknown is 0.5 and none."""
    found = conflict_lookup(teach, kb, feedback).select(
        "teach_id", (F.col("helpful_ratings") / F.col("ratings")).alias("rate")
    )
    return (
        teach.join(found, "teach_id", "left")
        .withColumn("existing_success_rate", F.coalesce("rate", F.lit(0.5)))
        .withColumn("has_conflicts", F.coalesce(F.col("rate") < fv.TEACH_CONFLICT_RATE, F.lit(False)))
        .drop("rate")
    )
