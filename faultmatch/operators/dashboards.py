"""Operational reports over feedback, knowledge and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import text as tx
from faultmatch.operators.audit import within
from faultmatch.operators.feedback import helpful, solution_stats


def rate_and_count(df: DataFrame, key: Column, name: str, count: str = "uses") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.avg(helpful()).alias("success_rate"), F.count("*").alias(count))


def accuracy_by_band(feedback: DataFrame) -> DataFrame:
    rated = feedback.filter(F.col("confidence_rating").isNotNull())
    return rate_and_count(rated, tx.rating_band("confidence_rating"), "confidence_level", "sample_size")


def methods(feedback: DataFrame, as_of: str) -> DataFrame:
    return rate_and_count(within(feedback, as_of, "7 DAYS"), F.col("solution_source"), "solution_source").withColumn(
        "method", tx.label_of("solution_source", fv.METHOD_NAMES)
    )


def top_category(kb: DataFrame) -> DataFrame:
    """The most frequent category with the size of the knowledge base."""
    counts = kb.groupBy(tx.kb_category("error_signature").alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.max(F.struct("n", "category")).alias("top"), F.sum("n").alias("total_solutions"))
    return total.select("total_solutions", F.col("top.category").alias("category"), F.col("top.n").alias("n"))


def feedback_summary(feedback: DataFrame, as_of: str) -> DataFrame:
    """Thirty days of ratings in one pass."""
    return within(feedback, as_of, "30 DAYS").agg(
        F.count("*").alias("total_feedback"),
        F.coalesce(F.avg(helpful()), F.lit(0.0)).alias("success_rate"),
        F.count_distinct(F.when(F.col("was_helpful") == F.lit(False), F.col("solution_hash"))).alias("conflicts"),
    )


def active_sessions(feedback: DataFrame, as_of: str, approximate: bool = False) -> DataFrame:
    recent = within(feedback, as_of, "24 HOURS")
    count = F.approx_count_distinct if approximate else F.count_distinct
    return recent.agg(count("session_id").alias("sessions"))


def source_use(feedback: DataFrame, as_of: str, source: str = "exact_match") -> DataFrame:
    mine = F.col("solution_source") == source
    return within(feedback, as_of, "7 DAYS").agg(
        F.sum(F.when(mine, 1).otherwise(0)).alias("uses"),
        F.coalesce(F.avg(F.when(mine, helpful())), F.lit(0.0)).alias("success_rate"),
        F.count("*").alias("total"),
    )


def quality(feedback: DataFrame) -> DataFrame:
    totals = feedback.agg(
        F.count_distinct("solution_hash").alias("solutions"),
        F.count("*").alias("entries"),
        F.sum(F.when(F.col("was_helpful"), 1).otherwise(0)).alias("helpful"),
    ).withColumn("rate", F.coalesce(F.try_divide("helpful", "entries"), F.lit(0.0)))
    band = F.when(F.col("rate") >= 0.8, "High").when(F.col("rate") >= 0.6, "Medium").when(F.col("rate") >= 0.4, "Low")
    return totals.withColumn("quality", band.otherwise("Poor"))


def health(feedback: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """System status from the shown (whole percent) rate, recent security events and conflicts."""
    ratings = feedback_summary(feedback, as_of).select(
        (F.round(F.col("success_rate") * 100) / 100).alias("rate"), "conflicts", F.lit(None).cast("long").alias("events")
    )
    events = within(log, as_of, "24 HOURS").agg(F.count("*").alias("events")).select(
        F.lit(None).cast("double").alias("rate"), F.lit(None).cast("long").alias("conflicts"), "events"
    )
    both = ratings.unionByName(events).agg(*[F.max(c).alias(c) for c in ("rate", "conflicts", "events")])

    def calm(rate: float, events: int, conflicts: int) -> Column:
        return (F.col("rate") >= rate) & (F.col("events") <= events) & (F.col("conflicts") <= conflicts)

    return both.withColumn(
        "status", F.when(calm(0.8, 2, 3), "Healthy").when(calm(0.6, 10, 10), "Caution").otherwise("Needs Attention")
    )


def week_performance(feedback: DataFrame, as_of: str) -> DataFrame:
    return within(feedback, as_of, "7 DAYS").agg(
        F.count("*").alias("total_predictions"),
        F.coalesce(F.avg(helpful()), F.lit(0.0)).alias("accuracy"),
        F.sum(F.when(F.col("was_helpful"), 1).otherwise(0)).alias("successful_predictions"),
    )


def _rating_sums(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("solution_hash").agg(F.sum(helpful()).alias("good"), F.count("*").alias("n"))


def _weighted(rows: DataFrame, key: str) -> DataFrame:
    """Rate and count per key from summed ratings times matching knowledge rows."""
    return rows.groupBy(key).agg(
        (F.sum(F.col("good") * F.col("rows")) / F.sum(F.col("n") * F.col("rows"))).alias("success_rate"),
        F.sum(F.col("n") * F.col("rows")).alias("samples"),
    )


def by_kb_source(feedback: DataFrame, kb: DataFrame, as_of: str) -> DataFrame:
    """Success by the source of the rated knowledge row; unmatched ratings are 'Unknown'.

    Ratings are summed per solution before the join, so a much rated solution is one row.
    """
    sums = _rating_sums(within(feedback, as_of, "7 DAYS"))
    sources = kb.groupBy("error_hash", "solution_source").agg(F.count("*").alias("rows"))
    joined = sums.join(sources, sums["solution_hash"] == sources["error_hash"], "left").select(
        F.coalesce("solution_source", F.lit("Unknown")).alias("source"), "good", "n",
        F.coalesce("rows", F.lit(1)).alias("rows"),
    )
    return _weighted(joined, "source")


def by_length_band(feedback: DataFrame, kb: DataFrame) -> DataFrame:
    bands = kb.groupBy("error_hash", tx.length_band("error_text").alias("band")).agg(F.count("*").alias("rows"))
    sums = _rating_sums(feedback)
    return _weighted(sums.join(bands, sums["solution_hash"] == bands["error_hash"]), "band")


def best_hours(feedback: DataFrame, as_of: str, k: int = 3) -> DataFrame:
    hours = rate_and_count(within(feedback, as_of, "7 DAYS"), F.hour("created_at"), "hour", "feedback_count")
    return hours.filter(F.col("feedback_count") >= 2).orderBy(F.col("success_rate").desc(), "hour").limit(k)


def cluster_report(feedback: DataFrame, kb: DataFrame, as_of: str) -> DataFrame:
    rates = solution_stats(feedback).select("solution_hash", "success_rate")
    recent = within(kb, as_of, "30 DAYS").withColumn("label", tx.cluster_label("error_signature"))
    # one row per signature: copies of a text meet its rate once
    classes = recent.groupBy("error_hash", "label").agg(F.count("*").alias("rows"))
    rated = classes.join(rates, classes["error_hash"] == rates["solution_hash"], "left")
    rate = F.coalesce("success_rate", F.lit(0.5))
    return rated.groupBy("label").agg(
        F.sum("rows").alias("error_count"), (F.sum(rate * F.col("rows")) / F.sum("rows")).alias("avg_success_rate")
    )


def recent_activity(feedback: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Newest ten ratings and newest five security events of the last day as text lines."""
    ratings = within(feedback, as_of, "24 HOURS").orderBy(F.col("created_at").desc(), "feedback_id").limit(10)
    text = F.coalesce("error_signature", F.lit("Unknown error"))
    short = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    events = within(log, as_of, "24 HOURS").orderBy(F.col("created_at").desc(), "event_id").limit(5)
    return ratings.select(
        F.lit("feedback").alias("kind"),
        F.col("feedback_id").alias("id"),
        F.concat(
            F.date_format("created_at", "HH:mm"), F.lit(" - "),
            F.when(F.col("was_helpful"), "helpful").otherwise("not helpful"), F.lit(" "),
            F.coalesce("solution_source", F.lit("unknown")), F.lit(" - "), short,
        ).alias("line"),
    ).unionByName(
        events.select(
            F.lit("security").alias("kind"),
            F.col("event_id").alias("id"),
            F.concat(
                F.date_format("created_at", "HH:mm"), F.lit(" - "), F.coalesce("severity", F.lit("unknown")),
                F.lit(" "), F.coalesce("event_type", F.lit("unknown")),
            ).alias("line"),
        )
    )
