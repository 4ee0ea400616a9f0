"""Hourly error counts: trend, season, smoothing, forecast."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch import fixed_values as fv
from faultmatch.operators.ranking import running_sums

PERIOD = fv.SEASON_HOURS


def hourly_counts(events: DataFrame, category: Column, ts: str = "created_at") -> DataFrame:
    """One row per category and hour with errors.  Everything below works on this reduced series."""
    return events.groupBy(category.alias("category"), F.date_trunc("hour", ts).alias("hour")).agg(
        F.count("*").alias("n")
    )


def fill_gaps(hours: DataFrame) -> DataFrame:
    """Hours without errors as zero counts between the first and last hour of a category."""
    spans = hours.groupBy("category").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = spans.select("category", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return grid.join(hours, ["category", "hour"], "left").fillna(0, ["n"])


def _positions(hours: DataFrame) -> DataFrame:
    w = Window.partitionBy("category").orderBy("hour")
    return hours.withColumn("i", F.row_number().over(w) - 1).withColumn("lagged", F.lag("n", PERIOD).over(w))


def trend(hours: DataFrame) -> DataFrame:
    """Slope over the row position, 0 for series of ten points or fewer."""
    return (
        _positions(hours).groupBy("category")
        .agg(F.count("*").alias("points"), F.regr_slope("n", "i").alias("slope"))
        .select("category", "points", F.when(F.col("points") > 10, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("trend"))
    )


def seasonality(hours: DataFrame) -> DataFrame:
    """Mean product with the value a day of rows earlier, 0 without such a pair."""
    return _positions(hours).groupBy("category").agg(
        F.coalesce(F.avg(F.col("n") * F.col("lagged")), F.lit(0.0)).alias("seasonality")
    )


def next_value(hours: DataFrame) -> DataFrame:
    """Mean of the last five counts plus the trend, for series of more than ten points."""
    w = Window.partitionBy("category").orderBy(F.col("hour").desc())
    last = hours.withColumn("back", F.row_number().over(w)).filter("back <= 5").groupBy("category").agg(F.avg("n").alias("mean"))
    return trend(hours).filter("points > 10").join(last, "category").select(
        "category", (F.col("mean") + F.col("trend")).alias("predicted")
    )


def smoothed(hours: DataFrame, alpha: float = fv.SMOOTHING_ALPHA) -> DataFrame:
    """Exponential smoothing; a group is one category's hourly counts, one row per hour of history."""

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hour")
        return pdf.assign(smoothed=pdf["n"].astype(float).ewm(alpha=alpha, adjust=False).mean())

    return hours.groupBy("category").applyInPandas(
        smooth, "category string, hour timestamp, n long, smoothed double"
    )


def forecast(hours: DataFrame, ahead: int = 1, alpha: float = fv.SMOOTHING_ALPHA) -> DataFrame:
    """Forecast and its confidence per category; series under ten points give (0, 0)."""
    s = smoothed(hours, alpha)
    level = s.groupBy("category").agg(
        F.max_by("smoothed", "hour").alias("level"),
        F.avg(F.abs(F.col("n") - F.col("smoothed"))).alias("error"),
        F.avg("n").alias("mean"),
    )
    wave = math.sin(2 * math.pi * (ahead % PERIOD) / PERIOD)
    # a season counts only for series long enough to carry a trend
    season = F.when(F.col("points") > 10, F.col("seasonality")).otherwise(0.0)
    raw = F.col("level") + F.col("trend") * ahead
    raw = raw * F.when(season > 0.1, 1 + season * wave).otherwise(1.0)
    enough = F.col("points") >= 10
    return trend(hours).join(seasonality(hours), "category").join(level, "category").select(
        "category",
        F.when(enough, F.greatest(F.lit(0.0), raw)).otherwise(0.0).alias("predicted"),
        F.when(enough, F.greatest(F.lit(0.0), 1 - F.col("error") / F.col("mean"))).otherwise(0.0).alias("confidence"),
    )


def running_success(steps: DataFrame, key: str, order: list[Column], bucket: Column, hit: Column) -> DataFrame:
    """Uses so far and running success rate per node after each use."""
    sums = running_sums(
        steps, [key], order, bucket, {"times_used": F.lit(1), "_hits": F.when(hit, 1).otherwise(0)}
    )
    return sums.withColumn("success_rate", F.col("_hits") / F.col("times_used")).drop("_hits")
