"""Clusters of error features: nearest centre, radius, anomalies, summaries, recommendations.

A model is a handful of centres.  Their number is a parameter, so they travel with
the function that looks for the nearest one, in Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, text as tx
from faultmatch.operators.ranking import top_k


@dataclass(frozen=True)
class Centres:
    ids: list[int]
    points: list[list[float]]

    @property
    def radii(self) -> list[float]:
        return [max(1.0, fv.RADIUS_FACTOR * math.sqrt(sum(x * x for x in p))) for p in self.points]

    @property
    def mean_radius(self) -> float:
        return sum(self.radii) / len(self.radii)


def category_centres(rows: DataFrame, category: str = "category") -> Centres:
    """Mean feature vector per category, a fixed model without training; at most one centre per category."""
    means = rows.groupBy(category).agg(*[F.avg(n).alias(n) for n in sc.FEATURE_NAMES]).orderBy(category)
    found = means.limit(len(fv.CATEGORIES) + 1).collect()
    return Centres(list(range(len(found))), [[r[n] for n in sc.FEATURE_NAMES] for r in found])


def assign(rows: DataFrame, centres: Centres) -> DataFrame:
    """Nearest centre, its distance and its radius; ties go to the lower id.

    Squares are summed up feature by feature, a batch of rows at a time; a row without a feature has no distance.
    """
    ids, points, radii = np.array(centres.ids), np.array(centres.points, dtype=float), np.array(centres.radii)

    @F.pandas_udf("id int, d double, radius double")
    def nearest(x: pd.DataFrame) -> pd.DataFrame:
        columns = [x[n].to_numpy(dtype=float) for n in x.columns]
        squares = np.zeros((len(points), len(x)))
        for i, column in enumerate(columns):
            squares += (column - points[:, i : i + 1]) ** 2
        first = squares.argmin(axis=0)
        return pd.DataFrame({"id": ids[first], "d": np.sqrt(squares[first, np.arange(len(x))]), "radius": radii[first]})

    return rows.withColumn("_nearest", nearest(F.struct(*[F.col(n) for n in sc.FEATURE_NAMES]))).select(
        *rows.columns,
        # never null, and says so: joins on it need not look for the centre once more to leave out nulls
        F.coalesce("_nearest.id", F.lit(centres.ids[0])).alias("cluster"),
        F.col("_nearest.d").alias("distance"),
        F.col("_nearest.radius").alias("radius"),
    )


def flag_anomalies(assigned: DataFrame, centres: Centres) -> DataFrame:
    score = F.col("distance") / centres.mean_radius
    return assigned.withColumn("anomaly_score", score).withColumn("is_anomaly", score > fv.ANOMALY_THRESHOLD)


def weight(rows: DataFrame) -> Column:
    """How many equal rows a row stands for; 1 without a column that says it."""
    return F.col("weight") if "weight" in rows.columns else F.lit(1)


def weighted_spread(rows: DataFrame, names: list[str], *keys: str) -> DataFrame:
    """``mean_x`` and the population variance ``x`` of each column per key.

    Sums are taken from the least value, so that a column of one value has no variance at all.
    """
    w = weight(rows)
    least = rows.groupBy(*keys).agg(*[F.min(n).alias(f"_l_{n}") for n in names])
    both = rows.join(F.broadcast(least), list(keys)) if keys else rows.crossJoin(F.broadcast(least))
    total = F.sum(w).cast("double")

    def first(n: str) -> Column:
        return F.sum((F.col(n) - F.col(f"_l_{n}")) * w) / total

    def second(n: str) -> Column:
        return F.sum((F.col(n) - F.col(f"_l_{n}")) * (F.col(n) - F.col(f"_l_{n}")) * w) / total

    return both.groupBy(*keys).agg(
        *[(F.min(f"_l_{n}") + first(n)).alias(f"mean_{n}") for n in names],
        *[F.greatest(second(n) - first(n) * first(n), F.lit(0.0)).alias(n) for n in names],
    )


def summary(members: DataFrame) -> DataFrame:
    """Size, success rate, distinct errors and a name of the three main categories per cluster.

    ``members``: cluster, category, error_hash, worked and, where a row stands for many, weight.
    """
    w = weight(members)
    main = top_k(
        members.groupBy("cluster", "category").agg(F.sum(w).alias("n")),
        ["cluster"], [F.col("n").desc(), F.col("category").asc()], 3, "rank",
    )
    names = main.groupBy("cluster").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category"))), lambda r: r["category"]), "-").alias("name")
    )
    totals = members.groupBy("cluster").agg(
        F.sum(w).alias("size"),
        (F.sum(F.when(F.col("worked"), w).otherwise(0)) / F.sum(w)).alias("success_rate"),
        F.count_distinct("error_hash").alias("errors"),
    )
    return totals.join(names, "cluster")


def member_rows(members: DataFrame) -> DataFrame:
    """The errors of each cluster and how often each is in it."""
    return members.groupBy("cluster", "error_hash").agg(F.sum(weight(members)).alias("times"))


def keywords(members: DataFrame, k: int = 5) -> DataFrame:
    """Most frequent signature keywords per cluster, counted over members."""
    per_text = members.groupBy("cluster", "error_signature").agg(F.sum(weight(members)).alias("n"))
    counts = (
        per_text.select("cluster", "n", F.explode(tx.tokens("error_signature")).alias("keyword"))
        .groupBy("cluster", "keyword")
        .agg(F.sum("n").alias("members"))
    )
    return top_k(counts, ["cluster"], [F.col("members").desc(), F.col("keyword").asc()], k, "rank")


def variance_shares(members: DataFrame) -> DataFrame:
    """Population variance of each feature as a share of the cluster's total."""
    spread = weighted_spread(members, sc.FEATURE_NAMES, "cluster")
    total = F.lit(0.0)
    for n in sc.FEATURE_NAMES:
        total = total + F.col(n)
    shares = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"), F.when(total > 0, F.try_divide(F.col(n), total)).otherwise(F.col(n)).alias("share")
            )
            for n in sc.FEATURE_NAMES
        ]
    )
    return spread.select("cluster", F.inline(shares))


def templates(solutions: DataFrame) -> DataFrame:
    """Steps of the best rated solution per cluster.  ``solutions``: cluster, steps_text, success_rate, created_at, kb_id."""
    usable = solutions.filter(~tx.is_blank("steps_text"))
    best = F.struct(F.round("success_rate", 9), "created_at", "kb_id")
    return usable.groupBy("cluster").agg(F.max_by("steps_text", best).alias("template"))


def recommend(assigned: DataFrame, clusters: DataFrame) -> DataFrame:
    """Template and confidence per row.  ``clusters``: cluster, success_rate, template; one row per centre."""
    rows = assigned.join(clusters.select("cluster", F.col("success_rate").alias("cluster_success"), "template"), "cluster", "left")
    confidence = (1.0 - F.col("distance") / F.col("radius")) * F.col("cluster_success")
    return rows.withColumn("cluster_confidence", F.coalesce(confidence, F.lit(0.0)))


def augment(rows: DataFrame, keys: list[str], minimum: int = fv.MIN_TRAINING_ROWS, row_id: str = "feedback_id") -> DataFrame:
    """Fill groups below ``minimum`` rows up with copies whose features and time vary a little.

    The variation comes from a hash of row and copy number, so it repeats.  Only
    groups below ``minimum`` are numbered, which bounds them.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = rows.join(sizes.filter(F.col("_n") < minimum), keys)
    w = Window.partitionBy(*keys).orderBy(row_id)
    copies = (
        small.withColumn("_i", F.row_number().over(w) - 1)
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(minimum - 1))))
        .filter((F.col("_copy") < minimum - F.col("_n")) & (F.col("_copy") % F.col("_n") == F.col("_i")))
    )

    def noise(name: str) -> Column:
        return F.pmod(F.xxhash64(F.col(row_id), F.col("_copy"), F.lit(name)), F.lit(1_000_001)) / 1_000_000.0 - 0.5

    varied = copies.withColumns({n: F.col(n) + noise(n) * 0.1 for n in sc.FEATURE_NAMES}).withColumn(
        "created_at",
        F.timestamp_seconds(F.unix_micros("created_at") / 1_000_000 + F.floor(noise("minutes") * 2880) * 60),
    ).withColumn(row_id, F.concat(F.lit("synthetic_"), F.col(row_id), F.lit("_"), F.col("_copy").cast("string")))
    return rows.withColumn("synthetic", F.lit(False)).unionByName(
        varied.drop("_n", "_i", "_copy").withColumn("synthetic", F.lit(True))
    )


def gates(counts: DataFrame, n: str = "n", hours_since: Column | None = None) -> DataFrame:
    """What the number of training rows and the age of the models allow."""
    rows = F.col(n)
    old = F.lit(True) if hours_since is None else hours_since >= fv.RETRAIN_HOURS
    action = F.when(rows == 0, "none").when(rows < fv.MIN_TRAINING_ROWS, "augment").otherwise("train")
    return counts.withColumn("action", action).withColumn("retrain", (rows >= fv.MIN_RETRAIN_ROWS) & old)
