"""Trained models over the error features, all from the distributed ML library."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, LinearSVC, OneVsRest,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, text as tx
from faultmatch.operators import clusters as cl, net as nt
from faultmatch.plans import matching as mt
from faultmatch.session import cut

SEED = 42
#: Levels of the decision tree, features that approximate the kernel, passes of each linear machine.
TREE_DEPTH, KERNEL_FEATURES, PASSES = 8, 64, 25


def training_points(kb: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feature columns, label and category of every rated feedback row.

    Text features are taken once per rated knowledge row, before its ratings multiply it.
    """
    rated = feedback.filter(F.col("was_helpful").isNotNull()).select(
        "feedback_id", F.col("solution_hash").alias("error_hash"), "was_helpful", "created_at"
    )
    texts = kb.join(rated.select("error_hash").distinct(), "error_hash", "left_semi").select(
        "kb_id", "error_hash", "error_signature", tx.categorize("error_signature").alias("category"),
        *sc.text_features("error_text"),
    )
    rows = rated.join(texts, "error_hash").select(
        "kb_id", "feedback_id", "error_hash", "error_signature", "category", "created_at",
        F.col("was_helpful").alias("worked"), F.col("was_helpful").cast("double").alias("label"),
        *[n for n in sc.FEATURE_NAMES if n not in sc.TIME_FEATURES], *sc.time_features("created_at"),
    )
    return rows


def point_groups(kb: DataFrame, feedback: DataFrame) -> DataFrame:
    """The rows of ``training_points`` without their ids, equal ones as one row with ``weight``, their number.

    A text's features do not depend on its rating, nor the time's on the text.  So
    both sides are summed up before they meet: an error with many knowledge rows
    and many ratings gives one row for each different text and hour of the week,
    not one for each pair.  ``newest`` is the time of the last rating.
    """
    rated = (
        feedback.filter(F.col("was_helpful").isNotNull())
        .select(F.col("solution_hash").alias("error_hash"), F.col("was_helpful").alias("worked"), *sc.time_features("created_at"), "created_at")
        .groupBy("error_hash", "worked", *sc.TIME_FEATURES)
        .agg(F.count("*").alias("_ratings"), F.max("created_at").alias("newest"))
    )
    features = [n for n in sc.FEATURE_NAMES if n not in sc.TIME_FEATURES]
    texts = (
        kb.groupBy("error_hash", "error_signature", "error_text").agg(F.count("*").alias("_rows"))
        .select("error_hash", "error_signature", "_rows", *sc.text_features("error_text"))
        .groupBy("error_hash", "error_signature", *features).agg(F.sum("_rows").alias("_rows"))
        .withColumn("category", tx.categorize("error_signature"))
    )
    return rated.join(texts, "error_hash").select(
        "error_hash", "error_signature", "category", "worked", F.col("worked").cast("double").alias("label"),
        *sc.FEATURE_NAMES, "newest", (F.col("_ratings") * F.col("_rows")).alias("weight"),
    )


def summed(points: DataFrame, *keys: str) -> DataFrame:
    """Points as models take them: one row per different features and ``keys``, with ``weight``, a double."""
    return points.groupBy(*keys, *sc.FEATURE_NAMES).agg(F.sum(cl.weight(points)).cast("double").alias("weight"))


def query_points(queries: DataFrame, text: str = "clean_text", ts: str = "ts") -> DataFrame:
    return queries.select(*queries.columns, *sc.features(text, ts))


def assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=sc.FEATURE_NAMES, outputCol="features").transform(rows)


def cluster_centres(points: DataFrame, k: int = fv.CLUSTER_COUNT, seed: int = SEED) -> cl.Centres:
    """Centres by parallel k-means++; the library returns fewer than ``k`` when distinct points run out."""
    kmeans = KMeans(k=k, initMode="k-means||", maxIter=1000, tol=1e-5, seed=seed, featuresCol="features", weightCol="weight")
    found = kmeans.fit(assembled(summed(points))).clusterCenters()
    return cl.Centres(list(range(len(found))), [[float(x) for x in c] for c in found])


def success_tree(points: DataFrame, seed: int = SEED, depth: int = TREE_DEPTH) -> DecisionTreeClassificationModel:
    """Entropy tree of at most ``depth`` levels; all points are used."""
    tree = DecisionTreeClassifier(impurity="entropy", maxDepth=depth, seed=seed, weightCol="weight")
    return tree.fit(assembled(summed(points, "label")))


def success_net(points: DataFrame, scale: bool = True, seed: int = SEED, epochs: int = 100) -> nt.Net:
    """Two hidden layers of max(10, inputs/2).  Hidden units are sigmoid, the loss is log loss, without dropout."""
    inputs = len(sc.FEATURE_NAMES)
    hidden = max(10, inputs // 2)
    rows = summed(points, "label").persist()
    try:
        mean, deviation = moments(rows) if scale else (np.zeros(inputs), np.ones(inputs))
        return nt.fit(rows, sc.FEATURE_NAMES, [inputs, hidden, hidden, 2], mean, deviation, seed, epochs)
    finally:
        rows.unpersist()


def tree_prediction(tree: DecisionTreeClassificationModel, rows: DataFrame) -> DataFrame:
    """Whether a solution will work, with the feature-strength confidence."""
    out = tree.transform(assembled(rows)).withColumn("tree_works", F.col("prediction") == 1.0)
    confidence = sc.tree_confidence(list(sc.FEATURE_NAMES), F.col("prediction"))
    return out.withColumn("tree_confidence", confidence).drop("features", "rawPrediction", "probability", "prediction")


def net_prediction(net: nt.Net, rows: DataFrame) -> DataFrame:
    out = rows.withColumn("_p", net.success([F.col(n) for n in sc.FEATURE_NAMES]))
    failure, success = 1.0 - F.col("_p"), F.col("_p")
    return (
        out.withColumn("neural_confidence", sc.neural_confidence(success, failure))
        .withColumn("neural_works", sc.neural_works(success, failure))
        .drop("_p")
    )


def split_importance(tree: DecisionTreeClassificationModel) -> list[tuple[str, int, float]]:
    """Share of the tree's splits per feature, from its printed form (one line per branch)."""
    found = [int(i) for i in re.findall(r"If \(feature (\d+) ", tree.toDebugString)]
    return [
        (sc.FEATURE_NAMES[i], found.count(i), found.count(i) / len(found)) for i in sorted(set(found))
    ]


def moments(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature, 1.0 where it does not vary."""
    found = cl.weighted_spread(points, sc.FEATURE_NAMES).first()
    mean = np.array([found[f"mean_{n}"] or 0.0 for n in sc.FEATURE_NAMES])
    return mean, np.array([(found[n] or 0.0) ** 0.5 or 1.0 for n in sc.FEATURE_NAMES])


def fourier_features(rows: DataFrame, scales: np.ndarray, dims: int = KERNEL_FEATURES, seed: int = SEED) -> DataFrame:
    """Random Fourier features of a Gaussian kernel whose width follows the features' deviations."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(len(scales), dims)) / (scales[:, None] * np.sqrt(len(scales)))
    offsets = rng.uniform(0, 2 * np.pi, size=dims)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        z = np.cos(np.vstack(x.to_numpy()) @ weights + offsets) * np.sqrt(2.0 / dims)
        return pd.Series(list(z))

    return rows.withColumn("features", array_to_vector(project(F.array(*[F.col(n) for n in sc.FEATURE_NAMES]))))


def category_classifier(points: DataFrame, complexity: float = 100.0, seed: int = SEED) -> DataFrame:
    """One-vs-rest linear machines over the Fourier features: training rows with ``label`` and ``prediction``."""
    index = {c: i for i, c in enumerate([c for c, _ in fv.CATEGORIES] + [fv.CATEGORY_DEFAULT])}
    numbers = F.create_map(*[F.lit(x) for pair in index.items() for x in pair])
    own = cut(summed(points, "category"))
    scales = moments(own)[1]

    def projected(rows: DataFrame) -> DataFrame:
        return fourier_features(rows.withColumn("label", numbers[F.col("category")].cast("double")), scales, seed=seed)

    data = projected(own)
    n = max(1.0, own.agg(F.sum("weight")).first()[0] or 0.0)
    svm = LinearSVC(maxIter=PASSES, regParam=1.0 / (complexity * n), standardization=False)
    # the library keeps the rows it reads once per class under its own persist
    model = OneVsRest(classifier=svm, labelCol="label", featuresCol="features", weightCol="weight", parallelism=5).fit(data)
    return model.transform(projected(points))


@dataclass
class Learned:
    """Everything the model layer needs."""

    centres: cl.Centres
    clusters: DataFrame
    tree: DecisionTreeClassificationModel
    net: nt.Net


def learn(points: DataFrame, solutions: DataFrame, k: int = fv.CLUSTER_COUNT) -> Learned:
    """Train on rated points; ``solutions``: kb_id, error_text, steps_text, success_rate, created_at."""
    points = points.persist()
    try:
        centres = cluster_centres(points, k)
        members = cl.assign(points, centres)
        rows = cl.assign(
            solutions.select("kb_id", "steps_text", "success_rate", "created_at", *sc.features("error_text", "created_at")),
            centres,
        )
        clusters = cut(cl.summary(members).join(cl.templates(rows), "cluster", "left"))
        return Learned(centres, clusters, success_tree(points), success_net(points))
    finally:
        points.unpersist()


def predictions(queries: DataFrame, learned: Learned) -> DataFrame:
    """Cluster, tree and net output per query (query_id, clean_text, ts)."""
    rows = query_points(queries)
    rows = cl.flag_anomalies(cl.assign(rows, learned.centres), learned.centres)
    rows = cl.recommend(rows, learned.clusters)
    return net_prediction(learned.net, tree_prediction(learned.tree, rows))


def model_match(queries: DataFrame, learned: Learned, threshold: float = 0.4, source: str = "comprehensive_ml", version: str = "ML-2.0") -> DataFrame:
    """The cluster's template where the combined prediction is above ``threshold``."""
    combined = sc.combine("tree_confidence", "cluster_confidence", "neural_confidence")
    rows = predictions(queries, learned).withColumn("confidence", combined)
    return rows.filter((F.col("confidence") > threshold) & ~tx.is_blank("template")).select(
        "query_id",
        F.lit(source).alias("source"),
        "error_hash",
        F.col("template").alias("steps_text"),
        "confidence",
        F.when(F.col("tree_works"), F.col("confidence")).otherwise(1.0 - F.col("confidence")).alias("success_rate"),
        F.lit(0).cast("long").alias("feedback_count"),
        F.lit(False).alias("has_conflicts"),
        F.lit(version).alias("version"),
    )


def blended_vector_match(queries: DataFrame, kb: DataFrame, vectors: DataFrame, learned: Learned) -> DataFrame:
    """Vector and fuzzy answer with 0.3 of the net's confidence mixed in."""
    base = mt.vector_fuzzy_match(queries, kb, vectors)
    sure = net_prediction(learned.net, query_points(queries.select("query_id", "clean_text", "ts"))).select(
        "query_id", "neural_confidence"
    )
    return (
        base.join(sure, "query_id")
        .withColumn("confidence", F.col("confidence") * 0.7 + F.col("neural_confidence") * 0.3)
        .withColumn("source", F.lit("ml_enhanced_vector"))
        .drop("neural_confidence")
    )


def insights(queries: DataFrame, learned: Learned, forecasts: DataFrame) -> DataFrame:
    """Anomaly, trend, net and cluster insight per query as one nested row.

    ``forecasts``: category, predicted, confidence; a row per category.
    """
    rows = predictions(queries, learned).withColumn("category", tx.categorize("signature"))
    trend = forecasts.select("category", F.col("predicted").alias("next_hour"), F.col("confidence").alias("trend_confidence"))
    return rows.join(trend, "category", "left").select(
        "query_id",
        "is_anomaly",
        F.struct("category", F.coalesce("next_hour", F.lit(0.0)).alias("predicted"),
                 F.coalesce("trend_confidence", F.lit(0.0)).alias("confidence")).alias("trend"),
        F.struct(F.col("neural_works").alias("works"), F.col("neural_confidence").alias("confidence")).alias("neural"),
        F.struct("template", F.col("cluster_confidence").alias("confidence")).alias("cluster"),
    )


def flat_insights(nested: DataFrame) -> DataFrame:
    """The rows of ``insights`` in the columns that ``enhance``, ``suggestions`` and ``report`` take."""
    return nested.select(
        "query_id", "is_anomaly", F.col("neural.works").alias("neural_works"), F.col("neural.confidence").alias("neural_confidence"),
        F.col("trend.category").alias("trend_category"), F.col("trend.predicted").alias("trend_predicted"),
        F.col("trend.confidence").alias("trend_confidence"),
        F.col("cluster.template").alias("cluster_template"), F.col("cluster.confidence").alias("cluster_confidence"),
    )
