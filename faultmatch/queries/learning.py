"""K, S and the model layers: clusters, models, streaming jobs."""

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, text as tx
from faultmatch.operators import clusters as cl, feedback as fb, models as ml, series as se
from faultmatch.plans import matching as mt
from faultmatch.queries import matches as mq, oracle as o
from faultmatch.queries.base import register
from faultmatch.queries.reports import r6
from faultmatch.queries.scores import feature_columns_sql
from faultmatch.queries.upkeep import hours, sql_stamp
from faultmatch.session import cut, new_path
from faultmatch.sources.fixtures import AS_OF, VIEWS
from faultmatch.streaming import jobs

NAMES = sc.FEATURE_NAMES


def points(f):
    return ml.training_points(f.kb_texts, f.feedback)


def groups(f):
    return ml.point_groups(f.kb_texts, f.feedback)


def kb_points(f):
    return f.kb_texts.select(
        "kb_id", "steps_text", "created_at", tx.categorize("error_signature").alias("category"),
        *sc.features("error_text", "created_at"),
    )


def centres(f):
    """Fixed centres: the mean features of each category of the knowledge base, worked out once per run."""
    if not hasattr(f, "_centres"):
        f._centres = cl.category_centres(kb_points(f))
    return f._centres


def assigned_queries(f):
    return cl.assign(ml.query_points(mq.asked(f).select("query_id", "clean_text", "error_hash", "signature", "ts")), centres(f))


o.define("kb_points", f"SELECT kb_id, steps_text, created_at, success_rate, {o.first_contained('error_signature', fv.CATEGORIES, 'general')} AS category, {feature_columns_sql('error_text', 'created_at', 0)} FROM kbs", ["kbs"])
o.define("centres", f"SELECT row_number() OVER (ORDER BY category) - 1 AS cluster, * FROM (SELECT category, {', '.join(f'avg({n}) AS {n}' for n in NAMES)} FROM kb_points GROUP BY category)", ["kb_points"])
o.define("radii", f"SELECT *, greatest(1.0::DOUBLE, 2.5::DOUBLE * sqrt({' + '.join(f'{n} * {n}' for n in NAMES)})) AS radius FROM centres", ["centres"])
o.define("q_points", f"SELECT query_id, signature, ts, {feature_columns_sql('raw_text', 'ts', 0)} FROM inc", ["inc"])
o.define(
    "t_points",
    f"""SELECT k.kb_id, fb.feedback_id, k.error_hash, k.error_signature, fb.was_helpful AS worked,
    {o.first_contained('k.error_signature', fv.CATEGORIES, 'general')} AS category, {feature_columns_sql('k.error_text', 'fb.created_at', 0)}
    FROM kb k JOIN fb ON k.error_hash = fb.solution_hash WHERE was_helpful IS NOT NULL""",
    ["fb"],
)


def nearest_sql(table, key):
    d = "sqrt(" + " + ".join(f"pow(p.{n} - c.{n}, 2)" for n in NAMES) + ")"
    return f"""SELECT * FROM (SELECT p.*, c.cluster, c.radius, {d} AS distance,
    row_number() OVER (PARTITION BY {', '.join('p.' + k for k in key)} ORDER BY {d}, c.cluster) AS rn FROM {table} p, radii c) WHERE rn = 1"""


o.define("q_near", nearest_sql("q_points", ["query_id"]), ["q_points", "radii"])
o.define("t_near", nearest_sql("t_points", ["kb_id", "feedback_id"]), ["t_points", "radii"])
o.define("kb_near", nearest_sql("kb_points", ["kb_id"]), ["kb_points", "radii"])
o.define(
    "q_flags",
    """SELECT *, distance / (SELECT avg(radius) FROM radii) AS anomaly_score FROM q_near""",
    ["q_near", "radii"],
)


def flagged(f):
    c = centres(f)
    return cl.flag_anomalies(
        cl.assign(ml.query_points(mq.asked(f).select("query_id", "clean_text", "error_hash", "signature", "ts")), c), c
    )


def members(f):
    return cl.assign(groups(f), centres(f))


register(
    "k2_nearest_centre",
    lambda f: r6(assigned_queries(f), "distance", "radius").select("query_id", "cluster", "distance", "radius"),
    o.sql("SELECT query_id, cluster, round(distance, 6) AS distance, round(radius, 6) AS radius FROM q_near", "q_near"),
)
register(
    "k3_anomalies",
    lambda f: r6(flagged(f), "anomaly_score").select("query_id", "anomaly_score", "is_anomaly"),
    o.sql("SELECT query_id, round(anomaly_score, 6) AS anomaly_score, anomaly_score > 0.95 AS is_anomaly FROM q_flags", "q_flags"),
)
register(
    "g21_anomaly_rate",
    lambda f: flagged(f).filter(F.col("ts") >= F.expr(f"TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS")).agg(
        F.count("*").alias("queries"), F.sum(F.when(F.col("is_anomaly"), 1).otherwise(0)).alias("anomalies")
    ).withColumn("rate", F.round(F.col("anomalies") * 100.0 / F.greatest("queries", F.lit(1)), 6)),
    o.sql(
        f"""SELECT count(*) AS queries, count(*) FILTER (anomaly_score > 0.95) AS anomalies,
        round(count(*) FILTER (anomaly_score > 0.95) * 100.0::DOUBLE / greatest(count(*), 1), 6) AS rate FROM q_flags
        WHERE ts >= {o.TS} - INTERVAL 24 HOURS""",
        "q_flags",
    ),
)
register(
    "g22_cluster_summary",
    lambda f: r6(cl.summary(members(f)), "success_rate"),
    o.sql(
        """SELECT cluster, size, success_rate, errors, name FROM (SELECT cluster, count(*) AS size,
        round(avg(CASE WHEN worked THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate, count(DISTINCT error_hash) AS errors FROM t_near GROUP BY cluster)
        JOIN (SELECT cluster, string_agg(category, '-' ORDER BY rank) AS name FROM (SELECT cluster, category,
          row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, category) AS rank FROM t_near GROUP BY cluster, category) WHERE rank <= 3 GROUP BY cluster) USING (cluster)""",
        "t_near",
    ),
)
register(
    "g22_cluster_members",
    lambda f: cl.member_rows(members(f)),
    o.sql("SELECT cluster, error_hash, count(*) AS times FROM t_near GROUP BY cluster, error_hash", "t_near"),
)
register(
    "g23_cluster_keywords",
    lambda f: cl.keywords(members(f)),
    o.sql(
        f"""SELECT cluster, keyword, members, rank FROM (SELECT cluster, keyword, count(*) AS members,
        row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, keyword) AS rank FROM (
        SELECT cluster, unnest({o.tokens('error_signature')}) AS keyword FROM t_near) GROUP BY cluster, keyword) WHERE rank <= 5""",
        "t_near",
    ),
)
_total = " + ".join(f"var_pop({n})" for n in NAMES)
register(
    "g24_variance_shares",
    lambda f: r6(cl.variance_shares(members(f)), "share"),
    o.sql(
        " UNION ALL ".join(
            f"SELECT cluster, '{n}' AS feature, round(CASE WHEN {_total} > 0 THEN var_pop({n}) / ({_total}) ELSE var_pop({n}) END, 6) AS share FROM t_near GROUP BY cluster"
            for n in NAMES
        ),
        "t_near",
    ),
)


def _recommend(f):
    c = centres(f)
    solutions = cl.assign(kb_points(f).join(fb.with_stats(f.kb_texts, f.feedback).select("kb_id", "success_rate"), "kb_id"), c)
    clusters = cl.summary(members(f)).join(cl.templates(solutions), "cluster", "left")
    return r6(cl.recommend(assigned_queries(f), clusters), "cluster_confidence").select("query_id", "cluster", "template", "cluster_confidence")


register(
    "k8_recommendation",
    _recommend,
    o.sql(
        """SELECT query_id, cluster, template, round(coalesce((1 - distance / radius) * rate, 0), 6) AS cluster_confidence FROM q_near
        LEFT JOIN (SELECT cluster, avg(CASE WHEN worked THEN 1.0::DOUBLE ELSE 0.0 END) AS rate FROM t_near GROUP BY cluster) USING (cluster)
        LEFT JOIN (SELECT cluster, max_by(steps_text, (round(success_rate, 9), created_at, kb_id)) AS template FROM kb_near
          WHERE steps_text <> '' GROUP BY cluster) USING (cluster)""",
        "q_near", "t_near", "kb_near",
    ),
)
register(
    "k6_neural_confidence",
    lambda f: fb.with_stats(f.kb_texts, f.feedback).select(
        "kb_id",
        F.round(sc.neural_confidence(F.col("confidence_score"), 1 - F.col("success_rate")), 6).alias("confidence"),
        sc.neural_works(F.col("confidence_score"), 1 - F.col("success_rate")).alias("works"),
    ),
    o.sql(
        """SELECT kb_id, round(abs(p - 0.5) * 2, 6) AS confidence, p > 0.5 AS works FROM (SELECT kb_id,
        CASE WHEN confidence_score + (1 - success_rate) > 0 THEN confidence_score / (confidence_score + (1 - success_rate)) ELSE confidence_score END AS p FROM kbs)""",
        "kbs",
    ),
)


def _gates(f):
    counts = groups(f).groupBy("category").agg(F.sum("weight").alias("n"), F.max("newest").alias("newest"))
    age = F.expr(f"(unix_timestamp(TIMESTAMP '{AS_OF}') - unix_timestamp(newest)) / 3600")
    return cl.gates(counts, "n", age).drop("newest")


register(
    "k11_training_gates",
    _gates,
    o.sql(
        f"""SELECT category, n, CASE WHEN n = 0 THEN 'none' WHEN n < 50 THEN 'augment' ELSE 'train' END AS action,
        n >= 100 AND (epoch({o.TS}) - epoch(date_trunc('second', newest))) / 3600 >= 24 AS retrain FROM (
        SELECT {o.first_contained('k.error_signature', fv.CATEGORIES, 'general')} AS category, count(*) AS n, max(fb.created_at) AS newest
        FROM kb k JOIN fb ON k.error_hash = fb.solution_hash WHERE was_helpful IS NOT NULL GROUP BY 1)""",
        "fb",
    ),
)

# Trained models: no SQL twin, checked by rows here and by invariants in the tests.


def _clusters(f):
    p = groups(f)
    c = ml.cluster_centres(p)
    return cl.summary(cl.assign(p, c))


register("k1_kmeans", _clusters)


def _tree(f):
    tree = ml.success_tree(groups(f))
    rows = ml.query_points(mq.asked(f).select("query_id", "clean_text", "ts"))
    return ml.tree_prediction(tree, rows).select("query_id", "tree_works", "tree_confidence")


register("k4_decision_tree", _tree)


def _net(f):
    net = ml.success_net(groups(f))
    rows = ml.query_points(mq.asked(f).select("query_id", "clean_text", "ts"))
    return ml.net_prediction(net, rows).select("query_id", "neural_works", "neural_confidence")


register("k5_neural_net", _net)


def _svm(f):
    right = F.when(F.col("label") == F.col("prediction"), F.col("weight")).otherwise(0.0)
    return ml.category_classifier(cut(ml.summed(groups(f), "category"))).groupBy("category").agg(
        F.sum("weight").cast("long").alias("n"), (F.sum(right) / F.sum("weight")).alias("accuracy")
    )


register("k7_category_svm", _svm)
register(
    "k9_split_importance",
    lambda f: f.spark.createDataFrame(ml.split_importance(ml.success_tree(groups(f))), "feature string, splits int, share double"),
)


def _augment(f):
    """Only groups below the minimum are filled up, so only their ratings meet texts one by one; the others keep their size."""
    keys = ["error_hash", "worked"]
    sizes = groups(f).groupBy(*keys).agg(F.sum("weight").alias("n"))
    few = sizes.filter(F.col("n") < fv.MIN_TRAINING_ROWS).select(F.col("error_hash").alias("solution_hash"), F.col("worked").alias("was_helpful"))
    rows = ml.training_points(f.kb_texts, f.feedback.join(few, ["solution_hash", "was_helpful"], "left_semi"))
    filled = cl.augment(rows, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("synthetic"), 1).otherwise(0)).alias("synthetic")
    )
    enough = sizes.filter(F.col("n") >= fv.MIN_TRAINING_ROWS)
    return filled.unionByName(enough.withColumn("synthetic", F.lit(0).cast("long")))


register(
    "k10_augment",
    _augment,
    o.sql(
        """SELECT error_hash, worked, greatest(50, count(*)) AS n, greatest(0, 50 - count(*)) AS synthetic FROM t_points GROUP BY error_hash, worked""",
        "t_points",
    ),
)


def learned(f):
    f.hold("kb_texts")
    solutions = fb.with_stats(f.kb_texts, f.feedback).select("kb_id", "error_text", "steps_text", "success_rate", "created_at")
    return ml.learn(groups(f), solutions)


def plain_queries(f):
    return mq.asked(f).select("query_id", "clean_text", "signature", "error_hash", "ts")


register("m7_model_match", lambda f: ml.model_match(plain_queries(f), learned(f)))
register(
    "m8_model_match_strict",
    lambda f: ml.model_match(plain_queries(f), learned(f), 0.5, "ml_prediction", "ML-1.0"),
)
register(
    "m11_blended_vector_match",
    lambda f: ml.blended_vector_match(mq.with_vectors(f), mq.rated(f), mq.kb_vectors(f), learned(f)),
)
register("m13_cascade_with_models", lambda f: mq.cascaded(f, lambda q, m=learned(f): ml.model_match(q, m)))
register(
    "m20_report_with_models",
    # the report reads the insights several times: the models are asked once
    lambda f: mt.report(mq.answers(f), cut(ml.flat_insights(ml.insights(plain_queries(f), learned(f), se.forecast(hours(f))))), mq.checked(f)),
)
register("m17_insights", lambda f: ml.insights(plain_queries(f), learned(f), se.forecast(hours(f))))

# --- S ---------------------------------------------------------------------------


def events_stream(f):
    schema = f.spark.read.parquet(f"{f.dir}/events.parquet").schema
    return jobs.read_files(f.spark, f.dir, schema, "events.parquet")


def log_stream(f):
    return f.spark.sql(VIEWS["security_raw"], events=events_stream(f))


def feedback_stream(f):
    hashes = f.kb_texts.select("kb_id", F.col("error_hash").alias("solution_hash"), "error_signature")
    return f.spark.sql(VIEWS["feedback_raw"], events=events_stream(f), part=f.part).join(hashes, "kb_id")


register(
    "s1_security_per_hour",
    lambda f: jobs.security_per_hour(log_stream(f)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")),
    o.sql(
        "SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS events FROM security_raw GROUP BY 1, 2",
        "security_raw",
    ),
)
register(
    "s2_solution_stats",
    lambda f: r6(jobs.solution_stats(feedback_stream(f)), "success_rate", "conflict_rate"),
    o.sql(
        "SELECT solution_hash, round(success_rate, 6) AS success_rate, feedback_count, round(conflict_rate, 6) AS conflict_rate FROM stats",
        "stats",
    ),
)
register(
    "s3_user_windows",
    lambda f: jobs.user_windows(log_stream(f)).withColumn("window_end", F.date_format("window_end", "yyyy-MM-dd HH:mm:ss")),
    o.sql(
        f"""SELECT strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, user_id, count(*) AS queries, count(*) < 1000 AS allowed FROM (
        SELECT user_id, date_trunc('hour', created_at) + to_hours(unnest(range(1, 25))::INT) AS window_end FROM security_raw
        WHERE event_type IN ('QUERY', 'SEARCH')) GROUP BY ALL""",
        "security_raw",
    ),
)


def _index(f):
    schema = f.spark.read.parquet(f"{f.dir}/embeddings.parquet").schema
    stream = jobs.read_files(f.spark, f.dir, schema, "embeddings.parquet").withColumn("kb_id", F.col("vec_id").cast("string"))
    return jobs.index_vectors(stream, new_path(f.spark, "index")).drop("embedding")


from faultmatch.queries.scores import bucket_sql  # noqa: E402

register(
    "s4_incremental_index",
    _index,
    "SELECT CAST(vec_id AS STRING) AS kb_id, " + ", ".join(f"{c} AS lsh_hash_{i}" for i, c in enumerate(bucket_sql("embedding"))) + " FROM embeddings",
)
register(
    "s5_category_hours",
    lambda f: jobs.category_hours(feedback_stream(f)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss")),
    o.sql(f"SELECT category, {sql_stamp('hour')}, n FROM hours", "hours"),
)
