"""G, J and W: aggregates, join shapes, rankings."""

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import similarity as sim, text as tx
from faultmatch.operators import candidates as ca, dashboards as db, feedback as fb, ranking as rk, rules, vectors as ve
from faultmatch.queries import oracle as o
from faultmatch.queries.base import register
from faultmatch.queries.scores import bucket_sql, vector_queries
from faultmatch.queries.texts import ALL_TOKENS, _signature_terms
from faultmatch.sources.fixtures import AS_OF


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


WEEK = f"created_at >= {o.TS} - INTERVAL 7 DAYS"
DAY = f"created_at >= {o.TS} - INTERVAL 24 HOURS"
MONTH = f"created_at >= {o.TS} - INTERVAL 30 DAYS"

# --- G ---------------------------------------------------------------------------

register(
    "g1_solution_stats",
    lambda f: r6(fb.solution_stats(f.feedback), "success_rate", "conflict_rate"),
    o.sql("SELECT solution_hash, round(success_rate, 6) AS success_rate, feedback_count, round(conflict_rate, 6) AS conflict_rate FROM stats", "stats"),
)
register(
    "g2_confidence",
    lambda f: r6(fb.recalculated_confidence(f.feedback), "confidence").select("solution_hash", "confidence"),
    o.sql(f"SELECT solution_hash, round({o.confidence('success_rate', 'feedback_count', 'conflict_rate')}, 6) AS confidence FROM stats", "stats"),
)
register(
    "g3_proven_rates",
    lambda f: r6(fb.proven_rates(f.feedback), "success_rate"),
    o.sql("SELECT solution_hash, round(success_rate, 6) AS success_rate, feedback_count FROM stats WHERE feedback_count >= 3", "stats"),
)
o.define(
    "conflicts",
    f"""SELECT t.teach_id, sum({o.HELPFUL}) AS helpful_ratings, count(*) AS ratings FROM taught t
    JOIN kb k ON k.error_hash = t.error_hash OR k.error_signature = t.error_signature
    JOIN fb ON fb.solution_hash = k.error_hash GROUP BY t.teach_id""",
    ["taught", "fb"],
)
register(
    "g4_conflict_check",
    lambda f: r6(fb.conflict_check(fb.taught(f.teachings), f.kb_texts, f.feedback), "existing_success_rate").select(
        "teach_id", "existing_success_rate", "has_conflicts"
    ),
    o.sql(
        """SELECT t.teach_id, round(coalesce(helpful_ratings / ratings, 0.5), 6) AS existing_success_rate,
        coalesce(helpful_ratings / ratings < 0.6, false) AS has_conflicts FROM taught t LEFT JOIN conflicts USING (teach_id)""",
        "taught", "conflicts",
    ),
)
register(
    "g5_accuracy_by_band",
    lambda f: r6(db.accuracy_by_band(f.feedback), "success_rate"),
    o.sql(
        f"""SELECT CASE WHEN confidence_rating >= 4 THEN 'High Confidence' WHEN confidence_rating >= 3 THEN 'Medium Confidence'
        ELSE 'Low Confidence' END AS confidence_level, round(avg({o.HELPFUL}), 6) AS success_rate, count(*) AS sample_size
        FROM fb WHERE confidence_rating IS NOT NULL GROUP BY 1""",
        "fb",
    ),
)
register(
    "g6_methods",
    lambda f: r6(db.methods(f.feedback, AS_OF), "success_rate"),
    o.sql(
        f"""SELECT solution_source, {o.label_of('solution_source', fv.METHOD_NAMES)} AS method,
        round(avg({o.HELPFUL}), 6) AS success_rate, count(*) AS uses FROM fb WHERE {WEEK} GROUP BY solution_source""",
        "fb",
    ),
)
register(
    "g7_top_category",
    lambda f: db.top_category(f.kb_texts),
    o.sql(
        f"""SELECT (SELECT count(*) FROM kb) AS total_solutions, category, n FROM (
        SELECT {o.first_contained('error_signature', fv.DASHBOARD_CATEGORIES, 'Other')} AS category, count(*) AS n
        FROM kb GROUP BY 1 ORDER BY n DESC, category DESC LIMIT 1)""",
        "kb",
    ),
)
SUMMARY = f"""SELECT count(*) AS total_feedback, avg({o.HELPFUL}) AS success_rate,
  count(DISTINCT CASE WHEN was_helpful = false THEN solution_hash END) AS conflicts FROM fb WHERE {MONTH}"""
register(
    "g8_feedback_summary",
    lambda f: r6(db.feedback_summary(f.feedback, AS_OF), "success_rate"),
    o.sql(f"SELECT total_feedback, round(success_rate, 6) AS success_rate, conflicts FROM ({SUMMARY})", "fb"),
)
register(
    "g9_active_sessions",
    lambda f: db.active_sessions(f.feedback, AS_OF),
    o.sql(f"SELECT count(DISTINCT session_id) AS sessions FROM fb WHERE {DAY}", "fb"),
)
register(
    "g13_source_use",
    lambda f: r6(db.source_use(f.feedback, AS_OF), "success_rate"),
    o.sql(
        f"""SELECT count(*) FILTER (solution_source = 'exact_match') AS uses,
        round(coalesce(avg({o.HELPFUL}) FILTER (solution_source = 'exact_match'), 0), 6) AS success_rate, count(*) AS total
        FROM fb WHERE {WEEK}""",
        "fb",
    ),
)
register(
    "g14_quality",
    lambda f: r6(db.quality(f.feedback), "rate"),
    o.sql(
        """SELECT solutions, entries, helpful, round(helpful / entries, 6) AS rate, CASE WHEN helpful / entries >= 0.8 THEN 'High'
        WHEN helpful / entries >= 0.6 THEN 'Medium' WHEN helpful / entries >= 0.4 THEN 'Low' ELSE 'Poor' END AS quality FROM (
        SELECT count(DISTINCT solution_hash) AS solutions, count(*) AS entries, count(*) FILTER (was_helpful) AS helpful FROM fb)""",
        "fb",
    ),
)
register(
    "g15_health",
    lambda f: db.health(f.feedback, f.security_log, AS_OF),
    o.sql(
        f"""SELECT rate, conflicts, events, CASE WHEN rate >= 0.8 AND events <= 2 AND conflicts <= 3 THEN 'Healthy'
        WHEN rate >= 0.6 AND events <= 10 AND conflicts <= 10 THEN 'Caution' ELSE 'Needs Attention' END AS status FROM (
        SELECT round(success_rate * 100) / 100 AS rate, conflicts, (SELECT count(*) FROM security_raw WHERE {DAY}) AS events
        FROM ({SUMMARY}))""",
        "fb", "security_raw",
    ),
)
register(
    "g16_week_performance",
    lambda f: r6(db.week_performance(f.feedback, AS_OF), "accuracy"),
    o.sql(
        f"""SELECT count(*) AS total_predictions, round(avg({o.HELPFUL}), 6) AS accuracy,
        sum(CASE WHEN was_helpful THEN 1 ELSE 0 END) AS successful_predictions FROM fb WHERE {WEEK}""",
        "fb",
    ),
)
register(
    "g17_by_kb_source",
    lambda f: r6(db.by_kb_source(f.feedback, f.kb_texts, AS_OF), "success_rate"),
    o.sql(
        f"""SELECT coalesce(k.solution_source, 'Unknown') AS source, round(avg({o.HELPFUL}), 6) AS success_rate, count(*) AS samples
        FROM fb LEFT JOIN kb k ON fb.solution_hash = k.error_hash WHERE fb.{WEEK} GROUP BY 1""",
        "fb",
    ),
)
register(
    "g18_by_length_band",
    lambda f: r6(db.by_length_band(f.feedback, f.kb_texts), "success_rate"),
    o.sql(
        f"""SELECT CASE WHEN length(error_text) > 200 THEN 'Long Errors' WHEN length(error_text) < 50 THEN 'Short Errors'
        ELSE 'Medium Errors' END AS band, round(avg({o.HELPFUL}), 6) AS success_rate, count(*) AS samples
        FROM kb k JOIN fb ON fb.solution_hash = k.error_hash GROUP BY 1""",
        "fb",
    ),
)
register(
    "g19_best_hours",
    lambda f: r6(db.best_hours(f.feedback, AS_OF), "success_rate"),
    o.sql(
        f"""SELECT hour(created_at) AS hour, round(avg({o.HELPFUL}), 6) AS success_rate, count(*) AS feedback_count
        FROM fb WHERE {WEEK} GROUP BY 1 HAVING count(*) >= 2 ORDER BY avg({o.HELPFUL}) DESC, hour LIMIT 3""",
        "fb",
    ),
)
register(
    "g20_cluster_report",
    lambda f: r6(db.cluster_report(f.feedback, f.kb_texts, AS_OF), "avg_success_rate"),
    o.sql(
        f"""SELECT {o.first_contained('error_signature', fv.CLUSTER_LABELS, 'Other')} AS label, count(*) AS error_count,
        round(avg(success_rate), 6) AS avg_success_rate FROM kbs WHERE {MONTH} GROUP BY 1""",
        "kbs",
    ),
)
register(
    "g26_totals",
    lambda f: f.feedback.agg(F.count("*").alias("n")).withColumn("what", F.lit("feedback")).unionByName(
        f.kb_raw.agg(F.count("*").alias("n")).withColumn("what", F.lit("kb"))
    ),
    o.sql("SELECT 'feedback' AS what, count(*) AS n FROM fb UNION ALL SELECT 'kb', count(*) FROM kb_raw", "fb", "kb_raw"),
)

# --- J ---------------------------------------------------------------------------

register(
    "j1_kb_with_stats",
    lambda f: r6(fb.with_stats(f.kb_texts, f.feedback), "success_rate").select("kb_id", "success_rate", "feedback_count", "has_conflicts"),
    o.sql("SELECT kb_id, round(success_rate, 6) AS success_rate, feedback_count, has_conflicts FROM kbs", "kbs"),
)


def _inner(f):
    s = fb.solution_stats(f.feedback.filter(F.col("was_helpful").isNotNull()))
    return r6(
        f.kb_texts.join(s, F.col("error_hash") == F.col("solution_hash")), "success_rate"
    ).select("kb_id", "success_rate", "feedback_count")


register(
    "j2_kb_inner_feedback",
    _inner,
    o.sql(
        f"""SELECT k.kb_id, round(avg({o.HELPFUL}), 6) AS success_rate, count(*) AS feedback_count
        FROM kb k JOIN fb ON k.error_hash = fb.solution_hash WHERE was_helpful IS NOT NULL GROUP BY k.kb_id""",
        "fb",
    ),
)
register(
    "j3_feedback_left_kb",
    lambda f: f.feedback.join(
        f.kb_texts.groupBy("error_hash").agg(F.max("solution_source").alias("kb_source")),
        F.col("solution_hash") == F.col("error_hash"), "left",
    ).select("feedback_id", F.coalesce("kb_source", F.lit("Unknown")).alias("source")),
    o.sql(
        """SELECT feedback_id, coalesce(max(k.solution_source), 'Unknown') AS source FROM fb
        LEFT JOIN kb k ON fb.solution_hash = k.error_hash GROUP BY feedback_id""",
        "fb",
    ),
)
# Vectors of the lower half of the labels are already indexed.
o.define("indexed", "SELECT CAST(vec_id AS STRING) AS kb_id FROM embeddings WHERE label < 5", [])


def indexed(f):
    return f.embeddings.filter(F.col("label") < 5).select(F.col("vec_id").cast("string").alias("kb_id"))


register(
    "j4_without_index",
    lambda f: f.kb.filter(F.col("embedding").isNotNull()).join(indexed(f), "kb_id", "left_anti").select("kb_id"),
    o.sql("SELECT kb_id FROM kbv WHERE embedding IS NOT NULL AND kb_id NOT IN (SELECT kb_id FROM indexed)", "kbv", "indexed"),
)
_b = bucket_sql("embedding")
o.define("kb_slots", f"SELECT kb_id, error_hash, confidence_score, {_b[0]} AS b0, {_b[1]} AS b1, {_b[2]} AS b2, embedding FROM kbv WHERE embedding IS NOT NULL", ["kbv"])
o.define("q_slots", f"SELECT CAST(vec_id AS STRING) AS query_id, {_b[0]} AS b0, {_b[1]} AS b1, {_b[2]} AS b2, embedding FROM embeddings", [])
o.define(
    "bucket_ranked",
    """SELECT q.query_id, k.kb_id, k.error_hash, k.confidence_score, q.embedding AS qv, k.embedding AS kv,
    row_number() OVER (PARTITION BY q.query_id ORDER BY k.confidence_score DESC NULLS LAST, k.error_hash, k.kb_id) AS rank
    FROM q_slots q JOIN kb_slots k ON q.b0 = k.b0 OR q.b1 = k.b1 OR q.b2 = k.b2""",
    ["q_slots", "kb_slots"],
)
register(
    "j5_bucket_candidates",
    lambda f: ve.bucket_candidates(vector_queries(f), f.kb).select("query_id", "kb_id", "rank"),
    o.sql("SELECT query_id, kb_id, rank FROM bucket_ranked", "bucket_ranked"),
)
register(
    "j6_regex_join",
    lambda f: rules.pattern_hits(
        f.kb_texts.select(F.col("error_signature").alias("signature")), f.patterns
    ).groupBy("pattern_id").agg(F.count("*").alias("signatures")),
    o.sql(
        """SELECT pattern_id, count(DISTINCT error_signature) AS signatures FROM kb JOIN patterns
        ON regexp_matches(error_signature, pattern_regex) GROUP BY pattern_id""",
        "kb", "patterns",
    ),
)
register(
    "j7_substring_join",
    lambda f: ca.token_frequency(
        _signature_terms(f).select(F.explode("tokens").alias("token")).distinct(), f.kb_texts, ["error_signature", "error_text"]
    ),
    o.sql(
        """SELECT token, count(*) AS n_rows FROM (SELECT DISTINCT unnest(toks) AS token FROM terms) JOIN kb
        ON contains(lower(error_signature), token) OR contains(lower(error_text), token) GROUP BY token""",
        "terms", "kb",
    ),
)
register(
    "j8_conflict_lookup",
    lambda f: fb.conflict_lookup(fb.taught(f.teachings), f.kb_texts, f.feedback).select("teach_id", "helpful_ratings", "ratings"),
    o.sql("SELECT teach_id, helpful_ratings, ratings FROM conflicts", "conflicts"),
)
register(
    "j9_fingerprint_join",
    lambda f: f.queries.select("query_id", "error_hash")
    .join(f.kb_texts.groupBy("error_hash").agg(F.count("*").alias("kb_rows"), F.max("created_at").alias("newest")), "error_hash")
    .select("query_id", "kb_rows", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest")),
    o.sql(
        """SELECT query_id, count(*) AS kb_rows, strftime(max(k.created_at), '%Y-%m-%d %H:%M:%S') AS newest
        FROM inc i JOIN kb k ON i.error_hash = k.error_hash GROUP BY query_id""",
        "inc", "kb",
    ),
)

# --- W ---------------------------------------------------------------------------


def categorized(f):
    return fb.with_stats(f.kb_texts, f.feedback).withColumn("category", tx.kb_category("error_signature"))


KB_CATEGORY = o.first_contained("error_signature", fv.DASHBOARD_CATEGORIES, "Other")
BY_RATE = "raw_rate DESC NULLS LAST, created_at DESC, error_hash, kb_id"
register(
    "w1_top_per_key",
    lambda f: rk.top_k(categorized(f), ["category"], ca.by_rate(), 20, "rank").select("category", "kb_id", "rank"),
    o.sql(
        f"""SELECT category, kb_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {BY_RATE}) AS rank
        FROM (SELECT *, {KB_CATEGORY} AS category FROM kbs)) WHERE rank <= 20""",
        "kbs",
    ),
)
register(
    "w2_page",
    lambda f: rk.page(categorized(f), ["category"], ca.by_newest(), fv.VECTOR_PAGE, 1).select("category", "kb_id"),
    o.sql(
        f"""SELECT category, kb_id FROM (SELECT *, row_number() OVER (PARTITION BY category
        ORDER BY created_at DESC, error_hash, kb_id) AS rank FROM (SELECT *, {KB_CATEGORY} AS category FROM kbs))
        WHERE rank > 100 AND rank <= 200""",
        "kbs",
    ),
)


def _first(f):
    order = [F.col("confidence_score").desc(), F.col("success_rate").desc(), F.col("feedback_count").desc(), F.col("kb_id")]
    rows = categorized(f).filter(F.size("resolution_steps") > 0).withColumn("success_rate", F.round("success_rate", 9))
    return rk.top_k(rows, ["category"], order, 1).select("category", "kb_id")


register(
    "w3_first_by_keys",
    _first,
    o.sql(
        f"""SELECT category, kb_id FROM (SELECT *, row_number() OVER (PARTITION BY category
        ORDER BY confidence_score DESC, round(success_rate, 9) DESC, feedback_count DESC, kb_id) AS rank
        FROM (SELECT *, {KB_CATEGORY} AS category FROM kbs) WHERE len(resolution_steps) > 0) WHERE rank = 1""",
        "kbs",
    ),
)
register(
    "w4_recent_activity",
    lambda f: db.recent_activity(f.feedback, f.security_log, AS_OF),
    o.sql(
        f"""SELECT kind, id, line FROM (SELECT 'feedback' AS kind, feedback_id AS id, strftime(created_at, '%H:%M') || ' - ' ||
        CASE WHEN was_helpful THEN 'helpful' ELSE 'not helpful' END || ' ' || solution_source || ' - ' ||
        CASE WHEN length(error_signature) > 50 THEN substring(error_signature, 1, 50) || '...' ELSE error_signature END AS line
        FROM fb WHERE {DAY} ORDER BY created_at DESC, feedback_id LIMIT 10)
        UNION ALL SELECT kind, id, line FROM (SELECT 'security' AS kind, event_id AS id, strftime(created_at, '%H:%M') || ' - ' || severity || ' ' || event_type AS line
        FROM sec WHERE {DAY} ORDER BY created_at DESC, event_id LIMIT 5)""",
        "fb", "sec",
    ),
)
register(
    "w5_global_top",
    lambda f: f.kb_texts.groupBy(tx.kb_category("error_signature").alias("category")).agg(F.count("*").alias("n"))
    .orderBy(F.col("n").desc(), "category").limit(3),
    o.sql(f"SELECT {KB_CATEGORY} AS category, count(*) AS n FROM kb GROUP BY 1 ORDER BY n DESC, category LIMIT 3", "kb"),
)


def _sets(f):
    from faultmatch.queries.scores import pairs

    both = pairs(f).withColumn("both", sim.ngram_overlap("signature", "error_signature"))
    return both.select("pair_id", "both.shared", "both.joint")


register(
    "w6_gram_sets",
    _sets,
    o.sql(
        f"""SELECT pair_id, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS joint FROM (
        SELECT pair_id, {o.grams('signature')} AS a, {o.grams('error_signature')} AS b FROM pairs)""",
        "pairs",
    ),
)
register(
    "w7_distinct",
    lambda f: f.kb_texts.select(F.lit("signature").alias("kind"), F.col("error_signature").alias("value")).distinct()
    .unionByName(f.queries.select(F.lit("token").alias("kind"), F.explode(tx.tokens("signature")).alias("value")).distinct())
    .unionByName(f.kb_texts.select(F.lit("step").alias("kind"), F.explode("resolution_steps").alias("value")).distinct()),
    o.sql(
        """SELECT DISTINCT 'signature' AS kind, error_signature AS value FROM kb
        UNION ALL SELECT DISTINCT 'token', unnest(toks) FROM terms
        UNION ALL SELECT DISTINCT 'step', unnest(resolution_steps) FROM kb""",
        "kb", "terms",
    ),
)
