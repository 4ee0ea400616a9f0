"""A, T and R: table maintenance, cache, series, trees."""

import os

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import similarity as sim, text as tx
from faultmatch.operators import cache as ch, feedback as fb, knowledge as kn, series as se, trees as tr, vectors as ve
from faultmatch.queries import oracle as o
from faultmatch.queries.base import register
from faultmatch.queries.scores import bucket_sql
from faultmatch.queries.reports import indexed, r6
from faultmatch.session import new_path
from faultmatch.sources import tables
from faultmatch.sources.fixtures import AS_OF, results_of

SEC = "yyyy-MM-dd HH:mm:ss"


def stamp(c):
    return F.date_format(c, SEC).alias(c)


def sql_stamp(c, name=None):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c}"


# --- A ---------------------------------------------------------------------------

register(
    "a1_kb_scan",
    lambda f: tables.kb_scan(f.kb_texts).withColumn("created_at", F.date_format("created_at", SEC)),
    o.sql(f"SELECT kb_id, error_hash, error_signature, error_text, {sql_stamp('created_at')} FROM kb WHERE error_text IS NOT NULL", "kb"),
)


def _init(f):
    """Fresh tables take the derived feedback and audit rows; the result counts what each holds."""
    base = new_path(f.spark, "tables")
    tables.init_tables(f.spark, base)
    tables.append(tables.feedback_rows(f.feedback), base, "feedback")
    tables.append(f.security_log, base, "security_log")
    out = None
    for name in tables.TABLES:
        n = tables.read_table(f.spark, base, name).agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        out = n if out is None else out.unionByName(n)
    return out


register(
    "a2_init_tables",
    _init,
    o.sql(
        "SELECT name, CASE name WHEN 'feedback' THEN (SELECT count(*) FROM fb) WHEN 'security_log' THEN (SELECT count(*) FROM sec) ELSE 0 END AS n FROM (SELECT unnest("
        + o.words(tables.TABLES) + ") AS name)",
        "fb", "sec",
    ),
)
register(
    "a3_feedback_rows",
    lambda f: tables.feedback_rows(f.feedback).withColumn("created_at", F.date_format("created_at", SEC)),
    o.sql(
        f"""SELECT feedback_id, session_id, solution_hash, solution_source, '1.0' AS solution_version, was_helpful, confidence_rating,
        CAST(NULL AS STRING) AS user_comment, 'intermediate' AS user_expertise, {sql_stamp('created_at')}, error_signature,
        0 AS resolution_time_minutes, 'unknown' AS environment_context FROM fb""",
        "fb",
    ),
)
o.define(
    "new_steps",
    """SELECT error_hash, list(step ORDER BY ts, teach_id, pos) AS new_steps FROM (
    SELECT error_hash, step, ts, teach_id, pos, row_number() OVER (PARTITION BY error_hash, step ORDER BY ts, teach_id, pos) AS rn
    FROM (SELECT error_hash, ts, teach_id, unnest(range(0, len(steps))) AS pos, unnest(steps) AS step FROM taught)) WHERE rn = 1 GROUP BY error_hash""",
    ["taught"],
)
OLD_STEPS = "coalesce(array_to_string(k.resolution_steps, '|'), '')"


def _taught_table(f):
    """The knowledge base after a batch, written to its table and read back in all columns."""
    base = new_path(f.spark, "kb")
    tables.append(kn.teach(f.kb_table, fb.taught(f.teachings)), base, "kb")
    rows = tables.read_table(f.spark, base, "kb")
    return rows.select(
        "kb_id", "error_hash", "error_signature", "error_text", F.array_join("resolution_steps", "|").alias("steps"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("embedding_sum"), "confidence_score",
        "solution_source", stamp("created_at"), "source", "notes",
    )


register(
    "a5_teach",
    _taught_table,
    o.sql(
        f"""SELECT k.kb_id, k.error_hash, k.error_signature, k.error_text, CASE WHEN n.error_hash IS NULL THEN {OLD_STEPS}
        ELSE array_to_string({o.ordered_distinct('list_concat(k.resolution_steps, n.new_steps)')}, '|') END AS steps,
        round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS embedding_sum, confidence_score, solution_source,
        {sql_stamp('created_at')}, 'seed' AS source,
        CASE WHEN n.error_hash IS NOT NULL THEN 'Updated with enhanced teaching' WHEN CAST(kb_id AS BIGINT) % 2 = 0 THEN 'note ' || kb_id END AS notes
        FROM kbv k LEFT JOIN new_steps n USING (error_hash)
        UNION ALL SELECT 't' || teach_id, error_hash, error_signature, raw_text, array_to_string(new_steps, '|'), NULL, NULL, NULL,
        strftime(ts, '%Y-%m-%d %H:%M:%S'), 'human_enhanced',
        'Enhanced teaching with conflict detection' FROM (SELECT t.*, n.new_steps, row_number() OVER (PARTITION BY t.error_hash ORDER BY ts, teach_id) AS rn
          FROM taught t JOIN new_steps n USING (error_hash) WHERE t.error_hash NOT IN (SELECT error_hash FROM kb)) WHERE rn = 1""",
        "kbv", "new_steps", "taught",
    ),
)


def versions(f):
    return kn.version_rows(fb.conflict_check(fb.taught(f.teachings), f.kb_texts, f.feedback), f.kb_texts)


def _version_table(f):
    """The history rows written to their table and read back."""
    base = new_path(f.spark, "kb_versions")
    tables.append(versions(f), base, "kb_versions")
    rows = tables.read_table(f.spark, base, "kb_versions")
    return rows.withColumns({"resolution_steps": F.array_join("resolution_steps", "\n"), "created_at": F.date_format("created_at", SEC)})


o.define(
    "versions",
    """SELECT 'v' || t.teach_id AS version_id, coalesce(k.kb_id, 't' || first_value(t.teach_id) OVER (PARTITION BY t.error_hash ORDER BY t.ts, t.teach_id)) AS kb_entry_id,
    t.error_hash, array_to_string(t.steps, chr(10)) AS resolution_steps, t.ts AS created_at, t.author AS created_by,
    CASE WHEN coalesce(helpful_ratings / ratings < 0.6, false) THEN 'alternative' ELSE 'create' END AS change_type,
    CAST(NULL AS STRING) AS parent_version, 0.8::DOUBLE AS confidence_score, 0 AS feedback_count, true AS is_active
    FROM taught t LEFT JOIN conflicts c USING (teach_id)
    LEFT JOIN (SELECT error_hash, arg_min(kb_id, (created_at, kb_id)) AS kb_id FROM kb GROUP BY error_hash) k ON k.error_hash = t.error_hash""",
    ["taught", "conflicts", "kb"],
)
register(
    "a6_version_rows",
    _version_table,
    o.sql(f"SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM versions", "versions"),
)
register(
    "a7_version_timeline",
    lambda f: kn.version_timeline(versions(f)).drop("created_at"),
    o.sql(
        """SELECT error_hash, version_id, row_number() OVER w AS ordinal, lag(version_id) OVER w AS previous_version,
        lead(version_id) OVER w IS NULL AS is_latest FROM versions WHERE is_active
        WINDOW w AS (PARTITION BY error_hash ORDER BY created_at, version_id)""",
        "versions",
    ),
)
register(
    "a8_index_backlog",
    lambda f: ve.index_backlog(f.kb, indexed(f)).select("kb_id", "error_hash"),
    o.sql(
        """SELECT kb_id, error_hash FROM kbv WHERE embedding IS NOT NULL AND kb_id NOT IN (SELECT kb_id FROM indexed)""",
        "kbv", "indexed",
    ),
)


def _index_table(f):
    """The index rows written to their table and read back."""
    base = new_path(f.spark, "vector_index")
    tables.append(ve.index_rows(f.kb.select("kb_id", "error_hash", "embedding"), F.expr(f"TIMESTAMP '{AS_OF}'")), base, "vector_index")
    rows = tables.read_table(f.spark, base, "vector_index")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("vector_sum", F.round(total, 4)).withColumn("created_at", F.date_format("created_at", SEC)).drop("vector")


_b = bucket_sql("embedding")
register(
    "a9_index_rows",
    _index_table,
    o.sql(
        f"""SELECT kb_id AS index_id, error_hash, {_b[0]} AS lsh_hash_0, {_b[1]} AS lsh_hash_1, {_b[2]} AS lsh_hash_2,
        '{AS_OF}' AS created_at, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS vector_sum
        FROM kbv WHERE embedding IS NOT NULL""",
        "kbv",
    ),
)
LIVE = f"created_at > {o.TS} - INTERVAL 24 HOURS"


def shown_results(c="results"):
    return F.array_join(F.transform(c, lambda r: F.concat(r["error_hash"], F.lit("="), r["similarity"].cast("string"))), ",").alias("results")


def sql_results(h):
    return f"('a' || {h} || '=0.9,b' || {h} || '=0.8')"


register(
    "a10_cache_lookup",
    lambda f: ch.lookup(f.lookups.select("lookup_id", "cache_key"), f.result_cache, AS_OF).withColumn("results", shown_results()),
    o.sql(
        f"""SELECT lookup_id, l.cache_key, c.query_hash, {sql_results('c.query_hash')} AS results, c.query_hash IS NOT NULL AS is_hit FROM lookups l
        LEFT JOIN (SELECT * FROM cache WHERE {LIVE}) c USING (cache_key)""",
        "lookups", "cache",
    ),
)
register(
    "a10_cache_misses",
    lambda f: ch.misses(f.lookups.select("lookup_id", "cache_key"), f.result_cache, AS_OF),
    o.sql(
        f"SELECT lookup_id, cache_key FROM lookups WHERE cache_key NOT IN (SELECT cache_key FROM cache WHERE {LIVE})",
        "lookups", "cache",
    ),
)


def stored(f, df):
    """A cache written to its table and read back."""
    base = new_path(f.spark, "vector_cache")
    tables.append(df, base, "vector_cache")
    rows = tables.read_table(f.spark, base, "vector_cache")
    return rows.select("cache_key", "query_hash", shown_results(), stamp("created_at"), "hit_count", stamp("last_accessed"))


MERGED = """SELECT coalesce(c.cache_key, n.cache_key) AS cache_key, coalesce(c.query_hash, n.query_hash) AS query_hash,
  coalesce(n.query_hash, c.query_hash) AS result_hash, CASE WHEN n.cache_key IS NULL THEN c.created_at ELSE {ts} END AS created_at,
  coalesce(c.hit_count, 0) + CASE WHEN n.cache_key IS NULL THEN 0 ELSE 1 END AS hit_count, coalesce(c.last_accessed, {ts}) AS last_accessed
  FROM cache c FULL JOIN {new} n ON c.cache_key = n.cache_key"""
MERGED_COLS = f"cache_key, query_hash, {sql_results('result_hash')} AS results, {sql_stamp('created_at')}, hit_count, {sql_stamp('last_accessed')}"
register(
    "a11_cache_merge",
    lambda f: stored(f, ch.merge(f.result_cache, f.found_results, AS_OF)),
    o.sql(f"SELECT {MERGED_COLS} FROM ({MERGED.format(ts=o.TS, new='new_results')})", "cache", "new_results"),
)
register(
    "a12_cache_hits",
    lambda f: stored(f, ch.apply_hits(f.result_cache, f.lookups)),
    o.sql(
        f"""SELECT cache_key, query_hash, {sql_results('query_hash')} AS results, {sql_stamp('created_at')}, hit_count + coalesce(n, 0) AS hit_count,
        {sql_stamp('coalesce(latest, last_accessed)', 'last_accessed')} FROM cache
        LEFT JOIN (SELECT cache_key, count(*) AS n, max(ts) AS latest FROM lookups GROUP BY cache_key) USING (cache_key)""",
        "cache", "lookups",
    ),
)


def searched(f):
    """The cached search over all lookups; a miss finds results named after its key."""

    def find(keys):
        name = F.concat(F.lit("s"), F.col("cache_key"))
        return keys.withColumn("query_hash", name).withColumn("results", results_of(name))

    return ch.search(f.lookups.select("lookup_id", "cache_key"), f.result_cache, find, AS_OF)


o.define("searched", f"SELECT DISTINCT cache_key, 's' || cache_key AS query_hash FROM lookups WHERE cache_key NOT IN (SELECT cache_key FROM cache WHERE {LIVE})", ["lookups", "cache"])
register(
    "a10_cached_search",
    lambda f: searched(f)[0].withColumn("results", shown_results()),
    o.sql(
        f"""SELECT lookup_id, l.cache_key, {sql_results('coalesce(s.query_hash, c.query_hash)')} AS results, s.query_hash IS NULL AS is_hit
        FROM lookups l LEFT JOIN searched s USING (cache_key) LEFT JOIN cache c USING (cache_key)""",
        "lookups", "searched", "cache",
    ),
)
register(
    "a11_search_store",
    lambda f: stored(f, searched(f)[1]),
    o.sql(f"SELECT {MERGED_COLS} FROM ({MERGED.format(ts=o.TS, new='searched')})", "cache", "searched"),
)
register(
    "a14_training_rows",
    lambda f: kn.training_rows(f.kb_texts, f.feedback).select("kb_id", "feedback_id", "was_helpful"),
    o.sql(
        """SELECT kb_id, feedback_id, was_helpful FROM kb JOIN (SELECT feedback_id, solution_hash, was_helpful, created_at AS rated_at FROM fb)
        ON error_hash = solution_hash WHERE was_helpful IS NOT NULL ORDER BY rated_at DESC, feedback_id, kb_id LIMIT 1000""",
        "fb",
    ),
)


def _paths(f):
    """Walks appended to the path table and read back."""
    base = new_path(f.spark, "paths")
    rows = tables.path_rows(f.tree_steps, F.expr(f"TIMESTAMP '{AS_OF}'"))
    tables.append(rows, base, "tree_paths")
    table = tables.read_table(f.spark, base, "tree_paths")
    walk = F.array_join(F.transform("path", lambda p: F.concat(p["node_id"], F.when(p["decision"], "+").otherwise("-"))), ",")
    return table.select(
        "path_id", walk.alias("walk"), "was_successful", "nodes_visited", "session_id", "error_hash", "duration_seconds", "created_by"
    )


register(
    "a15_tree_paths",
    _paths,
    o.sql(
        """SELECT CAST(path_id AS STRING) AS path_id, string_agg(node_id || CASE WHEN decision THEN '+' ELSE '-' END, ',' ORDER BY step_no) AS walk,
        bool_and(was_successful) AS was_successful, count(*) AS nodes_visited, min(session_id) AS session_id, min(error_hash) AS error_hash,
        CAST(sum(seconds) AS INT) AS duration_seconds, min(created_by) AS created_by FROM tree_steps GROUP BY path_id""",
        "tree_steps",
    ),
)

# --- T ---------------------------------------------------------------------------


def hours(f):
    return se.hourly_counts(f.feedback, tx.categorize("error_signature"))


o.define(
    "hours",
    f"""SELECT {o.first_contained('error_signature', fv.CATEGORIES, 'general')} AS category, date_trunc('hour', created_at) AS hour,
    count(*) AS n FROM fb GROUP BY 1, 2""",
    ["fb"],
)
o.define(
    "positions",
    """SELECT *, row_number() OVER (PARTITION BY category ORDER BY hour) - 1 AS i,
    lag(n, 24) OVER (PARTITION BY category ORDER BY hour) AS lagged, count(*) OVER (PARTITION BY category) AS points FROM hours""",
    ["hours"],
)
o.define(
    "trends",
    """SELECT category, max(points) AS points, CASE WHEN max(points) > 10 THEN regr_slope(n, i) ELSE 0 END AS trend,
    coalesce(avg(n * lagged), 0) AS seasonality, avg(n) FILTER (i >= points - 5) AS last_mean FROM positions GROUP BY category""",
    ["positions"],
)
o.define(
    "smooth",
    """SELECT a.category, a.hour, a.i, a.n, a.points, sum(b.n * CASE WHEN b.i = 0 THEN pow(0.7::DOUBLE, a.i) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, a.i - b.i) END) AS smoothed
    FROM positions a JOIN positions b ON a.category = b.category AND b.i <= a.i GROUP BY ALL""",
    ["positions"],
)
register(
    "t1_hourly_counts",
    lambda f: hours(f).withColumn("hour", F.date_format("hour", SEC)),
    o.sql(f"SELECT category, {sql_stamp('hour')}, n FROM hours", "hours"),
)
register(
    "t2_trend",
    lambda f: r6(se.trend(hours(f)), "trend"),
    o.sql("SELECT category, points, round(trend, 6) AS trend FROM trends", "trends"),
)
register(
    "t3_seasonality",
    lambda f: r6(se.seasonality(hours(f)), "seasonality"),
    o.sql("SELECT category, round(seasonality, 6) AS seasonality FROM trends", "trends"),
)
register(
    "t4_next_value",
    lambda f: r6(se.next_value(hours(f)), "predicted"),
    o.sql("SELECT category, round(last_mean + trend, 6) AS predicted FROM trends WHERE points > 10", "trends"),
)
register(
    "t5_smoothed",
    lambda f: r6(se.smoothed(hours(f)), "smoothed").withColumn("hour", F.date_format("hour", SEC)),
    o.sql(f"SELECT category, {sql_stamp('hour')}, n, round(smoothed, 6) AS smoothed FROM smooth", "smooth"),
)
FORECAST = """SELECT category, CASE WHEN points >= 10 THEN greatest(0.0::DOUBLE, (level + trend * {h}) * CASE WHEN points > 10 AND seasonality > 0.1
  THEN 1 + seasonality * sin(2 * pi() * ({h} % 24) / 24) ELSE 1.0 END) ELSE 0.0 END AS predicted,
  CASE WHEN points >= 10 THEN greatest(0.0::DOUBLE, 1 - error / mean) ELSE 0.0 END AS confidence
  FROM trends JOIN (SELECT category, max_by(smoothed, i) AS level, avg(abs(n - smoothed)) AS error, avg(n) AS mean FROM smooth GROUP BY category) USING (category)"""
for ahead in (1, 6):
    register(
        f"t6_forecast_{ahead}h",
        lambda f, h=ahead: r6(se.forecast(hours(f), h), "predicted").select("category", "predicted"),
        o.sql(f"SELECT category, round(predicted, 6) AS predicted FROM ({FORECAST.format(h=ahead)})", "trends", "smooth"),
    )
register(
    "t7_forecast_confidence",
    lambda f: r6(se.forecast(hours(f)), "confidence").select("category", "confidence", (F.col("confidence") > 0.7).alias("shown")),
    o.sql(
        f"SELECT category, round(confidence, 6) AS confidence, round(confidence, 6) > 0.7 AS shown FROM ({FORECAST.format(h=1)})",
        "trends", "smooth",
    ),
)


def running(f):
    return se.running_success(
        f.tree_steps, "node_id", [F.col("path_id"), F.col("step_no")], F.floor(F.col("path_id") / 1024), F.col("was_successful")
    )


RUNNING = """SELECT path_id, step_no, node_id, row_number() OVER w AS times_used,
  avg(CASE WHEN was_successful THEN 1.0::DOUBLE ELSE 0.0 END) OVER w AS success_rate FROM tree_steps
  WINDOW w AS (PARTITION BY node_id ORDER BY path_id, step_no)"""
register(
    "t8_running_success",
    lambda f: r6(running(f), "success_rate").select("path_id", "step_no", "node_id", "times_used", "success_rate"),
    o.sql(f"SELECT * REPLACE (round(success_rate, 6) AS success_rate) FROM ({RUNNING})", "tree_steps"),
)
register(
    "g25_node_stats",
    lambda f: r6(
        running(f).groupBy("node_id").agg(
            F.max("times_used").alias("times_used"), F.max_by("success_rate", "times_used").alias("success_rate")
        ), "success_rate",
    ),
    o.sql(
        f"SELECT node_id, max(times_used) AS times_used, round(max_by(success_rate, times_used), 6) AS success_rate FROM ({RUNNING}) GROUP BY node_id",
        "tree_steps",
    ),
)

# --- R ---------------------------------------------------------------------------


def solution_trees(f):
    rows = fb.with_stats(f.kb_texts, f.feedback).select(
        F.col("kb_id").alias("tree_id"), "steps_text", F.col("success_rate").alias("rate")
    )
    return tr.step_trees(rows)


NODE_COLS = "tree_id, node_id, parent_id, branch, depth, question, solution, is_leaf, rate"
o.define(
    "tree_rows",
    """SELECT kb_id AS tree_id, success_rate AS rate, CASE WHEN steps_text = '' THEN [] WHEN starts_with(steps_text, '1.') THEN
      list_filter(string_split(regexp_replace(steps_text, '(?m)^(\\d+[.)])', chr(1) || '\\1', 'g'), chr(1)), lambda s: s <> '')
      ELSE [steps_text] END AS steps FROM kbs""",
    ["kbs"],
)
o.define(
    "tree_steps_x",
    "SELECT tree_id, rate, len(steps) AS n, unnest(range(1, len(steps) + 1)) AS i, unnest(steps) AS txt FROM tree_rows WHERE len(steps) > 1",
    ["tree_rows"],
)
o.define(
    "tree_nodes",
    f"""SELECT tree_id, 'root' AS node_id, CAST(NULL AS STRING) AS parent_id, CAST(NULL AS STRING) AS branch, 0 AS depth,
      CASE WHEN len(steps) = 1 THEN 'Apply this solution?' ELSE 'This solution has ' || len(steps) || ' steps. Ready to begin?' END AS question,
      CASE WHEN len(steps) = 1 THEN steps[1] END AS solution, len(steps) = 1 AS is_leaf, rate FROM tree_rows
    UNION ALL SELECT tree_id, 'step' || i, CASE WHEN i = 1 THEN 'root' ELSE 'step' || (i - 1) END, 'yes', i,
      'Step ' || i || ': ' || txt || chr(10) || chr(10) || 'Did this work?', NULL, false, rate FROM tree_steps_x
    UNION ALL SELECT tree_id, 'step' || i || '-yes', 'step' || i, 'yes', i + 1, 'Solution:', {o.lit(fv.TREE_DONE)}, true, 0.5 FROM tree_steps_x WHERE i = n
    UNION ALL SELECT tree_id, 'step' || i || '-no', 'step' || i, 'no', i + 1, 'Solution:', {o.lit(fv.TREE_LAST_NO)}, true, 0.5 FROM tree_steps_x WHERE i = n
    UNION ALL SELECT tree_id, 'failed' || i, 'step' || i, 'no', i + 1, {o.lit(fv.TREE_FAILED)}, NULL, false, 0.5 FROM tree_steps_x WHERE i < n
    UNION ALL SELECT tree_id, 'failed' || i || '-yes', 'failed' || i, 'yes', i + 2, 'Solution:', {o.lit(fv.TREE_RETURN)}, true, 0.5 FROM tree_steps_x WHERE i < n
    UNION ALL SELECT tree_id, 'failed' || i || '-no', 'failed' || i, 'no', i + 2, 'Solution:', 'Continue with step ' || (i + 1), true, 0.5 FROM tree_steps_x WHERE i < n""",
    ["tree_rows", "tree_steps_x"],
)
register(
    "r1_step_trees",
    lambda f: r6(solution_trees(f), "rate"),
    o.sql(f"SELECT {NODE_COLS.replace('rate', 'round(rate, 6) AS rate')} FROM tree_nodes", "tree_nodes"),
)
register(
    "r2_unknown_trees",
    lambda f: tr.unknown_trees(f.queries, f.kb_texts).select("tree_id", "node_id", "parent_id", "branch", "question", "solution"),
    o.sql(
        f"""SELECT h AS tree_id, node_id, parent_id, branch, question, solution FROM (SELECT DISTINCT error_hash AS h FROM inc
        WHERE error_hash NOT IN (SELECT error_hash FROM kb)), (VALUES
        ('root', NULL, NULL, 'No solution found in database. Ask the assistant?', NULL),
        ('yes', 'root', 'yes', 'Solution:', 'Close this window and ask the assistant'),
        ('no', 'root', 'no', 'Solution:', 'This error has been logged for future analysis')) AS t(node_id, parent_id, branch, question, solution)""",
        "inc", "kb",
    ),
)


def guided(f):
    """Category trees of all incoming errors; the best rated solution of a category is its template."""
    rated = fb.with_stats(f.kb_texts, f.feedback).withColumn("category", tx.categorize("error_signature"))
    best = rated.filter((F.size("resolution_steps") > 0) & (F.col("category") != "general")).groupBy("category").agg(
        F.max_by("steps_text", F.struct(F.round("success_rate", 9), "created_at", "kb_id")).alias("template")
    )
    errors = f.queries.select(F.col("query_id").alias("tree_id"), tx.categorize("signature").alias("category"))
    return tr.category_trees(errors.join(best, "category", "left").withColumn("confidence", F.lit(0.6)))


def literal_tree_sql():
    rows = []
    for category, nodes in fv.CATEGORY_TREES.items():
        for node, parent, branch, question, solution in nodes:
            rows.append("(" + ", ".join("NULL" if v is None else o.lit(v) for v in (category, node, parent, branch, question, solution)) + ")")
    return f"(VALUES {', '.join(rows)}) AS n(category, node_id, parent_id, branch, question, solution)"


o.define(
    "guided",
    f"""SELECT i.query_id AS tree_id, n.category, node_id, parent_id, branch, question, CASE WHEN starts_with(solution, '{{template}} | ')
      THEN coalesce(b.template, substring(solution, 14)) ELSE solution END AS solution, solution IS NOT NULL AS is_leaf,
      CASE WHEN parent_id IS NULL THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS rate
    FROM (SELECT query_id, {o.first_contained('signature', fv.CATEGORIES, 'general')} AS category FROM inc) i
    JOIN {literal_tree_sql()} ON n.category = i.category
    LEFT JOIN (SELECT category, max_by(steps_text, (round(success_rate, 9), created_at, kb_id)) AS template FROM (
      SELECT *, {o.first_contained('error_signature', fv.CATEGORIES, 'general')} AS category FROM kbs)
      WHERE len(resolution_steps) > 0 AND category <> 'general' GROUP BY category) b ON b.category = i.category""",
    ["inc", "kbs"],
)
register(
    "r3_category_trees",
    lambda f: guided(f).drop("depth"),
    o.sql("SELECT tree_id, category, node_id, parent_id, branch, question, solution, is_leaf, rate FROM guided", "guided"),
)
register(
    "r4_recommended_path",
    lambda f: tr.recommended_path(guided(f)),
    o.sql(
        """WITH RECURSIVE p AS (SELECT tree_id, node_id, 0 AS pos FROM guided WHERE parent_id IS NULL
        UNION ALL SELECT p.tree_id, c.next, pos + 1 FROM p JOIN (SELECT tree_id, parent_id, CASE WHEN max(CASE WHEN branch = 'yes' THEN rate END) >=
          max(CASE WHEN branch = 'no' THEN rate END) THEN max(CASE WHEN branch = 'yes' THEN node_id END) ELSE max(CASE WHEN branch = 'no' THEN node_id END) END AS next
          FROM guided GROUP BY tree_id, parent_id) c ON c.tree_id = p.tree_id AND c.parent_id = p.node_id WHERE c.next IS NOT NULL)
        SELECT tree_id, node_id, pos FROM p""",
        "guided",
    ).replace("\nWITH RECURSIVE p", ",\np").replace("WITH ", "WITH RECURSIVE ", 1),
)
register(
    "r5_step_counts",
    lambda f: tr.step_counts(solution_trees(f)),
    o.sql("SELECT tree_id, CASE WHEN len(steps) > 1 THEN len(steps) ELSE 0 END AS steps FROM tree_rows", "tree_rows"),
)
register(
    "r6_level_sizes",
    lambda f: tr.level_sizes(solution_trees(f)),
    o.sql("SELECT tree_id, depth, count(*) AS nodes FROM tree_nodes GROUP BY tree_id, depth", "tree_nodes"),
)
register(
    "r7_path_outcomes",
    lambda f: r6(tr.path_outcomes(f.tree_steps), "success_rate", "mean_seconds"),
    o.sql(
        """SELECT node_id, count(*) AS times_used, count(*) FILTER (was_successful) AS successes,
        round(avg(CASE WHEN was_successful THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS success_rate, count(DISTINCT path_id) AS walks,
        round(avg(seconds), 6) AS mean_seconds FROM tree_steps GROUP BY node_id""",
        "tree_steps",
    ),
)
