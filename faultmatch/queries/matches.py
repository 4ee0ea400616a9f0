"""M: match layers, cascade, selection, suggestions, context and report."""

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.operators import audit, candidates as ca, feedback as fb
from faultmatch.plans import matching as mt
from faultmatch.queries import oracle as o
from faultmatch.queries.base import register
from faultmatch.queries.reports import BY_RATE
from faultmatch.queries.scores import LEVELS, guidance_sql, modifiers_sql, unified_sql
from faultmatch.session import cut

COLS = "query_id, source, error_hash, steps_text, confidence, success_rate, feedback_count, has_conflicts, version"
ROUNDED = (
    "query_id, source, error_hash, steps_text, round(confidence, 6) AS confidence, round(success_rate, 6) AS success_rate, "
    "feedback_count, has_conflicts, version"
)
STEPS = "coalesce(array_to_string(resolution_steps, chr(10)), '')"


def rated(f):
    return fb.with_stats(f.kb_texts, f.feedback)


def rated_once(f):
    """The rated rows for a query that reads them several times; signatures and hashes are worked out once for them and the feedback."""
    f.hold("kb_texts")
    return f.once("rated", lambda: cut(rated(f)))


def asked(f):
    """Every incoming row as a query, unchecked."""
    return f.queries.withColumn("clean_text", F.col("raw_text")).select(
        "query_id", "raw_text", "clean_text", "signature", "error_hash", "embedding", "user_id", "session_id", "ts"
    )


def asked_texts(f):
    """The queries' texts alone, worked out once."""
    return f.once("asked_texts", lambda: cut(asked(f).select("query_id", "clean_text")))


def kb_vectors(f):
    return f.embeddings.select(F.col("vec_id").cast("string").alias("kb_id"), "embedding")


def query_vectors(f):
    return f.embeddings.select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def insights(f):
    n = F.length("raw_text")
    return f.incoming.select(
        "query_id", (n % 5 == 0).alias("is_anomaly"), (n % 2 == 0).alias("neural_works"),
        ((n % 100) / 100.0).alias("neural_confidence"),
        F.concat(F.lit("group "), (n % 3).cast("string")).alias("trend_category"), (n % 30).cast("double").alias("trend_predicted"),
        ((n % 90) / 90.0).alias("trend_confidence"),
        F.concat(F.lit("Plan "), (n % 7).cast("string")).alias("cluster_template"), ((n % 80) / 80.0).alias("cluster_confidence"),
    )


def show(df):
    return df.select(*mt.RESULT).withColumns({c: F.round(c, 6) for c in ("confidence", "success_rate")})


o.define("asked", "SELECT *, raw_text AS clean_text FROM inc", ["inc"])
o.define(
    "accepted",
    f"SELECT *, sha256(signature) AS error_hash FROM (SELECT *, {o.norm('clean_text')} AS signature FROM checked WHERE is_valid)",
    ["checked"],
)
o.define(
    "insights",
    """SELECT query_id, length(raw_text) % 5 = 0 AS is_anomaly, length(raw_text) % 2 = 0 AS neural_works,
    (length(raw_text) % 100) / 100.0::DOUBLE AS neural_confidence, 'group ' || (length(raw_text) % 3) AS trend_category,
    (length(raw_text) % 30)::DOUBLE AS trend_predicted, (length(raw_text) % 90) / 90.0::DOUBLE AS trend_confidence,
    'Plan ' || (length(raw_text) % 7) AS cluster_template, (length(raw_text) % 80) / 80.0::DOUBLE AS cluster_confidence FROM incoming""",
    ["incoming"],
)


def any_of(x, toks="toks"):
    return f"len(list_filter({toks}, lambda t: contains(lower({x}), t))) > 0"


def layer_sql(base):
    """Define the statements m1..m6 over one table of queries."""

    def name(n):
        return f"{n}_{base}"

    o.define(
        name("m1"),
        f"""SELECT query_id, 'exact_match' AS source, error_hash, {STEPS} AS steps_text,
        {o.confidence('success_rate', 'feedback_count', 'CASE WHEN has_conflicts THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END')} AS confidence,
        success_rate, feedback_count, has_conflicts, '1.0' AS version FROM (
        SELECT k.*, q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY k.created_at DESC, k.kb_id) AS rn
        FROM {base} q JOIN kbs k ON q.error_hash = k.error_hash) WHERE rn = 1""",
        [base, "kbs"],
    )
    o.word_sums(name("w2"), f"SELECT DISTINCT signature AS q FROM {base}", [base], "kbs", ["error_signature", "error_text"])
    # the gram part adds at most its weight: only pairs that can still be best need it
    o.define(
        name("part2"),
        f"""SELECT * FROM (SELECT *, max(part) OVER (PARTITION BY qid) AS lead FROM (SELECT p.qid, kb_id,
        coalesce(a.fz, 0.0) * 0.5::DOUBLE + coalesce(c.fz, 0.0) * 0.2::DOUBLE + CASE WHEN success_rate > 0.7 THEN 0.2::DOUBLE ELSE 0.0 END AS part
        FROM {name('w2')}_tok p JOIN {name('w2')}_x s ON s.xid = p.xid JOIN kbs k ON k.error_signature = s.x JOIN {name('w2')}_x t ON t.x = k.error_text
        LEFT JOIN {name('w2')}_fz a ON a.qid = p.qid AND a.xid = s.xid LEFT JOIN {name('w2')}_fz c ON c.qid = p.qid AND c.xid = t.xid))
        WHERE part + 0.3 >= greatest(lead, 0.4) - 1e-6""",
        ["kbs", name("w2") + "_tok", name("w2") + "_fz"],
    )
    o.define(
        name("m2"),
        f"""SELECT query_id, 'enhanced_fuzzy_keyword' AS source, b.error_hash, steps_text, least(0.95::DOUBLE, score) AS confidence,
        success_rate, feedback_count, false AS has_conflicts, '1.0' AS version FROM {base} r JOIN (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, {BY_RATE}) AS rn FROM (
        SELECT q, k.*, {STEPS} AS steps_text, round(part + {o.jaccard('qg', 's.xg')} * 0.3::DOUBLE, 9) AS score
        FROM {name('part2')} p JOIN {name('w2')}_q q USING (qid) JOIN kbs k USING (kb_id) JOIN {name('w2')}_x s ON s.x = k.error_signature)
        WHERE score > 0.4) b ON b.q = r.signature WHERE rn = 1""",
        [base, name("part2")],
    )
    o.word_sums(name("w3"), f"SELECT DISTINCT clean_text AS q FROM {base}", [base], "kbs", ["error_signature", "error_text"])
    o.define(
        name("part3"),
        f"""SELECT * FROM (SELECT *, tf * 0.42::DOUBLE + sf * 0.18::DOUBLE + rated AS part, max(tf * 0.42::DOUBLE + sf * 0.18::DOUBLE + rated) OVER (PARTITION BY qid) AS lead
        FROM (SELECT p.qid, kb_id, coalesce(c.fz, 0.0) AS tf, coalesce(a.fz, 0.0) AS sf, success_rate * least(1.0::DOUBLE, feedback_count / 10.0::DOUBLE) * 0.2::DOUBLE AS rated
        FROM {name('w3')}_tok p JOIN {name('w3')}_x t ON t.xid = p.xid JOIN kbs k ON k.error_text = t.x JOIN {name('w3')}_x s ON s.x = k.error_signature
        LEFT JOIN {name('w3')}_fz a ON a.qid = p.qid AND a.xid = s.xid LEFT JOIN {name('w3')}_fz c ON c.qid = p.qid AND c.xid = t.xid))
        WHERE part + 0.4 >= greatest(lead, 0.5) - 1e-6""",
        ["kbs", name("w3") + "_tok", name("w3") + "_fz"],
    )
    o.define(
        name("m3"),
        f"""SELECT query_id, 'enhanced_fuzzy_search' AS source, b.error_hash, steps_text, least(0.95::DOUBLE, score) AS confidence,
        success_rate, feedback_count, false AS has_conflicts, '1.0' AS version FROM {base} r JOIN (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, created_at DESC, error_hash, kb_id) AS rn FROM (
        SELECT q, k.*, {STEPS} AS steps_text, round((tf * 0.6::DOUBLE + {o.jaccard('qg', 't.xg')} * 0.4::DOUBLE) * 0.7::DOUBLE
          + (sf * 0.6::DOUBLE + {o.jaccard('qg', 's.xg')} * 0.4::DOUBLE) * 0.3::DOUBLE + rated, 9) AS score
        FROM {name('part3')} p JOIN {name('w3')}_q q USING (qid) JOIN kbs k USING (kb_id)
        JOIN {name('w3')}_x s ON s.x = k.error_signature JOIN {name('w3')}_x t ON t.x = k.error_text)
        WHERE score > 0.5) b ON b.q = r.clean_text WHERE rn = 1""",
        [base, name("part3")],
    )
    o.define(
        name("near"),
        f"""SELECT query_id, kb_id, error_hash, confidence_score, similarity, row_number() OVER (PARTITION BY query_id
        ORDER BY round(similarity * (0.7::DOUBLE + confidence_score * 0.3::DOUBLE), 9) DESC, error_hash, kb_id) AS rank FROM (
        SELECT *, {o.dot(o.unit('qv'), o.unit('kv'))} AS similarity FROM bucket_ranked
        WHERE query_id IN (SELECT query_id FROM {base})) WHERE similarity >= 0.7""",
        [base, "bucket_ranked"],
    )
    o.define(
        name("m4"),
        f"""SELECT query_id, 'advanced_scalable_vector' AS source, error_hash, {STEPS} AS steps_text,
        least(0.95::DOUBLE, similarity + success_rate * 0.2::DOUBLE) AS confidence, success_rate, feedback_count,
        false AS has_conflicts, '2.0' AS version FROM (
        SELECT n.query_id, n.error_hash, n.similarity, n.confidence_score AS success_rate, k.resolution_steps, k.feedback_count,
        row_number() OVER (PARTITION BY n.query_id ORDER BY round(n.similarity + CASE WHEN n.confidence_score > 0.8 THEN 0.1::DOUBLE ELSE 0 END
          + least(0.1::DOUBLE, k.feedback_count * 0.01::DOUBLE), 9) DESC, n.rank) AS rn
        FROM {name('near')} n JOIN kbs k USING (kb_id) WHERE n.rank <= 10) WHERE rn = 1""",
        [name("near"), "kbs"],
    )
    o.define(
        name("cand5"),
        f"""SELECT t.query_id, t.clean_text, t.c, k.* FROM (SELECT *, {o.tokens('broad')} AS toks FROM (
        SELECT *, array_to_string({o.ordered_distinct('raw_ex')}, ' ') AS broad FROM (
        SELECT p.*, {o.expand('clean_text')} AS raw_ex FROM (SELECT query_id, clean_text, kb_id, {o.dot('qu', 'ku')} AS c FROM
          (SELECT query_id, clean_text, {o.unit('e.embedding')} AS qu FROM {base} JOIN embeddings e ON CAST(e.vec_id AS STRING) = query_id),
          (SELECT CAST(vec_id AS STRING) AS kb_id, {o.unit('embedding')} AS ku FROM embeddings)) p WHERE c >= 0.7))) t
        JOIN kbs k ON k.kb_id = t.kb_id AND (len(toks) = 0 OR {any_of('k.error_signature')} OR {any_of('k.error_text')})""",
        [base, "kbs"],
    )
    o.define(
        name("m5"),
        f"""SELECT query_id, 'enhanced_vector_fuzzy' AS source, error_hash, {STEPS} AS steps_text, trust AS confidence,
        success_rate, feedback_count, has_conflicts, CAST(NULL AS STRING) AS version FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round((c * 0.7::DOUBLE + fz * 0.3::DOUBLE) * (0.6::DOUBLE + trust * 0.4::DOUBLE), 9) DESC,
          created_at DESC, error_hash, kb_id) AS rn FROM (
        SELECT *, {o.fuzzy('lq', 'lt', 'qw', 'tw', 'ex')} AS fz, {o.confidence('success_rate', 'feedback_count', 'CASE WHEN has_conflicts THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END')} AS trust FROM (
        SELECT *, lower(clean_text) AS lq, lower(error_text) AS lt, {o.long_words('clean_text')} AS qw, {o.long_words('error_text')} AS tw,
        {o.expand('clean_text')} AS ex FROM {name('cand5')}))) WHERE rn = 1""",
        [name("cand5")],
    )
    o.define(
        name("m6"),
        f"""SELECT query_id, 'pattern_match' AS source, sha256(steps_text) AS error_hash, steps_text,
        least(0.9::DOUBLE, effectiveness_score + usage_count * 0.01::DOUBLE) AS confidence, effectiveness_score AS success_rate,
        usage_count AS feedback_count, false AS has_conflicts, '1.0' AS version FROM (
        SELECT q.query_id, p.*, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, effectiveness_score DESC, pattern_id) AS rn
        FROM {base} q JOIN patterns p ON regexp_matches(signature, pattern_regex)) WHERE rn = 1""",
        [base, "patterns"],
    )


layer_sql("asked")
layer_sql("accepted")


def layer(n):
    return o.sql(f"SELECT {ROUNDED} FROM m{n}_asked", f"m{n}_asked")


register("m1_exact_match", lambda f: show(mt.exact_match(asked(f), rated(f))), layer(1))
register("m2_keyword_match", lambda f: show(mt.keyword_match(asked(f), rated(f))), layer(2))
register("m3_fuzzy_match", lambda f: show(mt.fuzzy_match(asked_texts(f), rated_once(f))), layer(3))


def with_vectors(f):
    return asked(f).filter(F.col("embedding").isNotNull())


register("m4_index_match", lambda f: show(mt.index_match(with_vectors(f), rated(f), kb_vectors(f))), layer(4))
register("m5_vector_fuzzy_match", lambda f: show(mt.vector_fuzzy_match(with_vectors(f), rated(f), kb_vectors(f))), layer(5))
register("m6_pattern_match", lambda f: show(mt.pattern_match(asked(f), f.patterns)), layer(6))

o.define(
    "m9",
    f"""SELECT query_id, 'keyword_match' AS source, error_hash, {STEPS} AS steps_text,
    {o.confidence('success_rate', 'feedback_count', '0.0')} AS confidence, success_rate, feedback_count,
    false AS has_conflicts, '1.0' AS version FROM (SELECT t.query_id, k.*, row_number() OVER (PARTITION BY t.query_id
      ORDER BY {BY_RATE}) AS rn FROM terms t JOIN kbs k ON len(list_filter(toks, lambda t: NOT contains(k.error_signature, t))) = 0) WHERE rn = 1""",
    ["terms", "kbs"],
)
register(
    "m9_strict_keyword_match",
    lambda f: show(mt.strict_keyword_match(asked(f), rated(f))),
    o.sql(f"SELECT {ROUNDED} FROM m9", "m9"),
)
o.word_sums("w10", "SELECT DISTINCT clean_text AS q FROM asked WHERE trim(clean_text) <> ''", ["asked"], "kb", ["error_text"])
register(
    "m10_simple_fuzzy_match",
    lambda f: show(mt.simple_fuzzy_match(asked(f), rated(f))),
    o.sql(
        f"""SELECT query_id, 'fuzzy_search' AS source, error_hash, steps_text, round(least(0.95::DOUBLE, total), 6) AS confidence,
        0.0::DOUBLE AS success_rate, 0 AS feedback_count, false AS has_conflicts, '1.0' AS version FROM (
        SELECT query_id, b.error_hash, steps_text, total FROM asked JOIN (
        SELECT *, row_number() OVER (PARTITION BY q ORDER BY total DESC, created_at DESC, error_hash, kb_id) AS rn FROM (
        SELECT q, kb_id, error_hash, created_at, {STEPS} AS steps_text, fz, ng, round(part + ng * 0.2::DOUBLE, 9) AS total FROM (
        SELECT q, p.fz, p.part, k.*, {o.jaccard('qg', 't.xg')} AS ng FROM (
        SELECT *, max(CASE WHEN round(fz, 9) > 0.5 THEN part END) OVER (PARTITION BY qid) AS lead FROM (
        SELECT qid, kb_id, fz, fz + CASE WHEN contains(error_text, lq) THEN 0.3::DOUBLE ELSE 0.0 END AS part
        FROM w10_fz JOIN w10_x t USING (xid) JOIN kb k ON k.error_text = t.x JOIN w10_q USING (qid))) p
        JOIN w10_q USING (qid) JOIN kb k USING (kb_id) JOIN w10_x t ON t.x = k.error_text
        WHERE part + 0.2 >= greatest(coalesce(lead, 0), 0.6) - 1e-6))
        WHERE round(fz, 9) > 0.5 OR ng > 0.4) b ON b.q = asked.clean_text
        WHERE rn = 1 AND total > 0.6)""",
        "asked", "w10_fz",
    ),
)
register(
    "m12_secure_vector_match",
    lambda f: show(mt.secure_vector_match(with_vectors(f), rated(f), kb_vectors(f))),
    o.sql(
        f"""SELECT {ROUNDED} FROM (SELECT query_id, 'secure_scalable_vector' AS source, error_hash, {STEPS} AS steps_text,
        similarity AS confidence, success_rate, feedback_count, false AS has_conflicts, 'Secure-2.0' AS version FROM (
        SELECT query_id, k.error_hash, similarity, n.confidence_score AS success_rate, resolution_steps, k.feedback_count,
        row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, rank) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity * (0.7::DOUBLE + confidence_score * 0.3::DOUBLE), 9) DESC, error_hash, kb_id) AS rank FROM (
          SELECT b.*, {o.dot(o.unit('qv'), o.unit('kv'))} AS similarity FROM (SELECT query_id, kb_id, error_hash, confidence_score, qv, kv, rank AS crank FROM bucket_ranked) b
          WHERE query_id IN (SELECT query_id FROM checked_strict WHERE is_valid)) WHERE similarity >= 0.7) n
        JOIN kbs k USING (kb_id) WHERE rank <= 5) WHERE rn = 1)""",
        "bucket_ranked", "checked_strict", "kbs",
    ),
)


def checked(f):
    """Incoming rows with their verdicts, worked out once for all steps that read them."""
    f.hold("incoming")
    return f.once("checked", lambda: cut(audit.validate(f.incoming, f.security_log)))


def cascaded(f, learned=None):
    f.hold("kb_texts")
    return mt.cascade(checked(f), f.kb_texts, kb_vectors(f), f.feedback, f.patterns, query_vectors(f), learned)


o.define(
    "cascaded",
    f"""SELECT c.query_id, c.verdict, c.is_valid, r.layer, r.source, r.error_hash, r.steps_text, r.confidence, r.success_rate,
    r.feedback_count, r.has_conflicts, r.version, CASE WHEN NOT c.is_valid THEN 'blocked'
      WHEN r.layer IS NULL OR trim(r.steps_text) = '' THEN 'no_match' ELSE 'matched' END AS status
    FROM checked c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step) AS rn FROM (
      SELECT 1 AS step, 1 AS layer, {COLS} FROM m1_accepted UNION ALL SELECT 2, 2, {COLS} FROM m2_accepted
      UNION ALL SELECT 3, 3, {COLS} FROM m3_accepted UNION ALL SELECT 4, 4, {COLS} FROM m4_accepted
      UNION ALL SELECT 5, 4, {COLS} FROM m5_accepted UNION ALL SELECT 6, 5, {COLS} FROM m6_accepted)) WHERE rn = 1) r USING (query_id)""",
    ["checked"] + [f"m{i}_accepted" for i in range(1, 7)],
)
register(
    "m13_cascade",
    lambda f: cascaded(f).select("status", "verdict", "layer", *mt.RESULT).withColumns(
        {c: F.round(c, 6) for c in ("confidence", "success_rate")}
    ),
    o.sql(f"SELECT status, verdict, layer, {ROUNDED} FROM cascaded", "cascaded"),
)

o.define(
    "enhanced",
    f"""SELECT * REPLACE (CASE WHEN layer IN (1, 2, 3, 5) AND trim(steps_text) <> '' THEN
    {modifiers_sql('u', 'feedback_count', 'is_anomaly', 'n_steps', '0')} ELSE confidence END AS confidence) FROM (
    SELECT c.*, is_anomaly, neural_works, neural_confidence, trend_category, trend_predicted, trend_confidence, CASE WHEN starts_with(steps_text, '1.') THEN 3 ELSE 1 END AS n_steps,
    {unified_sql('success_rate', 'feedback_count', '(CASE WHEN has_conflicts THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END)', 'neural_confidence', None)} AS u
    FROM cascaded c JOIN insights USING (query_id) WHERE status <> 'blocked' AND layer IS NOT NULL)""",
    ["cascaded", "insights"],
)


def answers(f):
    return cascaded(f).filter(F.col("layer").isNotNull()).drop("verdict", "is_valid", "status")


register(
    "m14_enhance",
    lambda f: mt.enhance(answers(f), insights(f)).select("query_id", "layer", F.round("confidence", 6).alias("confidence")),
    o.sql("SELECT query_id, layer, round(confidence, 6) AS confidence FROM enhanced", "enhanced"),
)


def several(f):
    """Answers of three layers side by side, so that there is something to choose from."""
    q, kb = asked(f), rated(f)
    return mt.exact_match(q, kb).unionByName(mt.pattern_match(q, f.patterns)).unionByName(mt.strict_keyword_match(q, kb))


SEVERAL = f"(SELECT {COLS} FROM m1_asked UNION ALL SELECT {COLS} FROM m6_asked UNION ALL SELECT {COLS} FROM m9)"
PICK = """row_number() OVER (PARTITION BY query_id ORDER BY round(confidence, 9) DESC, round(success_rate, 9) DESC,
  feedback_count DESC, source, error_hash) AS rn"""
BONUS = """(CASE WHEN neural_works AND neural_confidence > 0.7 THEN 0.1::DOUBLE ELSE 0.0 END
  - CASE WHEN is_anomaly THEN 0.05::DOUBLE ELSE 0.0 END)"""
register(
    "m15_select_with_insights",
    lambda f: show(mt.select_best(several(f), insights(f))),
    o.sql(
        f"""SELECT {ROUNDED} FROM (SELECT *, {PICK} FROM (SELECT s.* REPLACE (confidence + {BONUS} AS confidence)
        FROM {SEVERAL} s JOIN insights USING (query_id) WHERE trim(steps_text) <> '')) WHERE rn = 1""",
        "m1_asked", "m6_asked", "m9", "insights",
    ),
)
register(
    "m16_select_minimum",
    lambda f: show(mt.select_best(several(f), minimum=0.1)),
    o.sql(
        f"SELECT {ROUNDED} FROM (SELECT *, {PICK} FROM {SEVERAL} WHERE trim(steps_text) <> '') WHERE rn = 1 AND round(confidence, 9) >= 0.1",
        "m1_asked", "m6_asked", "m9",
    ),
)
register(
    "m18_suggestions",
    lambda f: mt.suggestions(asked(f).select("query_id", "clean_text"), f.kb_texts, insights(f)),
    o.sql(
        f"""SELECT a.query_id, alternatives, coalesce(similar_errors, '') AS similar_errors,
        CASE WHEN is_anomaly THEN {o.lit(fv.UNUSUAL_WARNING)} ELSE '' END AS warning,
        CASE WHEN cluster_confidence > 0.5 THEN {o.lit(fv.TEMPLATE_INTRO)} || cluster_template ELSE '' END AS template FROM (
        SELECT query_id, clean_text, CASE WHEN len(ex) > 1 THEN coalesce(array_to_string(list_filter(list_slice(ex, 1, 3), lambda t: t <> lower(clean_text)), ', '), '') ELSE '' END AS alternatives
        FROM (SELECT query_id, clean_text, {o.ordered_distinct('raw_ex')} AS ex FROM (SELECT query_id, clean_text, {o.expand('clean_text')} AS raw_ex FROM asked))) a
        LEFT JOIN (SELECT clean_text, string_agg(line, '; ' ORDER BY n) AS similar_errors FROM (
          SELECT clean_text, n, CASE WHEN length(error_signature) > 60 THEN substring(error_signature, 1, 57) || '...' ELSE error_signature END AS line,
          row_number() OVER (PARTITION BY clean_text ORDER BY n) AS pos FROM (
          SELECT * FROM (SELECT clean_text, error_signature, n, round({o.jaccard('a', 'b')}, 9) AS close FROM (
            SELECT clean_text, error_signature, {o.grams('clean_text')} AS a, {o.grams('error_signature')} AS b,
            row_number() OVER (PARTITION BY clean_text ORDER BY error_signature) AS n FROM (
              SELECT DISTINCT clean_text, substring({o.tokens('clean_text')}[1], 1, 4) AS prefix FROM asked) JOIN (SELECT DISTINCT error_signature FROM kb)
            ON contains(error_signature, prefix)) WHERE n <= 5) WHERE close > 0.3 AND close < 0.7)) WHERE pos <= 2 GROUP BY clean_text) s USING (clean_text)
        JOIN insights n ON n.query_id = a.query_id""",
        "asked", "kb", "insights",
    ),
)
register(
    "m19_context",
    lambda f: mt.context_rows(f.incoming.select("query_id", "raw_text"), f.kb_texts, f.feedback),
    o.sql(
        """SELECT query_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS context FROM (
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rate, 9) DESC, created_at DESC, error_hash, kb_id) AS rank,
        error_signature || CASE WHEN rate > 0.7 THEN ' (Proven high success rate)' ELSE '' END || ' => ' || coalesce(array_to_string(resolution_steps, ' / '), '') AS line
        FROM (SELECT i.query_id, k.*, coalesce(s.success_rate, 0.5) AS rate FROM inc i JOIN kb k
          ON contains(lower(k.error_signature), lower(i.raw_text)) OR contains(lower(k.error_text), lower(i.raw_text))
          LEFT JOIN stats s ON s.solution_hash = k.error_hash AND s.feedback_count >= 3 WHERE trim(i.raw_text) <> '')) GROUP BY query_id""",
        "inc", "kb", "stats",
    ),
)

_score, _reasons = guidance_sql(
    "confidence", "n_steps", "has_conflicts", "feedback_count", "clean_text", "is_anomaly", "neural_works", "neural_confidence"
)
PERCENT = "CAST(CAST(round({} * 100) AS BIGINT) AS STRING) || '%'"
register(
    "m20_report",
    lambda f: mt.report(answers(f), insights(f), checked(f)),
    o.sql(
        f"""SELECT query_id, layer, source, round(confidence, 6) AS confidence, 'Confidence: ' || CASE WHEN confidence >= 0.85 THEN 'High'
        WHEN confidence >= 0.6 THEN 'Medium' ELSE 'Low' END || ' (' || {PERCENT.format('confidence')} || ') | Success Rate: ' || {PERCENT.format('success_rate')}
        || ' | Based on ' || CAST(feedback_count AS STRING) || ' user ratings' || CASE WHEN has_conflicts THEN ' Some users reported mixed results.' ELSE '' END
        || {o.label_of('source', fv.CONFIDENCE_ADDENDA, '')} || CASE WHEN is_anomaly THEN ' Anomalous error - exercise caution' ELSE '' END
        || CASE WHEN neural_confidence > 0.8 THEN ' Neural network: ' || {PERCENT.format('neural_confidence')} || ' confidence' ELSE '' END AS headline,
        {o.label_of('source', fv.FOUND_TEXTS, fv.FOUND_DEFAULT)} AS found, {o.label_of('source', fv.METHOD_INSIGHTS, fv.METHOD_INSIGHT_DEFAULT)} AS method,
        concat_ws('; ', CASE WHEN is_anomaly THEN 'This error pattern is unusual' END, CASE WHEN trend_confidence > 0.7 THEN
          'This type of error (' || trend_category || ') is predicted to occur ~' || CAST(trend_predicted AS BIGINT) || ' times in the next hour' END,
          CASE WHEN neural_confidence > 0.7 THEN
          'Solutions for this error are ' || CASE WHEN neural_works THEN 'likely to work' ELSE 'may need alternatives' END
          || ' (confidence: ' || {PERCENT.format('neural_confidence')} || ')' END) AS insight,
        score AS guidance_score, {LEVELS} AS guidance, reasons FROM (
        SELECT *, {_score} AS score, {_reasons} AS reasons FROM (SELECT e.* REPLACE (confidence + {BONUS} AS confidence), c.clean_text
          FROM enhanced e JOIN checked c USING (query_id) WHERE trim(steps_text) <> ''))""",
        "enhanced",
    ),
)
