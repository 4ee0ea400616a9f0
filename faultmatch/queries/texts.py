"""P: text projections and predicates."""

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import text as tx
from faultmatch.operators import candidates as ca, feedback as fb, rules
from faultmatch.queries import oracle as o
from faultmatch.queries.base import register

register(
    "p1_normalize",
    lambda f: f.incoming.select("query_id", tx.normalize("raw_text").alias("signature"))
    .unionByName(f.kb_texts.select(F.concat(F.lit("kb"), "kb_id").alias("query_id"), F.col("error_signature").alias("signature"))),
    o.sql("SELECT query_id, signature FROM inc UNION ALL SELECT concat('kb', kb_id), error_signature FROM kb", "inc", "kb"),
)
register(
    "p1_normalize_documents",
    lambda f: f.documents.select("doc_id", tx.fingerprint(tx.normalize("text")).alias("error_hash")),
)
register(
    "p2_fingerprint",
    lambda f: f.incoming.select("query_id", tx.fingerprint(tx.normalize("raw_text")).alias("error_hash")),
    o.sql("SELECT query_id, error_hash FROM inc", "inc"),
)
register(
    "p3_tokens",
    lambda f: f.incoming.select(
        "query_id",
        F.array_join(tx.tokens(tx.normalize("raw_text")), ",").alias("signature_tokens"),
        F.array_join(tx.tokens("raw_text"), ",").alias("raw_tokens"),
    ),
    o.sql(
        f"""SELECT query_id, coalesce(array_to_string({o.tokens('signature')}, ','), '') AS signature_tokens,
        coalesce(array_to_string({o.tokens('raw_text')}, ','), '') AS raw_tokens FROM inc""",
        "inc",
    ),
)

# Candidate rows per distinct token list, joined back to the queries.
o.define(
    "terms",
    f"SELECT query_id, array_to_string(toks, ' ') AS terms_key, toks FROM (SELECT query_id, {o.tokens('signature')} AS toks FROM inc) WHERE len(toks) > 0",
    ["inc"],
)


def _signature_terms(f):
    return f.incoming.select("query_id", tx.tokens(tx.normalize("raw_text")).alias("tokens")).withColumn(
        "terms_key", ca.term_key("tokens")
    )


def _any(f):
    terms = _signature_terms(f)
    kb = fb.with_stats(f.kb_texts, f.feedback)
    hits = ca.any_token(terms, kb, ["error_text"], ca.by_newest(), fv.FUZZY_CANDIDATES)
    return terms.select("query_id", "terms_key").join(hits, "terms_key").select("query_id", "kb_id", "rank")


register(
    "p4_any_token",
    _any,
    o.sql(
        """SELECT query_id, kb_id, rank FROM (
        SELECT t.query_id, k.kb_id, row_number() OVER (PARTITION BY t.query_id
            ORDER BY k.created_at DESC, k.error_hash, k.kb_id) AS rank
        FROM terms t JOIN kb k ON len(list_filter(toks, lambda t: contains(lower(k.error_text), t))) > 0) WHERE rank <= 100""",
        "terms", "kb",
    ),
)


def _all(f):
    terms = _signature_terms(f)
    kb = fb.with_stats(f.kb_texts, f.feedback)
    hits = ca.all_tokens(terms, kb, ca.by_rate(), 1)
    return terms.select("query_id", "terms_key").join(hits, "terms_key").select("query_id", "kb_id")


ALL_TOKENS = "len(list_filter(toks, lambda t: NOT contains(k.error_signature, t))) = 0"
register(
    "p5_all_tokens",
    _all,
    o.sql(
        f"""SELECT query_id, kb_id FROM (
        SELECT t.query_id, k.kb_id, row_number() OVER (PARTITION BY t.query_id
            ORDER BY k.raw_rate DESC NULLS LAST, k.created_at DESC, k.error_hash, k.kb_id) AS rn
        FROM terms t JOIN kbs k ON {ALL_TOKENS}) WHERE rn = 1""",
        "terms", "kbs",
    ),
)


def _containing(f):
    texts = f.incoming.filter(~tx.is_blank("raw_text")).select("query_id", F.lower("raw_text").alias("needle"))
    hits = ca.containing(texts, fb.with_stats(f.kb_texts, f.feedback), ca.by_rate(), None)
    return texts.join(hits, "needle").select("query_id", "kb_id", "rank")


register(
    "p6_containing",
    _containing,
    o.sql(
        """SELECT query_id, kb_id, rank FROM (
        SELECT i.query_id, k.kb_id, row_number() OVER (PARTITION BY i.query_id
            ORDER BY k.raw_rate DESC NULLS LAST, k.created_at DESC, k.error_hash, k.kb_id) AS rank
        FROM inc i JOIN kbs k ON contains(lower(k.error_signature), lower(i.raw_text))
          OR contains(lower(k.error_text), lower(i.raw_text))
        WHERE trim(i.raw_text) <> '')""",
        "inc", "kbs",
    ),
)
register(
    "p7_pattern_hits",
    lambda f: f.queries.select("query_id", "signature").join(rules.pattern_hits(f.queries, f.patterns), "signature")
    .select("query_id", "pattern_id"),
    o.sql(
        "SELECT query_id, pattern_id FROM inc JOIN patterns ON regexp_matches(signature, pattern_regex)",
        "inc", "patterns",
    ),
)

# Step texts in every format: as stored, bulleted, bracketed, and assistant answers.
o.define(
    "step_texts",
    """SELECT concat('kb', kb_id) AS id, steps_text AS txt FROM kb_raw
    UNION ALL SELECT concat('b', kb_id), concat('Do', chr(10), '- ', steps_text, chr(10), '• done') FROM kb_raw
    UNION ALL SELECT concat('j', kb_id), concat('["', steps_text, '", ''', solution_source, ''' , ""]') FROM kb_raw WHERE solution_source IS NOT NULL
    UNION ALL SELECT concat('a', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), answer FROM answers""",
    ["kb_raw", "answers"],
)


def step_texts(f):
    raw = f.kb_raw
    return (
        raw.select(F.concat(F.lit("kb"), "kb_id").alias("id"), F.col("steps_text").alias("txt"))
        .unionByName(raw.select(F.concat(F.lit("b"), "kb_id").alias("id"), F.concat(F.lit("Do\n- "), "steps_text", F.lit("\n• done")).alias("txt")))
        .unionByName(
            raw.filter(F.col("solution_source").isNotNull()).select(
                F.concat(F.lit("j"), "kb_id").alias("id"),
                F.concat(F.lit('["'), "steps_text", F.lit("\", '"), "solution_source", F.lit("' , \"\"]")).alias("txt"),
            )
        )
        .unionByName(
            f.answers.select(
                F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
                F.col("answer").alias("txt"),
            )
        )
    )


register(
    "p8_split_steps",
    lambda f: step_texts(f).select("id", F.posexplode(tx.split_steps("txt")).alias("pos", "step")).select(
        "id", (F.col("pos") + 1).alias("step_no"), "step"
    ),
    o.sql(
        r"""SELECT id, unnest(range(1, len(steps) + 1)) AS step_no, unnest(steps) AS step FROM (
        SELECT id, CASE WHEN trim(txt) = '' THEN []
          WHEN starts_with(txt, '[') AND ends_with(txt, ']') THEN
            list_filter(list_transform(string_split(trim(txt, '[]'), ','), lambda s: trim(s, ' "''')), lambda s: s <> '')
          WHEN regexp_matches(txt, '(?m)^\d+[.)]') THEN
            list_filter(string_split(regexp_replace(txt, '(?m)^(\d+[.)])', chr(1) || '\1', 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))
          WHEN contains(txt, chr(10) || '•') OR contains(txt, chr(10) || '-') OR contains(txt, chr(10) || '*')
            OR len(string_split(txt, chr(10))) > 2 THEN
            list_filter(string_split(txt, chr(10)), lambda s: regexp_matches(s, '\S'))
          ELSE [txt] END AS steps FROM step_texts)""",
        "step_texts",
    ),
)
register(
    "p9_numbered_lines",
    lambda f: f.answers.select("conv_id", "turn", F.posexplode(tx.numbered_lines("answer")).alias("pos", "line")).select(
        "conv_id", "turn", (F.col("pos") + 1).alias("line_no"), "line"
    ),
    o.sql(
        r"""SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (
        SELECT conv_id, turn, list_transform(list_filter(list_transform(string_split(answer, chr(10)), lambda s: trim(s)),
          lambda s: starts_with(s, '1.') OR starts_with(s, '2.') OR starts_with(s, '3.') OR starts_with(s, '- ')),
          lambda s: trim(ltrim(s, '- '))) AS ls FROM answers)""",
        "answers",
    ),
)
register(
    "p10_teach_steps",
    lambda f: f.teachings.select("teach_id", F.posexplode(tx.teach_steps("steps_text")).alias("pos", "step")).select(
        "teach_id", (F.col("pos") + 1).alias("step_no"), "step"
    ),
    o.sql("SELECT teach_id, unnest(range(1, len(steps) + 1)) AS step_no, unnest(steps) AS step FROM taught", "taught"),
)
register(
    "p11_category",
    lambda f: f.queries.select("query_id", tx.categorize("signature").alias("category")),
    o.sql(f"SELECT query_id, {o.first_contained('signature', fv.CATEGORIES, 'general')} AS category FROM inc", "inc"),
)
register(
    "p12_kb_category",
    lambda f: f.kb_texts.select("kb_id", tx.kb_category("error_signature").alias("category")),
    o.sql(
        """SELECT kb_id, CASE WHEN error_signature LIKE '%login%' THEN 'Authentication'
        WHEN error_signature LIKE '%timeout%' THEN 'Connection' WHEN error_signature LIKE '%permission%' THEN 'Security'
        WHEN error_signature LIKE '%syntax%' THEN 'SQL Syntax' WHEN error_signature LIKE '%deadlock%' THEN 'Concurrency'
        WHEN error_signature LIKE '%corrupt%' THEN 'Data Integrity' ELSE 'Other' END AS category FROM kb""",
        "kb",
    ),
)
register(
    "p13_cluster_label",
    lambda f: f.kb_texts.select("kb_id", tx.cluster_label("error_signature").alias("label")),
    o.sql(f"SELECT kb_id, {o.first_contained('error_signature', fv.CLUSTER_LABELS, 'Other')} AS label FROM kb", "kb"),
)
register(
    "p14_length_band",
    lambda f: f.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), tx.length_band("text").alias("band"))
    .unionByName(f.kb_texts.select(F.concat(F.lit("k"), "kb_id").alias("id"), tx.length_band("error_text").alias("band"))),
    o.sql(
        """SELECT concat('d', doc_id) AS id, CASE WHEN length(text) > 200 THEN 'Long Errors'
        WHEN length(text) < 50 THEN 'Short Errors' ELSE 'Medium Errors' END AS band FROM documents
        UNION ALL SELECT concat('k', kb_id), CASE WHEN length(error_text) > 200 THEN 'Long Errors'
        WHEN length(error_text) < 50 THEN 'Short Errors' ELSE 'Medium Errors' END FROM kb_raw""",
        "kb_raw",
    ),
)
register(
    "p15_rating_band",
    lambda f: f.feedback.select("feedback_id", tx.rating_band("confidence_rating").alias("band")),
    o.sql(
        """SELECT feedback_id, CASE WHEN confidence_rating >= 4 THEN 'High Confidence'
        WHEN confidence_rating >= 3 THEN 'Medium Confidence' ELSE 'Low Confidence' END AS band FROM fb""",
        "fb",
    ),
)
register(
    "p16_confidence_level",
    lambda f: f.kb_texts.select("kb_id", tx.confidence_level("confidence_score").alias("level")),
    o.sql(
        """SELECT kb_id, CASE WHEN confidence_score >= 0.85 THEN 'High' WHEN confidence_score >= 0.6 THEN 'Medium'
        ELSE 'Low' END AS level FROM kb_raw""",
        "kb_raw",
    ),
)
register(
    "p17_source_labels",
    lambda f: f.feedback.select(
        "feedback_id",
        tx.label_of("solution_source", fv.METHOD_NAMES).alias("method"),
        tx.label_of("solution_source", fv.MODEL_NAMES).alias("model"),
        tx.label_of("solution_source", fv.FOUND_TEXTS, fv.FOUND_DEFAULT).alias("found"),
        tx.label_of("solution_source", fv.FOUND_TEXTS_SIMPLE, fv.FOUND_DEFAULT).alias("found_simple"),
        tx.label_of("solution_source", fv.METHOD_INSIGHTS, fv.METHOD_INSIGHT_DEFAULT).alias("insight"),
        tx.label_of("solution_source", fv.CONFIDENCE_ADDENDA, "").alias("addendum"),
    ),
    o.sql(
        f"""SELECT feedback_id, {o.label_of('solution_source', fv.METHOD_NAMES)} AS method,
        {o.label_of('solution_source', fv.MODEL_NAMES)} AS model,
        {o.label_of('solution_source', fv.FOUND_TEXTS, fv.FOUND_DEFAULT)} AS found,
        {o.label_of('solution_source', fv.FOUND_TEXTS_SIMPLE, fv.FOUND_DEFAULT)} AS found_simple,
        {o.label_of('solution_source', fv.METHOD_INSIGHTS, fv.METHOD_INSIGHT_DEFAULT)} AS insight,
        {o.label_of('solution_source', fv.CONFIDENCE_ADDENDA, '')} AS addendum FROM fb""",
        "fb",
    ),
)
