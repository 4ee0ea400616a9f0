"""E11-E22 and F1-F16: similarity and score columns, similarity joins, vector parsing."""

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, similarity as sim, text as tx
from faultmatch.operators import feedback as fb, ngram_join as ng, vectors as ve
from faultmatch.queries import oracle as o
from faultmatch.queries.base import register
from faultmatch.sources.fixtures import AS_OF

# Every incoming row with its own knowledge row and with a later one.
o.define(
    "pairs",
    """SELECT concat(query_id, '/', k.kb_id) AS pair_id, i.raw_text AS q, i.signature, k.error_text AS t, k.error_signature
    FROM inc i JOIN kb k ON k.kb_id IN (i.query_id, CAST(CAST(i.query_id AS BIGINT) + 10 AS STRING))""",
    ["inc", "kb"],
)


def pairs(f):
    offsets = F.explode(F.array(F.lit(0), F.lit(10)))
    q = f.queries.select("query_id", F.col("raw_text").alias("q"), "signature", offsets.alias("d")).withColumn(
        "kb_id", (F.col("query_id").cast("long") + F.col("d")).cast("string")
    )
    k = f.kb_texts.select("kb_id", F.col("error_text").alias("t"), "error_signature")
    return q.join(k, "kb_id").withColumn("pair_id", F.concat("query_id", F.lit("/"), "kb_id"))


register(
    "e11_levenshtein",
    lambda f: pairs(f).select("pair_id", sim.levenshtein("q", "t").alias("distance")),
    o.sql("SELECT pair_id, levenshtein(lower(q), lower(t)) AS distance FROM pairs", "pairs"),
)
register(
    "e12_similarity",
    lambda f: pairs(f).select("pair_id", F.round(sim.similarity("q", "t"), 6).alias("similarity")),
    o.sql(
        f"""SELECT pair_id, round(CASE WHEN q = '' OR t = '' THEN 0.0 WHEN lower(q) = lower(t) THEN 1.0
        ELSE {o.similarity('lower(q)', 'lower(t)')} END, 6) AS similarity FROM pairs""",
        "pairs",
    ),
)
register(
    "e13_expand",
    lambda f: f.queries.select("query_id", F.array_join(sim.expand("signature"), "|").alias("terms")),
    o.sql(
        f"SELECT query_id, array_to_string({o.ordered_distinct('ex')}, '|') AS terms FROM (SELECT query_id, {o.expand('signature')} AS ex FROM inc)",
        "inc",
    ),
)
register(
    "e14_fuzzy_score",
    lambda f: pairs(f).select("pair_id", F.round(sim.fuzzy_score("q", "t"), 6).alias("score")),
    o.sql(
        f"""SELECT pair_id, round({o.fuzzy('lq', 'lt', 'qw', 'tw', 'ex')}, 6) AS score FROM (
        SELECT pair_id, lower(q) AS lq, lower(t) AS lt, {o.long_words('q')} AS qw, {o.long_words('t')} AS tw,
        {o.expand('q')} AS ex FROM pairs)""",
        "pairs",
    ),
)
register(
    "e15_ngram_similarity",
    lambda f: pairs(f).select("pair_id", F.round(sim.ngram_similarity("q", "t"), 6).alias("similarity")),
    o.sql(
        f"""SELECT pair_id, round({o.jaccard('a', 'b')}, 6) AS similarity FROM (
        SELECT pair_id, {o.grams('q')} AS a, {o.grams('t')} AS b FROM pairs)""",
        "pairs",
    ),
)


def _ngram_join(f):
    return ng.ngram_join(
        f.queries.select(F.col("signature").alias("text")), f.kb_texts.select(F.col("error_signature").alias("text")), 0.8
    ).select("left_text", "right_text", F.round("similarity", 6).alias("similarity"))


register(
    "e16_ngram_join",
    _ngram_join,
    o.sql(
        f"""SELECT left_text, right_text, round(s, 6) AS similarity FROM (
        SELECT left_text, right_text, {o.jaccard('a', 'b')} AS s FROM (
          SELECT DISTINCT signature AS left_text, {o.grams('signature')} AS a FROM inc) JOIN (
          SELECT DISTINCT error_signature AS right_text, {o.grams('error_signature')} AS b FROM kb)
          ON len(a) >= 0.8 * len(b) - 0.001 AND len(b) >= 0.8 * len(a) - 0.001) WHERE s >= 0.8""",
        "inc", "kb",
    ),
)
register(
    "e17_l2_normalize",
    lambda f: f.embeddings.select("vec_id", F.posexplode(sim.l2_normalize("embedding")).alias("i", "x")).select(
        "vec_id", "i", F.round("x", 6).alias("x")
    ),
    f"SELECT vec_id, unnest(range(0, len(u))) AS i, round(unnest(u), 6) AS x FROM (SELECT vec_id, {o.unit('embedding')} AS u FROM embeddings)",
)


def _cosine(f):
    a = f.embeddings.select("vec_id", F.col("embedding").alias("a"))
    b = f.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), "label")
    cut = F.expr("slice(b, 1, 64 - label)")
    return a.join(b, "vec_id").select(
        "vec_id",
        F.round(sim.cosine("a", cut, "index"), 6).alias("index_cosine"),
        F.round(sim.cosine("a", cut, "kb"), 6).alias("kb_cosine"),
    )


register(
    "e18_cosine",
    _cosine,
    f"""SELECT vec_id, round(CASE WHEN label = 0 THEN {o.dot('a', 'b')} ELSE 0.0 END, 6) AS index_cosine,
    round({o.dot('list_slice(a, 1, 64 - label)', 'b')}, 6) AS kb_cosine FROM (
    SELECT vec_id, label, {o.unit('a')} AS a, {o.unit('b')} AS b FROM (
      SELECT x.vec_id, y.label, x.embedding AS a, list_slice(y.embedding, 1, 64 - y.label) AS b
      FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1))""",
)


def bucket_sql(v):
    cols = []
    for weights in sim.projection_weights(64):
        ws = "[" + ", ".join(f"{w!r}::DOUBLE" for w in weights) + "]"
        cols.append(f"CAST(CAST(trunc({o.dot(v, ws)} * 100) AS INT) AS STRING)")
    return cols


register(
    "e19_lsh_buckets",
    lambda f: ve.build_index(f.embeddings, "vec_id").drop("embedding"),
    "SELECT vec_id, " + ", ".join(f"{c} AS lsh_hash_{i}" for i, c in enumerate(bucket_sql("embedding"))) + " FROM embeddings",
)
register(
    "e20_check_dim",
    lambda f: (lambda good, bad: good.select("vec_id", F.lit("valid").alias("state")).unionByName(
        bad.select("vec_id", F.lit("rejected").alias("state"))))(
        *ve.check_dim(f.embeddings.withColumn("embedding", F.expr("slice(embedding, 1, if(label = 4, 60, 64))")), 64)),
    "SELECT vec_id, CASE WHEN label = 4 THEN 'rejected' ELSE 'valid' END AS state FROM embeddings",
)
register(
    "e21_cache_key",
    lambda f: f.embeddings.select("vec_id", sim.cache_key("embedding", 10, 0.7).alias("cache_key")),
)


def vectors_of(f):
    return f.embeddings.select(F.col("vec_id").cast("string").alias("kb_id"), "embedding")


def vector_queries(f):
    return f.embeddings.select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def _vector_join(min_sim):
    return lambda f: ve.vector_join(vector_queries(f), vectors_of(f), min_sim).withColumn(
        "similarity", F.round("similarity", 6)
    )


def vector_join_sql(min_sim):
    return f"""WITH u AS MATERIALIZED (SELECT CAST(vec_id AS STRING) AS id, {o.unit('embedding')} AS u FROM embeddings)
    SELECT query_id, kb_id, round(s, 6) AS similarity FROM (
    SELECT a.id AS query_id, b.id AS kb_id, list_dot_product(a.u, b.u) AS s FROM u a, u b) WHERE s >= {min_sim}"""


register("e22_vector_join", _vector_join(0.70), vector_join_sql(0.70))
register("e22_vector_join_wide", _vector_join(0.35), vector_join_sql(0.35))


def _parsed(f):
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ", "))
    v = f.embeddings.select(
        "vec_id",
        sim.parse_vector(F.concat(text, F.lit(", bad, 1.5]"))).alias("a"),
        sim.parse_vector(F.concat(F.lit("array("), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit(")"))).alias("b"),
        sim.parse_json_vector(F.when(F.col("label") == 3, "[1, oops").otherwise(F.concat(text, F.lit("]")))).alias("c"),
    )
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    return v.select("vec_id", *[e for c in "abc" for e in (F.size(c).alias(f"n_{c}"), total(F.col(c)).alias(f"sum_{c}"))])


register(
    "a13_parse_vectors",
    _parsed,
    """SELECT vec_id, 65 AS n_a, round(s + 1.5, 4) AS sum_a, 64 AS n_b, round(s, 4) AS sum_b,
    CASE WHEN label = 3 THEN 0 ELSE 64 END AS n_c, CASE WHEN label = 3 THEN 0.0 ELSE round(s, 4) END AS sum_c FROM (
    SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings)""",
)

# --- F ------------------------------------------------------------------------------


def complexity_sql(x):
    sentences = f"len(list_filter(regexp_split_to_array({x}, '[.!?]'), lambda s: s <> ''))"
    n = f"len(string_split({x}, ' '))"
    return (
        f"CASE WHEN {sentences} = 0 THEN 0.0 ELSE least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * ({n}::DOUBLE / {sentences}) "
        f"- 84.6::DOUBLE * ((length(replace({x}, ' ', ''))::DOUBLE / {n}) / 10)) END"
    )


def code_sql(x):
    return f"coalesce(TRY_CAST(regexp_extract({x}, {o.lit('(?i)' + fv.ERROR_CODE_PATTERN)}, 1) AS INT), 0)"


def special_sql(x):
    return rf"length(regexp_replace({x}, '[\p{{L}}\p{{Nd}}\s\p{{Z}}]', '', 'g'))"


FEATURE_SQL = (
    ["length({t})", "len(string_split({t}, ' '))", "len(string_split({t}, chr(10)))"]
    + ["CASE WHEN contains(lower({t}), '%s') THEN 1 ELSE 0 END" % w for w in fv.FEATURE_KEYWORDS]
    + [code_sql("{t}"), "hour({ts})", "dayofweek({ts})", complexity_sql("{t}"), special_sql("{t}")]
)


def feature_columns_sql(t, ts, digits=6):
    cols = []
    for name, expr in zip(sc.FEATURE_NAMES, FEATURE_SQL):
        body = expr.replace("{t}", t).replace("{ts}", ts).replace("{{", "{").replace("}}", "}")
        cols.append(f"round(({body})::DOUBLE, {digits}) AS {name}" if digits else f"({body})::DOUBLE AS {name}")
    return ", ".join(cols)


register(
    "f1_features",
    lambda f: f.kb_texts.select("kb_id", *sc.features("error_text", "created_at")).select(
        "kb_id", *[F.round(n, 6).alias(n) for n in sc.FEATURE_NAMES]
    ),
    o.sql(f"SELECT kb_id, {feature_columns_sql('error_text', 'created_at')} FROM kb", "kb"),
)
register(
    "f2_error_code",
    lambda f: f.incoming.select("query_id", sc.error_code("raw_text").alias("code")),
    o.sql(f"SELECT query_id, {code_sql('raw_text')} AS code FROM incoming", "incoming"),
)
register(
    "f3_complexity",
    lambda f: f.conversations.select("conv_id", "turn", F.round(sc.complexity("text"), 6).alias("complexity")),
    f"SELECT conv_id, turn, round({complexity_sql('text')}, 6) AS complexity FROM conversations",
)
register(
    "f4_special_chars",
    lambda f: f.documents.select("doc_id", sc.special_chars("text").alias("n")),
    f"SELECT doc_id, {special_sql('text')} AS n FROM documents",
)


def rated(f):
    return (
        fb.with_stats(f.kb_texts, f.feedback)
        .withColumn("conflict", F.when(F.col("has_conflicts"), 0.4).otherwise(0.0))
        .withColumn("model", F.when(F.col("confidence_score") > 0.2, F.col("confidence_score")))
        .withColumn("anomaly", F.col("kb_id").cast("long") % 7 == 0)
        .withColumn("steps", F.size("resolution_steps") + F.col("kb_id").cast("long") % 4)
        .withColumn("days", F.col("kb_id").cast("long").cast("double"))
    )


o.define(
    "rated",
    """SELECT *, CASE WHEN has_conflicts THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS conflict,
    CASE WHEN confidence_score > 0.2 THEN confidence_score END AS model, CAST(kb_id AS BIGINT) % 7 = 0 AS anomaly,
    len(resolution_steps) + CAST(kb_id AS BIGINT) % 4 AS steps, CAST(kb_id AS DOUBLE) AS days FROM kbs""",
    ["kbs"],
)


def feedback_confidence_sql(rate, n, conflict):
    return f"""({rate} * (CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0::DOUBLE, {n} / 5.0::DOUBLE) END) * greatest(0.0::DOUBLE,
    CASE WHEN {conflict} > 0.3 THEN 1.0::DOUBLE - ({conflict} - 0.3) * 3 ELSE 1.0::DOUBLE - {conflict} * 2 END))"""


def unified_sql(base, n, conflict, model, sim_):
    parts = [(base, 0.4), (f"(CASE WHEN {n} > 0 THEN {feedback_confidence_sql(f'coalesce({base}, 0.5)', n, conflict)} END)", 0.3)]
    parts += [(p, w) for p, w in ((model, 0.2), (sim_, 0.1)) if p]
    top = " + ".join(f"coalesce({p} * {w}::DOUBLE, 0)" for p, w in parts)
    bottom = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE {w}::DOUBLE END" for p, w in parts)
    return f"(({top}) / ({bottom}))"


def modifiers_sql(x, n, anomaly, steps, days):
    a = f"(CASE WHEN {anomaly} THEN {x} * 0.8::DOUBLE ELSE {x} END)"
    b = f"(CASE WHEN {steps} > 4 AND {x} > 0.7 THEN least(0.95::DOUBLE, {a} * 1.1::DOUBLE) ELSE {a} END)"
    c = f"(CASE WHEN {days} > 365 THEN {b} * greatest(0.8::DOUBLE, 1.0::DOUBLE - ({days} - 365) / 1000.0::DOUBLE) ELSE {b} END)"
    d = f"(CASE WHEN {c} > 0.85 THEN CASE WHEN {n} < 10 THEN 0.85::DOUBLE ELSE least(0.99::DOUBLE, {c}) END ELSE {c} END)"
    return f"greatest(0.05::DOUBLE, least(0.99::DOUBLE, {d}))"


register(
    "f5_confidence",
    lambda f: rated(f).select("kb_id", F.round(sc.confidence("success_rate", "feedback_count", F.col("conflict")), 6).alias("confidence")),
    o.sql(f"SELECT kb_id, round({o.confidence('success_rate', 'feedback_count', 'conflict')}, 6) AS confidence FROM rated", "rated"),
)
register(
    "f6_feedback_confidence",
    lambda f: rated(f).select("kb_id", F.round(sc.feedback_confidence("success_rate", "feedback_count", "confidence_score"), 6).alias("confidence")),
    o.sql(f"SELECT kb_id, round({feedback_confidence_sql('success_rate', 'feedback_count', 'confidence_score')}, 6) AS confidence FROM rated", "rated"),
)
register(
    "f7_unified",
    lambda f: rated(f).select(
        "kb_id",
        F.round(sc.unified(F.col("raw_rate"), F.col("feedback_count"), F.col("conflict"), F.col("model"), F.col("confidence_score")), 6).alias("score"),
    ),
    o.sql(f"SELECT kb_id, round({unified_sql('raw_rate', 'feedback_count', 'conflict', 'model', 'confidence_score')}, 6) AS score FROM rated", "rated"),
)
register(
    "f8_modifiers",
    lambda f: rated(f).select(
        "kb_id",
        F.round(sc.modifiers(F.col("confidence_score"), F.col("feedback_count"), F.col("anomaly"), F.col("steps"), F.col("days")), 6).alias("score"),
    ),
    o.sql(f"SELECT kb_id, round({modifiers_sql('confidence_score', 'feedback_count', 'anomaly', 'steps', 'days')}, 6) AS score FROM rated", "rated"),
)
register(
    "f9_flags",
    lambda f: rated(f).select(
        "kb_id",
        sc.is_high_confidence("confidence_score", "feedback_count").alias("high_confidence"),
        sc.has_significant_conflicts("conflict").alias("conflicts"),
    ),
    o.sql("SELECT kb_id, confidence_score >= 0.85 AND feedback_count >= 5 AS high_confidence, conflict > 0.3 AS conflicts FROM rated", "rated"),
)
register(
    "f10_result_confidence",
    lambda f: rated(f).select(
        "kb_id",
        F.round(sc.result_confidence(F.col("success_rate"), F.col("feedback_count"), F.col("has_conflicts"),
                                     F.size(tx.split_steps("steps_text")), F.col("model"), F.col("anomaly")), 6).alias("confidence"),
    ),
    o.sql(
        f"""SELECT kb_id, round({modifiers_sql('u', 'feedback_count', 'anomaly', 'n_steps', '0')}, 6) AS confidence FROM (
        SELECT *, {unified_sql('success_rate', 'feedback_count', 'conflict', 'model', None)} AS u,
        CASE WHEN steps_text = '' THEN 0 WHEN starts_with(steps_text, '1.') THEN 3 ELSE 1 END AS n_steps FROM rated)""",
        "rated",
    ),
)
register(
    "f11_combine",
    lambda f: rated(f).select("kb_id", F.round(sc.combine(F.coalesce("raw_rate", F.lit(0.0)), "confidence_score", "conflict"), 6).alias("score")),
    o.sql(
        """SELECT kb_id, round(coalesce(list_avg(list_filter([coalesce(raw_rate, 0.0), confidence_score, conflict],
        lambda x: x > 0)), 0.5), 6) AS score FROM rated""",
        "rated",
    ),
)
register(
    "f12_vector_score",
    lambda f: rated(f).select("kb_id", F.round(sc.vector_score("success_rate", "confidence_score", "feedback_count"), 6).alias("score")),
    o.sql(
        """SELECT kb_id, round(success_rate + CASE WHEN confidence_score > 0.8 THEN 0.1::DOUBLE ELSE 0 END
        + least(0.1::DOUBLE, feedback_count * 0.01::DOUBLE), 6) AS score FROM rated""",
        "rated",
    ),
)
register(
    "f13_index_score",
    lambda f: rated(f).select("kb_id", F.round(sc.index_score("success_rate", "confidence_score"), 6).alias("score")),
    o.sql("SELECT kb_id, round(success_rate * (0.7::DOUBLE + confidence_score * 0.3::DOUBLE), 6) AS score FROM rated", "rated"),
)
register(
    "f14_fuzzy_total",
    lambda f: pairs(f).select(
        "pair_id",
        F.round(sc.fuzzy_total(sim.fuzzy_score("q", "t"), sim.ngram_similarity("q", "t"), F.col("t"), F.col("q")), 6).alias("total"),
    ),
    o.sql(
        f"""SELECT pair_id, round({o.fuzzy('lq', 'lt', 'qw', 'tw', 'ex')} + CASE WHEN contains(t, lq) THEN 0.3::DOUBLE ELSE 0 END
        + 0.2::DOUBLE * {o.jaccard('a', 'b')}, 6) AS total FROM (SELECT pair_id, t, lower(q) AS lq, lower(t) AS lt,
        {o.long_words('q')} AS qw, {o.long_words('t')} AS tw, {o.expand('q')} AS ex, {o.grams('q')} AS a, {o.grams('t')} AS b FROM pairs)""",
        "pairs",
    ),
)
register(
    "f15_tree_confidence",
    lambda f: f.kb_texts.select("kb_id", "confidence_score", *sc.features("error_text", "created_at")).select(
        "kb_id",
        F.round(sc.tree_confidence([F.col(n) / 100 for n in sc.FEATURE_NAMES], F.when(F.col("confidence_score") > 0.5, 1).otherwise(0)), 6).alias("confidence"),
    ),
    o.sql(
        f"""SELECT kb_id, round(greatest(0.3::DOUBLE, least(0.95::DOUBLE, tanh(({' + '.join(f'abs({n} / 100)' for n in sc.FEATURE_NAMES)}) / 18)
        * CASE WHEN confidence_score > 0.5 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END)), 6) AS confidence FROM (
        SELECT kb_id, confidence_score, {feature_columns_sql('error_text', 'created_at', 0)} FROM kb)""",
        "kb",
    ),
)


def _guidance(f):
    score, level, reasons = sc.guidance(
        sc.confidence("success_rate", "feedback_count", F.col("conflict")), F.col("steps"), F.col("has_conflicts"),
        F.col("feedback_count"), F.col("error_signature"), F.col("anomaly"), F.col("raw_rate") > 0.5, F.col("confidence_score"),
    )
    return rated(f).select("kb_id", score.alias("score"), level.alias("level"), reasons.alias("reasons"))


def guidance_sql(conf, steps, conflicts, n, text, anomaly, works, neural):
    cat = o.first_contained(text, fv.CATEGORIES, "general")
    rules = [
        (f"{conf} < 0.6", 2, "'low confidence solution'"), (f"{steps} >= 4", 1, "'complex multi-step solution'"),
        (anomaly, 2, "'unusual error pattern detected'"), (conflicts, 1, "'conflicting solution feedback exists'"),
        (f"{n} = 0", 1, "'unvalidated solution'"),
        (f"{cat} IN ('network', 'security', 'performance')", 1, f"{cat} || ' issues often need diagnostic steps'"),
        (f"(NOT {works} AND {neural} > 0.7)", 2, "'ML predicts solution may not work'"),
    ]
    score = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p, _ in rules)
    reasons = "concat_ws(', ', " + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, _, r in rules) + ")"
    return score, reasons


LEVELS = "CASE WHEN score >= 4 THEN 'auto' WHEN score >= 2 THEN 'recommended' WHEN score >= 1 THEN 'available' ELSE 'none' END"
_score, _reasons = guidance_sql(
    o.confidence("success_rate", "feedback_count", "conflict"), "steps", "has_conflicts", "feedback_count",
    "error_signature", "anomaly", "(raw_rate > 0.5)", "confidence_score",
)
register(
    "f16_guidance",
    _guidance,
    o.sql(f"SELECT kb_id, score, {LEVELS} AS level, reasons FROM (SELECT kb_id, {_score} AS score, {_reasons} AS reasons FROM rated)", "rated"),
)
