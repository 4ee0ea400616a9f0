"""The match layers and the cascade over a table of incoming errors.

A layer takes ``queries`` (query_id, clean_text, signature, error_hash and, for
vector layers, embedding) and rated knowledge rows, and returns at most one row
per query with the columns of ``RESULT``.  Text layers score distinct texts and
join the answer back, so a flood of one message is scored once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, similarity as sim, text as tx
from faultmatch.operators import audit, best_match as bm, candidates as ca, feedback as fb, ngram_join as ng, rules as ru, vectors as ve
from faultmatch.operators.ranking import salted_join, top_k
from faultmatch.session import cut

RESULT = [
    "query_id", "source", "error_hash", "steps_text", "confidence", "success_rate",
    "feedback_count", "has_conflicts", "version",
]


def _result(df: DataFrame, source: str, confidence: Column, version: str | None = "1.0", conflicts: Column | None = None) -> DataFrame:
    return df.select(
        "query_id",
        F.lit(source).alias("source"),
        "error_hash",
        tx.steps_text("resolution_steps").alias("steps_text"),
        confidence.alias("confidence"),
        "success_rate",
        F.col("feedback_count").cast("long").alias("feedback_count"),
        (F.lit(False) if conflicts is None else conflicts).alias("has_conflicts"),
        F.lit(version).cast("string").alias("version"),
    )


def _only(kb: DataFrame, ids: DataFrame) -> DataFrame:
    """Knowledge rows some candidate list refers to."""
    return kb.join(ids.select("kb_id").distinct(), "kb_id", "left_semi")


# --- layers -----------------------------------------------------------------------


def exact_match(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Newest knowledge row of the same fingerprint."""
    wanted = kb.join(queries.select("error_hash").distinct(), "error_hash", "left_semi")
    newest = top_k(wanted, ["error_hash"], [F.col("created_at").desc(), F.col("kb_id").asc()], 1)
    hits = queries.select("query_id", "error_hash").join(newest, "error_hash")
    conflict = F.when(F.col("has_conflicts"), 0.4).otherwise(0.0)
    return _result(
        hits, "exact_match", sc.confidence("success_rate", "feedback_count", conflict), conflicts=F.col("has_conflicts")
    )


def _texts(queries: DataFrame, column: str, **more: Column) -> DataFrame:
    """``text_id, text``: distinct texts of a column, numbered, and what ``more`` says of each.

    They are cut, so that a condition on ``more`` is neither moved below the distinct texts nor asked of the queries they are joined to.
    """
    texts = queries.select(F.col(column).alias("text")).filter(F.col("text").isNotNull()).distinct()
    return cut(texts.withColumn("text_id", F.monotonically_increasing_id()).withColumns(more))


def _with_keywords(queries: DataFrame, column: str) -> DataFrame:
    """Distinct texts that have keywords, their own or those of their synonyms."""
    return _texts(queries, column, tokens=tx.tokens(F.array_join(sim.expand("text"), " "))).filter(F.size("tokens") > 0)


def _has_keyword(column: str) -> Column:
    return F.exists("tokens", lambda t: F.contains(F.col(f"low_{column}"), t))


def _rows_with_keywords(column: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """All rows that hold a keyword of a text, for texts that need not share a word with their best row."""

    def pairs(texts: DataFrame, rows: DataFrame) -> DataFrame:
        asked = texts.select("text_id", F.explode("tokens").alias("token"))
        return asked.join(ca.token_rows(asked.select("token").distinct(), rows, [column]), "token").select("text_id", "kb_id")

    return pairs


def _answers(queries: DataFrame, column: str, texts: DataFrame, best: DataFrame, kb: DataFrame) -> DataFrame:
    """Best rows of texts, handed to every query that has the text."""
    found = cut(texts.select("text_id", F.col("text").alias(column)).join(best, "text_id"))
    rows = kb.select("kb_id", "error_hash", "resolution_steps", "success_rate", "feedback_count").join(
        found.select("kb_id").distinct(), "kb_id", "left_semi"
    )
    return queries.select("query_id", column).join(found.join(rows, "kb_id"), column)


def keyword_match(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Best combined score above 0.4 among all rows whose signature holds a keyword of any expansion; ties by rate."""
    texts = _with_keywords(queries, "signature")
    rows = kb.select(
        "kb_id", "error_hash", "error_signature", "error_text", "raw_rate", "created_at",
        F.when(F.col("success_rate") > 0.7, 0.2).otherwise(0.0).alias("bonus"),
    )
    score = bm.Score(
        (bm.Field("error_signature", 0.5, 0.3), bm.Field("error_text", 0.2, 0.0)), 0.4, lambda: _has_keyword("error_signature")
    )
    best = bm.best_match(texts, rows, score, ca.by_rate(), _rows_with_keywords("error_signature"))
    found = _answers(queries, "signature", texts, best, kb)
    return _result(found, "enhanced_fuzzy_keyword", F.least(F.lit(0.95), F.col("score")))


def fuzzy_match(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Best mixed text and signature similarity above 0.5 among all rows whose text holds a keyword; ties by age."""
    texts = _with_keywords(queries, "clean_text")
    rows = kb.select(
        "kb_id", "error_hash", "error_signature", "error_text", "created_at",
        (F.col("success_rate") * F.least(F.lit(1.0), F.col("feedback_count") / 10.0) * 0.2).alias("bonus"),
    )
    score = bm.Score(
        (bm.Field("error_text", 0.6 * 0.7, 0.4 * 0.7), bm.Field("error_signature", 0.6 * 0.3, 0.4 * 0.3)), 0.5,
        lambda: _has_keyword("error_text"),
    )
    best = bm.best_match(texts, rows, score, ca.by_newest(), _rows_with_keywords("error_text"))
    found = _answers(queries, "clean_text", texts, best, kb)
    return _result(found, "enhanced_fuzzy_search", F.least(F.lit(0.95), F.col("score")))


def _index_rows(queries: DataFrame, kb: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    indexed = vectors.select("kb_id", "embedding").join(kb.select("kb_id", "error_hash", "confidence_score"), "kb_id")
    found = ve.bucket_matches(queries.select("query_id", "embedding"), indexed, limit)
    rows = kb.select("kb_id", "resolution_steps", "feedback_count").join(
        found.select("kb_id").distinct(), "kb_id", "left_semi"
    )
    return found.join(rows, "kb_id").withColumn("success_rate", F.col("confidence_score"))


def index_match(queries: DataFrame, kb: DataFrame, vectors: DataFrame) -> DataFrame:
    """Bucket index search, best of ten by the feedback-aware vector score."""
    rows = _index_rows(queries, kb, vectors, fv.INDEX_LIMIT)
    score = F.round(sc.vector_score("similarity", "confidence_score", "feedback_count"), 9)
    best = top_k(rows, ["query_id"], [score.desc(), F.col("rank")], 1)
    confidence = F.least(F.lit(0.95), F.col("similarity") + F.col("confidence_score") * 0.2)
    return _result(best, "advanced_scalable_vector", confidence, "2.0")


def secure_vector_match(queries: DataFrame, kb: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index search behind the strict input check, nearest of five."""
    checked = audit.validate(queries, strict=True).filter("is_valid")
    rows = _index_rows(checked, kb, vectors, fv.INDEX_LIMIT_SECURE)
    best = top_k(rows, ["query_id"], [F.round("similarity", 9).desc(), F.col("rank")], 1)
    return _result(best, "secure_scalable_vector", F.col("similarity"), "Secure-2.0")


def vector_fuzzy_match(queries: DataFrame, kb: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector and fuzzy similarity weighted by confidence, over all rows near enough that hold a keyword in either column.

    Vectors stay where the exact join places them: only ids and cosines come
    back.  A query without keywords sees all rows near enough.  The fuzzy
    part is worked out for pairs that can still be best without knowing it.
    """
    asked = queries.filter(F.size("embedding") > 0)
    pairs = ve.vector_join(asked.select("query_id", "embedding"), vectors, fv.VECTOR_MIN_COSINE)
    texts = asked.select(
        "query_id", "clean_text", tx.tokens(F.array_join(sim.expand("clean_text"), " ")).alias("tokens"),
    )
    trust = sc.confidence("success_rate", "feedback_count", F.when(F.col("has_conflicts"), 0.4).otherwise(0.1))
    rows = _only(kb, pairs).select(
        "kb_id", "error_hash", "created_at", "error_text", F.lower("error_signature").alias("low_signature"),
        F.lower("error_text").alias("low_text"), "resolution_steps", "success_rate", "feedback_count", "has_conflicts", trust.alias("trust"),
    )
    holds = F.exists("tokens", lambda t: F.contains("low_signature", t) | F.contains("low_text", t))
    near = pairs.join(texts, "query_id").join(rows, "kb_id").filter((F.size("tokens") == 0) | holds)
    weight = 0.6 + F.col("trust") * 0.4
    near = near.withColumn("least", F.col("similarity") * 0.7 * weight)
    lead = F.max("least").over(Window.partitionBy("query_id"))
    close = near.withColumn("lead", lead).filter(F.col("least") + 0.3 * weight >= F.col("lead") - 1e-6)
    score = (F.col("similarity") * 0.7 + sim.fuzzy_score("clean_text", "error_text") * 0.3) * weight
    best = top_k(close.withColumn("score", F.round(score, 9)), ["query_id"], [F.col("score").desc(), *ca.by_newest()], 1)
    return _result(best, "enhanced_vector_fuzzy", F.col("trust"), None, conflicts=F.col("has_conflicts"))


def pattern_match(queries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rule with the highest priority, then effectiveness."""
    order = [F.col("priority").desc(), F.col("effectiveness_score").desc_nulls_last(), F.col("pattern_id").asc()]
    best = top_k(ru.pattern_hits(queries, patterns), ["signature"], order, 1)
    effectiveness = F.coalesce("effectiveness_score", F.lit(0.5))
    uses = F.coalesce("usage_count", F.lit(0))
    rows = (
        queries.select("query_id", "signature").join(best, "signature")
        .withColumn("resolution_steps", tx.non_blank_lines("steps_text"))
        .withColumn("error_hash", tx.fingerprint(tx.steps_text("resolution_steps")))
        .withColumn("success_rate", effectiveness)
        .withColumn("feedback_count", uses)
    )
    return _result(rows, "pattern_match", F.least(F.lit(0.9), F.col("success_rate") + F.col("feedback_count") * 0.01))


def strict_keyword_match(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Best rated row whose signature holds every keyword."""
    terms = queries.select("query_id", tx.tokens("signature").alias("tokens")).withColumn(
        "terms_key", ca.term_key("tokens")
    )
    hits = ca.all_tokens(terms, kb, ca.by_rate(), 1).select("terms_key", "kb_id")
    rows = hits.join(
        _only(kb, hits).select("kb_id", "error_hash", "resolution_steps", "success_rate", "feedback_count"), "kb_id"
    )
    return _result(
        terms.select("query_id", "terms_key").join(rows, "terms_key"),
        "keyword_match", sc.confidence("success_rate", "feedback_count", 0.0),
    )


def _fragment_rows(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that hold a text without a whole word inside it, and rows of which half the grams are those of a single word."""
    fragments = bm.without_inner_word(texts).select("text_id", F.col("low").alias("needle"))
    single = texts.filter("size(q_words) <= 1").select("text_id", F.col("text").alias("left_text"))
    found = fragments.select("text_id", F.lit("").alias("kb_id")).limit(0)
    if not fragments.isEmpty():
        holding = ca.containing(fragments, rows.withColumn("error_signature", F.col("error_text")), [F.col("kb_id")], None)
        found = found.unionByName(fragments.join(holding, "needle").select("text_id", "kb_id"))
    if not single.isEmpty():
        alike = ng.ngram_join(single.select(F.col("left_text").alias("text")), rows.select(F.col("error_text").alias("text")), 0.5)
        named = rows.select("kb_id", F.col("error_text").alias("right_text"))
        found = found.unionByName(alike.join(single, "left_text").join(named, "right_text").select("text_id", "kb_id"))
    return found


def simple_fuzzy_match(queries: DataFrame, kb: DataFrame) -> DataFrame:
    """Best fuzzy total above 0.6 among all rows, ties by age.

    A row without any of a text's words can only win if the text is a fragment:
    with no whole word inside it, or a single word, of which the row then has half the grams.
    """
    texts = _texts(queries.filter(~tx.is_blank("clean_text")), "clean_text")
    rows = kb.select("kb_id", "error_hash", "error_text", "created_at", F.lit(0.0).alias("bonus"))
    score = bm.Score(
        (bm.Field("error_text", 1.0, 0.2),), 0.6,
        lambda: (F.round("fuzzy_error_text", 9) > 0.5) | (F.col("overlap_error_text") > 0.4),
        0.3, lambda: F.contains("error_text", F.col("low")),
    )
    best = bm.best_match(texts, rows, score, ca.by_newest(), _fragment_rows)
    found = _answers(queries, "clean_text", texts, best, kb.withColumn("success_rate", F.lit(0.0)).withColumn("feedback_count", F.lit(0)))
    return _result(found, "fuzzy_search", F.least(F.lit(0.95), F.col("score")))


# --- cascade ----------------------------------------------------------------------


def prepare(checked: DataFrame) -> DataFrame:
    """Accepted rows with signature and fingerprint of their clean text."""
    return (
        checked.filter("is_valid")
        .withColumn("signature", tx.normalize("clean_text"))
        .withColumn("error_hash", tx.fingerprint("signature"))
    )


def cascade(
    checked: DataFrame,
    kb: DataFrame,
    vectors: DataFrame,
    feedback: DataFrame,
    patterns: DataFrame,
    query_vectors: DataFrame,
    learned: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """First layer that answers wins; one row per checked query.

    Each layer sees only what earlier layers missed.  The misses are cut to the
    shared folder between layers, which keeps plans short and survives the loss
    of executors.  ``learned`` adds a model layer over (query_id, clean_text,
    error_hash, ts).
    """
    # every layer reads the rated rows: signatures, hashes and statistics are worked out once
    rated = cut(fb.join_stats(kb, fb.solution_stats(feedback)))
    left = cut(prepare(checked).select("query_id", "clean_text", "signature", "error_hash", "ts"))
    answered: list[DataFrame] = []

    def with_vector(rows: DataFrame) -> DataFrame:
        return rows.join(query_vectors.select("query_id", "embedding"), "query_id")

    layers: list[tuple[int, Callable[[DataFrame], DataFrame]]] = [
        (1, lambda q: exact_match(q, rated)),
        (2, lambda q: keyword_match(q, rated)),
        (3, lambda q: fuzzy_match(q, rated)),
        (4, lambda q: index_match(with_vector(q), rated, vectors)),
        (4, lambda q: vector_fuzzy_match(with_vector(q), rated, vectors)),
        (5, lambda q: pattern_match(q, patterns)),
    ]
    if learned is not None:
        layers.append((6, learned))
    for number, layer in layers:
        found = cut(layer(left).withColumn("layer", F.lit(number)))
        answered.append(found)
        left = cut(left.join(found.select("query_id"), "query_id", "left_anti"))

    results = answered[0]
    for more in answered[1:]:
        results = results.unionByName(more)
    rows = checked.select("query_id", "verdict", "is_valid").join(results, "query_id", "left")
    status = (
        F.when(~F.col("is_valid"), "blocked")
        .when(F.col("layer").isNull() | tx.is_blank("steps_text"), "no_match")
        .otherwise("matched")
    )
    return rows.withColumn("status", status)


# --- selection and reporting --------------------------------------------------------


def enhance(results: DataFrame, insights: DataFrame) -> DataFrame:
    """Confidence of layers 1, 2, 3 and 5 recomputed with the query's insights.

    ``insights``: query_id, is_anomaly, neural_works, neural_confidence.
    """
    rows = results.join(insights, "query_id", "left")
    changed = sc.result_confidence(
        F.col("success_rate"), F.col("feedback_count"), F.col("has_conflicts"),
        F.size(tx.split_steps("steps_text")), F.col("neural_confidence"), F.coalesce("is_anomaly", F.lit(False)),
    )
    use = F.col("layer").isin(1, 2, 3, 5) & ~tx.is_blank("steps_text") & F.col("is_anomaly").isNotNull()
    return rows.withColumn("confidence", F.when(use, changed).otherwise(F.col("confidence")))


def select_best(results: DataFrame, insights: DataFrame | None = None, minimum: float | None = None) -> DataFrame:
    """Best result per query by confidence, rate and count; results without steps do not count.

    With ``insights`` the confidence first gains 0.1 for a confident positive
    prediction and loses 0.05 for an anomaly.  ``minimum`` drops weak winners.
    """
    rows = results.filter(~tx.is_blank("steps_text"))
    if insights is not None:
        sure = F.coalesce(F.col("neural_works") & (F.col("neural_confidence") > 0.7), F.lit(False))
        odd = F.coalesce(F.col("is_anomaly"), F.lit(False))
        bonus = F.when(sure, 0.1).otherwise(0.0) - F.when(odd, 0.05).otherwise(0.0)
        rows = (
            rows.join(insights, "query_id", "left")
            .withColumn("confidence", F.col("confidence") + bonus)
            .drop(*[c for c in insights.columns if c != "query_id"])
        )
    order = [
        F.round("confidence", 9).desc(), F.round("success_rate", 9).desc(), F.col("feedback_count").desc(),
        F.col("source").asc(), F.col("error_hash").asc(),
    ]
    best = top_k(rows, ["query_id"], order, 1)
    return best if minimum is None else best.filter(F.round("confidence", 9) >= minimum)


def suggestions(queries: DataFrame, kb: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """Alternative terms and partly similar signatures for unanswered texts.

    ``insights`` (query_id, is_anomaly, cluster_template, cluster_confidence) add a
    warning for an unusual error and, if confident, the template of its cluster.
    """
    texts = queries.select("clean_text").distinct().withColumn("terms", sim.expand("clean_text"))
    lower = F.lower("clean_text")
    others = F.filter(F.slice("terms", 1, 3), lambda t: t != lower)
    first = F.try_element_at(tx.tokens("clean_text"), F.lit(1))
    texts = texts.withColumn(
        "alternatives", F.when(F.size("terms") > 1, F.array_join(others, ", ")).otherwise("")
    ).withColumn("prefix", F.substring(first, 1, 4))

    wanted = texts.select(F.col("prefix").alias("gram")).filter(F.col("gram").isNotNull()).distinct()
    grams = kb.select("error_signature").distinct().select(
        "error_signature", F.explode(ca.grams("error_signature", 4)).alias("gram")
    )
    few = top_k(grams.join(wanted, "gram", "left_semi"), ["gram"], [F.col("error_signature").asc()], fv.SUGGESTION_ROWS, "n")
    close = sim.ngram_similarity("clean_text", "error_signature")
    short = F.when(
        F.length("error_signature") > 60, F.concat(F.substring("error_signature", 1, 57), F.lit("..."))
    ).otherwise(F.col("error_signature"))
    similar = (
        salted_join(texts.select("clean_text", F.col("prefix").alias("gram")), few, ["gram"], "clean_text")
        .withColumn("close", F.round(close, 9))
        .filter((F.col("close") > 0.3) & (F.col("close") < 0.7))
        .groupBy("clean_text")
        .agg(F.sort_array(F.collect_list(F.struct("n", short.alias("line")))).alias("rows"))
        .select("clean_text", F.array_join(F.transform(F.slice("rows", 1, 2), lambda r: r["line"]), "; ").alias("similar_errors"))
    )
    found = texts.join(similar, "clean_text", "left").select(
        "clean_text", "alternatives", F.coalesce("similar_errors", F.lit("")).alias("similar_errors")
    )
    out = queries.select("query_id", "clean_text").join(found, "clean_text").drop("clean_text")
    if insights is None:
        return out
    sure = (F.col("cluster_confidence") > fv.TEMPLATE_SHOWN) & (F.col("cluster_template") != "")
    extra = insights.select(
        "query_id",
        F.when(F.col("is_anomaly"), fv.UNUSUAL_WARNING).alias("warning"),
        F.when(sure, F.concat(F.lit(fv.TEMPLATE_INTRO), "cluster_template")).alias("template"),
    )
    return out.join(extra, "query_id", "left").fillna("", ["warning", "template"])


def context_rows(queries: DataFrame, kb: DataFrame, feedback: DataFrame, limit: int | None = None) -> DataFrame:
    """Related solved cases per text, proven ones flagged, as one list; all of them, or the best ``limit``."""
    rated = fb.join_stats(kb, fb.proven_rates(feedback).withColumn("conflict_rate", F.lit(None).cast("double")))
    order = [F.round("success_rate", 9).desc(), F.col("created_at").desc(), F.col("error_hash"), F.col("kb_id")]
    texts = queries.filter(~tx.is_blank("raw_text")).select("query_id", F.lower("raw_text").alias("needle"))
    hits = ca.containing(texts, rated, order, limit)
    line = F.concat(
        F.col("error_signature"),
        F.when(F.col("success_rate") > fv.PROVEN_RATE, " (Proven high success rate)").otherwise(""),
        F.lit(" => "), F.array_join("resolution_steps", " / "),
    )
    lists = (
        hits.groupBy("needle")
        .agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
        .select("needle", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("context"))
    )
    return texts.join(lists, "needle").drop("needle")


def report(results: DataFrame, insights: DataFrame, texts: DataFrame) -> DataFrame:
    """Outcome per query: level, labels, insight text and guidance.

    ``texts``: query_id, clean_text.  ``insights`` has the columns of ``enhance`` and
    trend_category, trend_predicted, trend_confidence.
    """
    rows = select_best(enhance(results, insights).select(*results.columns), insights)
    rows = rows.join(insights, "query_id", "left").join(texts.select("query_id", "clean_text"), "query_id")
    odd = F.coalesce("is_anomaly", F.lit(False))
    score, level, reasons = sc.guidance(
        F.col("confidence"), F.size(tx.split_steps("steps_text")), F.col("has_conflicts"), F.col("feedback_count"),
        F.col("clean_text"), odd, F.col("neural_works"), F.col("neural_confidence"),
    )
    headline = F.concat(
        F.lit("Confidence: "), tx.confidence_level("confidence"), F.lit(" ("), tx.percent(F.col("confidence")),
        F.lit(") | Success Rate: "), tx.percent(F.col("success_rate")),
        F.lit(" | Based on "), F.col("feedback_count").cast("string"), F.lit(" user ratings"),
        F.when(F.col("has_conflicts"), " Some users reported mixed results.").otherwise(""),
        tx.label_of("source", fv.CONFIDENCE_ADDENDA, ""),
        F.when(odd, " Anomalous error - exercise caution").otherwise(""),
        F.when(
            F.col("neural_confidence") > fv.NEURAL_ADDENDUM_SHOWN,
            F.concat(F.lit(fv.NEURAL_ADDENDUM[0]), tx.percent(F.col("neural_confidence")), F.lit(fv.NEURAL_ADDENDUM[1])),
        ).otherwise(""),
    )
    trend = F.when(
        F.col("trend_confidence") > fv.TREND_SHOWN,
        F.concat(
            F.lit(fv.TREND_TEXT[0]), "trend_category", F.lit(fv.TREND_TEXT[1]),
            F.round("trend_predicted").cast("long").cast("string"), F.lit(fv.TREND_TEXT[2]),
        ),
    )
    neural = F.when(
        F.col("neural_confidence") > 0.7,
        F.concat(
            F.lit("Solutions for this error are "),
            F.when(F.col("neural_works"), "likely to work").otherwise("may need alternatives"),
            F.lit(" (confidence: "), tx.percent(F.col("neural_confidence")), F.lit(")"),
        ),
    )
    return rows.select(
        "query_id", "layer", "source", F.round("confidence", 6).alias("confidence"), headline.alias("headline"),
        tx.label_of("source", fv.FOUND_TEXTS, fv.FOUND_DEFAULT).alias("found"),
        tx.label_of("source", fv.METHOD_INSIGHTS, fv.METHOD_INSIGHT_DEFAULT).alias("method"),
        F.concat_ws("; ", F.when(odd, "This error pattern is unusual"), trend, neural).alias("insight"),
        score.alias("guidance_score"), level.alias("guidance"), reasons.alias("reasons"),
    )
