"""Substring candidate joins without pairing everything with everything.

A keyword consists of ``[a-z0-9-]`` only, so wherever it occurs in a text it
lies inside one run of those characters.  The joins therefore work on the
vocabulary of such runs: keyword to run through the keyword's rarest 4-gram,
run to rows through an inverted list.  Candidate lists are ordered by columns
of the knowledge row alone, hence the best ``k`` of a union are among the best
``k`` of its parts and every list is cut to ``k`` before it is joined on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import text as tx
from faultmatch.operators.ranking import salted_join, top_k
from faultmatch.session import cut


def by_rate() -> list[Column]:
    """Raw rate first, unrated rows last, then the newest."""
    return [
        F.col("raw_rate").desc_nulls_last(), F.col("created_at").desc(), F.col("error_hash").asc(), F.col("kb_id").asc(),
    ]


def by_newest() -> list[Column]:
    return [F.col("created_at").desc(), F.col("error_hash").asc(), F.col("kb_id").asc()]


def runs(cols: Sequence[str]) -> Column:
    """Distinct keyword-character runs of the lower-cased columns."""
    found = [
        F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(fv.TOKEN_PATTERN), F.lit(0)) for c in cols
    ]
    return F.array_distinct(F.concat(*found))


def grams(c: str, n: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)))


def contained_words(needles: DataFrame, vocabulary: DataFrame, n: int = 4) -> DataFrame:
    """Pairs (token, word) of distinct tokens and the vocabulary words that contain them.

    Tokens are matched on their rarest ``n``-gram; shorter tokens on themselves.
    """
    sizes = range(1, n + 1)
    word_grams = vocabulary.select("word", F.explode(grams("word", n)).alias("gram"))
    short = needles.select(F.length("token").alias("size")).filter(F.col("size") < n).distinct()
    for size in sizes[:-1]:
        # only the gram lengths that some short token needs
        needed = F.broadcast(short.filter(F.col("size") == size))
        extra = vocabulary.select("word", F.lit(size).alias("size")).join(needed, "size", "left_semi")
        word_grams = word_grams.unionByName(extra.select("word", F.explode(grams("word", size)).alias("gram")))
    return _match_on_rarest(needles, word_grams, n)


def _match_on_rarest(needles: DataFrame, word_grams: DataFrame, n: int) -> DataFrame:
    frequency = word_grams.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("token") >= n, grams("token", n)).otherwise(F.array("token"))
    rarest = (
        needles.select("token", F.explode(own).alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy("token")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
        .filter(F.col("best.n") > 0)
        .select("token", F.col("best.gram").alias("gram"))
    )
    return rarest.join(word_grams, "gram").filter(F.contains("word", "token")).select("token", "word")


def keyword_words(needles: DataFrame, vocabulary: DataFrame, n: int = 4) -> DataFrame:
    """As ``contained_words`` for keywords, which never are shorter than a gram."""
    return _match_on_rarest(
        needles, vocabulary.select("word", F.explode(grams("word", n)).alias("gram")), n
    )


def keyword_top_rows(needles: DataFrame, kb: DataFrame, cols: Sequence[str], order: list[Column], k: int) -> DataFrame:
    """Best ``k`` rows per distinct keyword: (token, kb_id, order columns)."""
    slim = kb.select("kb_id", "error_hash", "created_at", "raw_rate", F.explode(runs(cols)).alias("word"))
    per_word = top_k(slim, ["word"], order, k)
    pairs = keyword_words(needles, per_word.select("word").distinct())
    rows = pairs.join(per_word, "word").drop("word").dropDuplicates(["token", "kb_id"])
    return top_k(rows, ["token"], order, k)


def term_key(tokens: Column | str) -> Column:
    return F.array_join(tx.col(tokens), " ")


def any_token(terms: DataFrame, kb: DataFrame, cols: Sequence[str], order: list[Column], k: int) -> DataFrame:
    """Best ``k`` knowledge rows that contain ANY token, per distinct token list.

    ``terms`` has a ``tokens`` array; the result is keyed by ``terms_key``.
    """
    lists = terms.select("tokens").filter(F.size("tokens") > 0).withColumn("terms_key", term_key("tokens"))
    lists = lists.dropDuplicates(["terms_key"])
    exploded = lists.select("terms_key", F.explode("tokens").alias("token"))
    rows = keyword_top_rows(exploded.select("token").distinct(), kb, cols, order, k)
    hits = salted_join(exploded, rows, ["token"], "terms_key").drop("token").dropDuplicates(["terms_key", "kb_id"])
    return top_k(hits, ["terms_key"], order, k, "rank")


def token_rows(needles: DataFrame, kb: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairs (token, kb_id); as many as the knowledge rows have matching words."""
    words = kb.select("kb_id", F.explode(runs(cols)).alias("word"))
    pairs = keyword_words(needles, words.select("word").distinct())
    return words.join(pairs, "word").select("token", "kb_id").distinct()


def token_frequency(needles: DataFrame, kb: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Knowledge rows with each token; rows of equal texts are looked at once."""
    classes = kb.groupBy(*cols).agg(F.count("*").alias("n"))
    classes = cut(classes.withColumn("kb_id", tx.fingerprint(F.to_json(F.struct(*cols)))))
    hits = token_rows(needles, classes, cols).join(classes.select("kb_id", "n"), "kb_id")
    return hits.groupBy("token").agg(F.sum("n").alias("n_rows"))


def all_tokens(terms: DataFrame, kb: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Best ``k`` knowledge rows whose signature contains ALL tokens, per distinct token list.

    Rows of one signature behave alike, so each signature enters with its own
    best ``k`` rows; the rarest token of a list proposes, the rest verify.
    """
    lists = terms.select("tokens").filter(F.size("tokens") > 0).withColumn("terms_key", term_key("tokens"))
    lists = lists.dropDuplicates(["terms_key"])
    slim = kb.select("kb_id", "error_hash", "error_signature", "created_at", "raw_rate")
    classes = slim.select("error_hash", "error_signature").dropDuplicates(["error_hash"]).select(
        F.col("error_hash").alias("kb_id"), "error_signature"
    )
    exploded = lists.select("terms_key", "tokens", F.explode("tokens").alias("token"))
    hits = token_rows(exploded.select("token").distinct(), classes, ["error_signature"])
    frequency = hits.groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        exploded.join(frequency, "token", "left")
        .groupBy("terms_key", "tokens")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
        .filter(F.col("best.n") > 0)
        .select("terms_key", "tokens", F.col("best.token").alias("token"))
    )
    matched = (
        rarest.join(hits, "token")
        .join(classes, "kb_id")
        .filter(F.forall("tokens", lambda t: F.contains(F.col("error_signature"), t)))
        .select("terms_key", F.col("kb_id").alias("error_hash"))
    )
    best_rows = top_k(slim.drop("error_signature"), ["error_hash"], order, k)
    return top_k(matched.join(best_rows, "error_hash"), ["terms_key"], order, k, "rank")


def containing(texts: DataFrame, kb: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Best ``k`` knowledge rows whose signature or text contains the whole lower-cased query text.

    ``texts`` has a non-blank ``needle``.  Its inner words must occur as whole
    words, its first word must end one and its last word must begin one; whichever
    of them fits the fewest rows proposes, the whole text verifies.  Equal
    knowledge texts enter once with their best rows.
    """
    parts = F.split("needle", " ")
    n = F.size(parts)

    def anchor(kind: str, token: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), token.alias("token"))

    inner = F.transform(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), lambda w: anchor("inner", w))
    ends = F.array(anchor("first", parts[0]), anchor("last", F.element_at(parts, -1)))
    anchors = F.when(n == 1, F.array(anchor("any", parts[0]))).otherwise(F.concat(ends, inner))
    wanted = (
        texts.select("needle").distinct()
        .select("needle", F.explode(F.array_distinct(anchors)).alias("a"))
        .select("needle", "a.kind", "a.token")
        .filter(F.col("token") != "")
    )

    rows = kb.withColumn("sig", F.lower("error_signature")).withColumn("txt", F.lower("error_text"))
    # never null, and says so: a join on it need not look for nulls below the spread of small files
    rows = rows.withColumn("class", tx.fingerprint(F.concat_ws("\n", "sig", "txt")))
    classes = cut(rows.select("class", "sig", "txt").dropDuplicates(["class"]))
    words = classes.select(
        "class", F.explode(F.array_distinct(F.concat(F.split("sig", " "), F.split("txt", " ")))).alias("word")
    ).filter(F.col("word") != "")
    frequency = words.groupBy("word").agg(F.count("*").alias("n"))

    tokens = wanted.select("kind", "token").distinct()
    whole = tokens.filter("kind = 'inner'").join(frequency.withColumn("token", F.col("word")), "token")
    edge = tokens.filter("kind <> 'inner'")
    fits = (
        (F.col("kind") == "any")
        | ((F.col("kind") == "first") & F.endswith("word", "token"))
        | ((F.col("kind") == "last") & F.startswith("word", "token"))
    )
    inside = contained_words(edge.select("token").distinct(), frequency.select("word"), 3)
    partial = edge.join(inside, "token").filter(fits).join(frequency, "word")
    fitting = whole.select("kind", "token", "word", "n").unionByName(partial.select("kind", "token", "word", "n"))
    weight = fitting.groupBy("kind", "token").agg(F.sum("n").alias("n"))
    chosen = (
        wanted.join(weight, ["kind", "token"], "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kind", "token")).alias("best"))
        .filter(F.col("best.n") > 0)
        .select("needle", "best.kind", "best.token")
    )
    hits = (
        chosen.join(fitting.drop("n"), ["kind", "token"])
        .join(words, "word")
        .select("needle", "class")
        .distinct()
        .join(classes, "class")
        .filter(F.contains("sig", "needle") | F.contains("txt", "needle"))
        .select("needle", "class")
    )
    best_rows = top_k(rows.drop("sig", "txt"), ["class"], order, k)
    return top_k(hits.join(best_rows, "class").drop("class"), ["needle"], order, k, "rank")


def near_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Word match value of every (word, target) that is equal (0.9) or more than 0.8 similar (0.7 of it).

    With a length of at most five such words are equal.  From six on, fewer edits
    than a fifth of the length leave a common trigram, so the vocabularies meet on
    trigrams instead of pairwise.
    """
    equal = words.join(vocabulary.withColumn("word", F.col("target")), "word").select(
        "word", "target", F.lit(0.9).alias("value")
    )
    a = words.select("word", F.explode(grams("word", 3)).alias("gram"))
    b = vocabulary.select("target", F.explode(grams("target", 3)).alias("gram"))
    longest = F.greatest(F.length("word"), F.length("target"))
    gap = F.abs(F.length("word") - F.length("target"))
    close = (longest > 5) & (gap * 5 < longest) & (F.col("word") != F.col("target"))
    pairs = a.join(b, "gram").filter(close).select("word", "target").distinct()
    likeness = pairs.withColumn("s", 1.0 - F.levenshtein("word", "target") / longest)
    return equal.unionByName(likeness.filter(F.col("s") > 0.8).select("word", "target", (F.col("s") * 0.7).alias("value")))
