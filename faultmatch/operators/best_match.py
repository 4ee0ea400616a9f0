"""The best knowledge row of every text under a word and gram score, over all rows.

The score of a pair is a sum over the row's fields of weighted fuzzy word scores and
gram overlaps, and a bonus of the row.  No list of candidates is cut.  Instead, as
the score is a sum, bounds decide which rows can still win:

1. Word likeness.  Every word of the texts meets every word of the rows once;
   pairs of words that are equal or much alike keep their value.  Scores of texts
   are sums over that table.
2. Seeds.  Of the rows of a text's rarest words, the most promising are scored.
   Their best score is a lower bound for the winner.
3. Search.  A row that beats the bound needs a certain word sum.  In the order of rarity, the
   words from some place on cannot reach it any more, so the row has one of the
   words before.  Only those lists are joined.  Rows with a large bonus need less;
   they are searched level by level.
4. Proof.  The number of common words bounds the fuzzy part of a pair, and parity
   bitmaps of the grams bound their overlap; pairs that may win are scored in full.

Rows that hold the whole text are found on its rarest inner word.  Texts that
need no word at all to win go to ``loose``, which proposes their rows otherwise.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch.functions import similarity as sim
from faultmatch.operators import candidates as ca
from faultmatch.operators.ranking import top_k
from faultmatch.session import cut

#: Rows of a word that may be seeds, rarest words of a text that propose them, and seeds of a text. They set a bound only.
SEED_ROWS, SEED_WORDS, SEEDS = 48, 2, 3
#: Step of the bonus levels.
LEVEL = 0.05
#: Values of an equal word and, at most, of a word that is only alike.
EQUAL, ALIKE = 0.9, 0.7
EPSILON = 1e-6
#: 64-bit words of the bitmap of a text's words, a power of 2.
WORD_BITS = 2


@dataclass(frozen=True)
class Field:
    """A text column of the rows with the weights of its fuzzy score and of its gram overlap."""

    name: str
    fuzzy: float
    grams: float


@dataclass(frozen=True)
class Score:
    """How pairs are scored. ``held`` is added where ``holds`` says so, which only rows that hold the text may do.

    ``allowed`` is a condition on pairs over the columns of both sides and, per
    field, ``fuzzy_<name>`` and ``overlap_<name>``.
    """

    fields: tuple[Field, ...]
    minimum: float
    allowed: Callable[[], Column]
    held: float = 0.0
    holds: Callable[[], Column] | None = None

    @property
    def fuzzy(self) -> float:
        return sum(f.fuzzy for f in self.fields)

    @property
    def grams(self) -> float:
        return sum(f.grams for f in self.fields)


def classes(rows: DataFrame, fields: tuple[Field, ...], order: list[Column]) -> DataFrame:
    """One row, the best by ``order``, of those with equal fields and bonus, with words and grams of its fields."""
    names = [f.name for f in fields]
    one = top_k(rows.filter(F.coalesce(*names).isNotNull()), [*names, "bonus"], order, 1)
    words = {f"words_{n}": F.array_distinct(sim.long_words(F.coalesce(F.col(n), F.lit("")))) for n in names}
    out = one.withColumns({f"low_{n}": F.lower(n) for n in names}).withColumns(words)
    out = out.withColumns({f"_t_{f.name}": sim.trigram_numbers(f"low_{f.name}") for f in fields if f.grams})
    for f in fields:
        if f.grams:
            numbers = f"_t_{f.name}"
            bits = {f"bits_{f.name}_{w}": F.col(f"{numbers}.b{w}") for w in range(sim.BITMAP)}
            out = out.withColumns({f"grams_{f.name}": F.col(f"{numbers}.codes"), f"n_{f.name}": F.size(f"{numbers}.codes")} | bits).drop(numbers)
    level = F.ceil(F.col("bonus") / LEVEL - EPSILON).cast("int")
    out = out.withColumn("words", F.array_distinct(F.concat(*words))).withColumn("level", level)
    out = out.withColumn("ids", F.transform("words", lambda w: F.xxhash64(w)))
    return cut(out.withColumns(_word_bits("words", "ids")))


def prepared(texts: DataFrame) -> DataFrame:
    """Texts (``text_id``, ``text``) with their words, grams and expansions."""
    out = texts.withColumns({"low": F.lower("text"), "q_words": sim.long_words("text"), "q_terms": sim.expand("text")})
    out = out.withColumn("_t", sim.trigram_numbers("low")).withColumn("q_grams", F.col("_t.codes"))
    return out.withColumns({
        "n": F.greatest(F.lit(1), F.size("q_words")), "q_ids": F.array_distinct(F.transform("q_words", lambda w: F.xxhash64(w))),
        # without synonyms only a row that holds the text has a term of it
        "q_bonus": F.when(F.size("q_terms") > 1, 0.5).otherwise(0.0), "q_n": F.size("q_grams"), **{f"q_bits_{w}": F.col(f"_t.b{w}") for w in range(sim.BITMAP)},
    }).drop("_t").withColumn("q_m", F.size("q_ids")).withColumns(_word_bits("q_words", "q_ids"))


ASKING = ["text_id", "n", "q_m", "q_bonus", "slack", "q_n", *[f"q_bits_{w}" for w in range(sim.BITMAP)], *[f"q_words_{w}" for w in range(WORD_BITS)]]


def _word_bits(prefix: str, ids: str) -> dict[str, Column]:
    """A bitmap in which every word sets one bit."""
    return {
        f"{prefix}_{w}": F.expr(f"aggregate(filter({ids}, x -> (x & {64 * (WORD_BITS - 1)}) = {64 * w}), 0L, (b, x) -> b | shiftleft(1L, cast(x & 63 AS int)))")
        for w in range(WORD_BITS)
    }


def _offered(score: Score) -> list[str]:
    """Columns of the rows that the bound of a pair needs."""
    parts = [[f"n_{f.name}", *[f"bits_{f.name}_{w}" for w in range(sim.BITMAP)]] for f in score.fields if f.grams]
    return ["kb_id", "level", "bonus", "ids", *[f"words_{w}" for w in range(WORD_BITS)], *[c for part in parts for c in part]]


def _fuzzy_most(common: Column) -> Column:
    """An upper bound of the fuzzy part of a pair with so many common words whose row does not hold the text."""
    return F.least(F.lit(1.0), (common * EQUAL + F.col("slack") + F.col("q_bonus")) / F.col("n"))


def _most(score: Score) -> Column:
    """An upper bound of the score of a pair whose row does not hold the text, from bitmaps.

    Of the words behind a bit that only the text has, at least one is not the row's; different words with one bit only raise
    the bound.  Bitmaps of two sets of grams differ in at most as many bits as the sets have unshared grams.
    """
    apart = sum((F.bit_count(F.col(f"q_words_{w}").bitwiseAND(F.bitwise_not(F.col(f"words_{w}")))) for w in range(WORD_BITS)), F.lit(0))
    total = _fuzzy_most(F.col("q_m") - apart) * score.fuzzy + F.col("bonus")
    for f in score.fields:
        if f.grams:
            apart = sum((F.bit_count(F.col(f"q_bits_{w}").bitwiseXOR(F.col(f"bits_{f.name}_{w}"))) for w in range(sim.BITMAP)), F.lit(0))
            both = F.col("q_n") + F.col(f"n_{f.name}")
            total = total + F.when((F.col("q_n") > 0) & (F.col(f"n_{f.name}") > 0), (both - apart) / (both + apart)).otherwise(0.0) * f.grams
    return total + EPSILON


def _may_win(score: Score) -> Column:
    """Whether a pair whose row does not hold the text can reach the text's ``bound``. Lists of words are not looked at, which would cost far more."""
    return _most(score) >= F.col("bound") - EPSILON


def likeness(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``word, target, value, df``: words of texts, the row words they are equal or alike to, and how many rows have these."""
    frequency = rows.select(F.explode("words").alias("target")).groupBy("target").agg(F.count("*").alias("df"))
    words = texts.select(F.explode("q_words").alias("word")).distinct()
    return cut(ca.near_words(words, frequency.select("target")).join(frequency, "target"))


def _word_sum(words: str) -> Column:
    """Sum of word values, ``alike`` holding for each word those that it is only alike to."""

    def value(w: Column) -> Column:
        near = F.filter(F.coalesce(F.try_element_at("alike", w), F.array().cast("array<struct<target:string,value:double>>")), lambda x: F.array_contains(F.col(words), x["target"]))
        other = F.coalesce(F.array_max(F.transform(near, lambda x: x["value"])), F.lit(0.0))
        return F.when(F.array_contains(F.col(words), w), EQUAL).otherwise(other)

    return F.aggregate("q_words", F.lit(0.0), lambda total, w: total + value(w))


def _holds_any(low: Column, terms: str) -> Column:
    return F.exists(terms, lambda t: F.contains(low, t))


def scored(pairs: DataFrame, texts: DataFrame, rows: DataFrame, score: Score) -> DataFrame:
    """Pairs (``text_id``, ``kb_id``) that are allowed, with their score.

    Where texts have a ``bound``, pairs are left out that cannot reach it with their common words and the overlap they have;
    words are compared one by one only for the others.
    """
    both = pairs.join(texts, "text_id").join(rows, "kb_id")
    total = F.col("bonus")
    parts = {}
    if "bound" in texts.columns:
        overlaps = sum((sim.jaccard("q_grams", f"grams_{f.name}") * f.grams for f in score.fields if f.grams), F.col("bonus"))
        holds = functools.reduce(Column.__or__, [F.coalesce(F.contains(f"low_{f.name}", "low"), F.lit(False)) for f in score.fields])
        words = _fuzzy_most(F.size(F.array_intersect("q_ids", "ids"))) * score.fuzzy
        both = both.filter((words + overlaps >= F.col("bound") - EPSILON) | holds)
    for f in score.fields:
        low, name = F.col(f"low_{f.name}"), f.name
        bonus = F.when(_holds_any(low, "q_terms"), 0.5).otherwise(0.0)
        fuzzy = F.least(F.lit(1.0), (_word_sum(f"words_{name}") + bonus) / F.col("n"))
        parts[f"fuzzy_{name}"] = F.when(F.contains(low, F.col("low")), 1.0).otherwise(fuzzy)
        total = total + F.col(f"fuzzy_{name}") * f.fuzzy
        if f.grams:
            parts[f"overlap_{name}"] = sim.jaccard("q_grams", f"grams_{name}")
            total = total + F.col(f"overlap_{name}") * f.grams
    if score.holds is not None:
        total = total + F.when(score.holds(), score.held).otherwise(0.0)
    out = both.withColumns(parts).filter(score.allowed()).withColumn("score", F.round(total, 9))
    return out.select("text_id", "kb_id", "score")


def _ordered_words(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``text_id, word, place, rest``: a text's words that rows have, the rarest first, and the most that they and later ones can add."""
    best = table.groupBy("word").agg(F.max("value").alias("value"), F.sum("df").alias("df"))
    words = texts.select("text_id", F.explode("q_words").alias("word")).groupBy("text_id", "word").agg(F.count("*").alias("times"))
    known = words.join(best, "word").withColumn("most", F.col("value") * F.col("times"))
    later = Window.partitionBy("text_id").orderBy(F.col("df").desc(), F.col("word").desc()).rowsBetween(Window.unboundedPreceding, 0)
    turn = Window.partitionBy("text_id").orderBy("df", "word")
    return known.select("text_id", "word", (F.row_number().over(turn) - 1).alias("place"), F.sum("most").over(later).alias("rest"))


def _inner_word(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``text_id, word, low``: the rarest word of each text that stands between two others, in the rows' own words."""
    parts = F.split("low", " ")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.length(w) > 2)
    equal = table.filter("word = target").select("word", "df")
    found = texts.select("text_id", F.explode(F.array_distinct(inner)).alias("word")).join(equal, "word", "left")
    rarest = found.groupBy("text_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("one"))
    return rarest.filter("one.df > 0").select("text_id", F.col("one.word").alias("word"))


def without_inner_word(texts: DataFrame) -> DataFrame:
    """Texts that have no long word between two others; rows that hold them need not have a whole word of them."""
    parts = F.split("low", " ")
    inner = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: F.length(w) > 2)
    return texts.filter(F.size(inner) == 0)


def best_match(
    texts: DataFrame, rows: DataFrame, score: Score, order: list[Column], loose: Callable[[DataFrame, DataFrame], DataFrame]
) -> DataFrame:
    """``text_id, kb_id, score``: for each text the allowed row of the highest score above the minimum, ties by ``order``.

    ``texts``: distinct ``text`` with a ``text_id``.  ``rows``: ``kb_id``, the
    fields, ``bonus`` (0 or more), the columns of ``order`` and of ``allowed``.
    ``loose(texts, rows)`` gives the allowed pairs of texts for which rows
    without any of their words come into question, or more pairs.
    """
    rows = classes(rows, score.fields, order)
    texts = prepared(texts)
    table = likeness(texts, rows)
    other = table.filter("word <> target").groupBy("word").agg(F.collect_list(F.struct("target", "value")).alias("others"))
    near = (
        texts.select("text_id", F.explode(F.array_distinct("q_words")).alias("word")).join(other, "word")
        .groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "others"))).alias("alike"))
    )
    no_map = F.create_map().cast("map<string,array<struct<target:string,value:double>>>")
    texts = texts.join(near, "text_id", "left").withColumn("alike", F.coalesce("alike", no_map))
    # what words may add that are only alike to one of the row, and repeated ones beyond the first
    slack = F.size(F.filter("q_words", lambda w: F.map_contains_key("alike", w))) * ALIKE + (F.size("q_words") - F.size("q_ids")) * EQUAL
    texts = cut(texts.withColumn("slack", slack))
    ordered = cut(_ordered_words(texts, table))
    targets = table.select("word", "target")
    offers = rows.select(F.explode("words").alias("target"), *_offered(score))
    heads = top_k(offers, ["target"], [F.col("bonus").desc(), F.col("kb_id")], SEED_ROWS)
    first = ordered.filter(F.col("place") < SEED_WORDS).select("text_id", "word").join(targets, "word").join(texts.select(ASKING), "text_id")
    # few bytes, but each row meets many: not left to a few tasks
    first = first.repartition(2 * first.sparkSession.sparkContext.defaultParallelism)
    promising = first.join(heads, "target").select("text_id", "kb_id", F.round(_most(score), 6).alias("most")).distinct()
    seeds = top_k(promising, ["text_id"], [F.col("most").desc(), F.col("kb_id")], SEEDS).select("text_id", "kb_id")
    known = cut(scored(seeds, texts, rows, score))
    best = known.groupBy("text_id").agg(F.max("score").alias("bound"))
    least = F.lit(score.minimum)
    asked = cut(texts.join(best, "text_id", "left").withColumn("bound", F.greatest(F.coalesce("bound", least), least)))

    # the fuzzy part that a row of a level needs if its grams overlap in full
    levels = [r.level for r in rows.select("level").distinct().collect()]  # at most a few steps up to the largest bonus
    needed = asked.select("text_id", "n", "q_bonus", "bound", F.explode(F.array(*map(F.lit, levels or [0]))).alias("level"))
    needed = needed.withColumn("need", (F.col("bound") - score.grams - F.col("level") * LEVEL) / score.fuzzy - EPSILON).filter("need <= 1")
    needed = needed.withColumn("sum", F.col("need") * F.col("n") - F.col("q_bonus"))
    reach = ordered.join(needed, "text_id").filter(F.col("rest") >= F.col("sum")).select("text_id", "level", "word")
    met = reach.join(targets, "word").join(asked.select(*ASKING, "bound"), "text_id").join(offers, ["target", "level"])
    met = met.filter(_may_win(score)).select("text_id", "kb_id")

    # rows that hold the text have the full fuzzy part whatever their words
    whole = asked.join(_inner_word(asked, table), "text_id").select("text_id", "low", F.col("word").alias("target"))
    holding = whole.join(rows.select(F.explode("words").alias("target"), "kb_id", *[f"low_{f.name}" for f in score.fields]), "target")
    inside = F.contains(f"low_{score.fields[0].name}", "low")
    for f in score.fields[1:]:
        inside = inside | F.contains(f"low_{f.name}", "low")
    holding = holding.filter(inside).select("text_id", "kb_id")

    open_texts = needed.filter("sum <= 0").select("text_id").unionByName(without_inner_word(asked).select("text_id")).distinct()
    open_texts = cut(asked.join(open_texts, "text_id", "left_semi"))
    pairs = met.unionByName(holding)
    if not open_texts.isEmpty():
        # ``holding`` has the rows that hold the text, but for fragments
        fragments = without_inner_word(open_texts).select("text_id", F.lit(True).alias("fragment"))
        proposed = loose(open_texts, rows).join(asked.select(*ASKING, "bound").join(fragments, "text_id", "left"), "text_id")
        proposed = proposed.join(rows.select(_offered(score)), "kb_id").filter(_may_win(score) | F.col("fragment").isNotNull())
        pairs = pairs.unionByName(proposed.select("text_id", "kb_id"))
    pairs = pairs.distinct().join(known.select("text_id", "kb_id"), ["text_id", "kb_id"], "left_anti")
    found = known.unionByName(scored(pairs, asked, rows, score)).filter(F.col("score") > score.minimum)
    names = [c for c in rows.columns if c not in found.columns]
    return top_k(found.join(rows.select("kb_id", *names), "kb_id"), ["text_id"], [F.col("score").desc(), *order], 1).select("text_id", "kb_id", "score")
