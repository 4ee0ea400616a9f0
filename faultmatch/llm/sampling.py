"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultmatch.llm.common import ready
from faultmatch.llm.order import STRETCHES, with_stretch

#: Samples of a fingerprint, drawn in sets: one aggregate of them all would be too much code for one compiled method.
#: The share of equal samples strays by up to 0.5 / sqrt(SAMPLES) (one deviation).
SAMPLES, SET = 40, 8
#: Rows of a stretch of the document order.
STRETCH = 2000
#: Spaces between words.
SPACES = r"[\x20\x09-\x0D]+"
_LEAST = -(1 << 63)
_PLACES = 32


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """A number strictly between 0 and 1 from ``width`` bits of a hash."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part + F.lit(0.5)) / F.lit(float(1 << width))


def sample(term: Column, log_weights: list[Column], k: Column) -> list[Column]:
    """Sample ``k`` of one term under each weight; the least over a text's terms is the text's sample.

    The term and ``k`` alone fix two Gamma(2, 1) variates, each minus the
    logarithm of a product of two uniform ones, and a uniform shift.  They
    quantise the weight's logarithm to a step t; the term whose value ln a is
    the least wins.  Two texts draw the same term and step with
    probability equal to their generalised Jaccard similarity.  The number returned has
    ln a in front, to 2^-24, and 32 bits of the term and step behind it.
    """
    one, two = F.xxhash64(term, k, F.lit(0)), F.xxhash64(term, k, F.lit(1))
    r = -F.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    shift = _uniform(one, 42, 22)
    log_c = F.log(-F.log(_uniform(two, 0, 32) * _uniform(two, 32, 32)))
    out = []
    for log_weight in log_weights:
        step = F.floor(log_weight / r + shift)
        value = log_c - r * (step - shift + 1)
        front = ((F.greatest(value, F.lit(-64.0)) + 64) * F.lit(float(1 << 24))).cast("long")
        back = term.bitwiseXOR(step * F.lit(2654435761)).bitwiseAND(F.lit((1 << _PLACES) - 1))
        out.append(F.shiftleft(front, _PLACES).bitwiseOR(back))
    return out


def in_order(docs: DataFrame) -> DataFrame:
    """``stretch, turn, guest, at, text, next_text``: whole texts in ascending id order, each with the next one.

    Texts are shuffled once, by stretches of the order; the first text of each
    stretch visits the one before it as a guest row, the first of all visits the last.
    ``at`` is the id, with the least long number for null.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    rows, n = with_stretch(rows, "at", STRETCH)
    heads = rows.groupBy("stretch").agg(F.min("at").alias("at"))  # one row a stretch
    whole = Window.orderBy("stretch")
    last = F.max("stretch").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("stretch", "at", F.coalesce(F.lag("stretch").over(whole), last).alias("before"))
    first = rows.join(F.broadcast(heads) if n <= STRETCHES else heads, ["stretch", "at"]).groupBy("stretch", "before").agg(F.min("text").alias("text"))
    guests = first.select("text", F.lit(_LEAST).alias("at"), F.coalesce("before", F.lit(0).cast("long")).alias("stretch"), F.lit(1).alias("guest"))
    dealt = rows.select("text", "at", "stretch", F.lit(0).alias("guest")).unionByName(guests).repartition(n, "stretch")
    order = Window.partitionBy("stretch").orderBy("guest", "at", "text")
    return dealt.select(
        "stretch", F.row_number().over(order).alias("turn"), "guest", "at", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text")
    )


def with_edits(ordered: DataFrame) -> DataFrame:
    """Adds ``n_chars`` and the parts of a text and its edit: the same start, and what each ends in."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    return ordered.select(
        "stretch", "turn", "guest", "at", n.cast("long").alias("n_chars"), F.left("text", n - quarter).alias("same"),
        F.right("text", quarter).alias("end"), F.left("next_text", quarter).alias("edit"),
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and how alike they are.

    A text's terms are its words, weighted by how often they occur.  Words
    before the edit are in both texts and enter once, with two counts.  A text
    without words has samples of its own kind, alike only to other such texts.

    Null texts are empty.  Rows without an id come first in the order; rows
    that share an id are ordered by their text; repeated rows stay; other
    columns are left out.  Nothing but the first shuffle moves texts: all that
    follows stays within the stretches.
    """
    ready(docs.sparkSession)
    edits = with_edits(in_order(docs))
    start = F.split("same", SPACES)
    going_on = F.element_at(start, -1)  # the word in which the parts meet, empty after a space
    ends, changes = (F.split(F.concat(going_on, part), SPACES) for part in ("end", "edit"))
    first = F.size(start) - 1
    arrays = edits.select(
        "stretch", "turn", first.alias("first"), (first + F.size(ends)).alias("n"), F.concat(F.slice(start, 1, first), ends, changes).alias("words")
    )
    # the explosion repeats what stands beside it, so the arrays must not; the outer form, as the plain one checks their size first
    terms = arrays.select("stretch", "turn", "first", "n", F.posexplode_outer("words").alias("place", "word")).filter("word <> ''")
    own, other = F.col("place") < F.col("n"), (F.col("place") < F.col("first")) | (F.col("place") >= F.col("n"))
    counts = terms.groupBy("stretch", "turn", F.xxhash64("word").alias("term")).agg(F.count_if(own).alias("own"), F.count_if(other).alias("other"))
    logs = counts.select("stretch", "turn", "term", F.log("own").alias("own"), F.log("other").alias("other"))  # null for none
    sets = logs.select("*", F.explode_outer(F.lit(list(range(0, samples, SET)))).alias("set"))
    drawn = []
    for k in range(min(SET, samples)):
        own, other = sample(F.col("term"), [F.col("own"), F.col("other")], F.col("set") + k)
        drawn += [F.min(own).alias(f"a{k}"), F.min(other).alias(f"b{k}")]
    signed = sets.groupBy("stretch", "turn", "set").agg(*drawn)
    none = F.lit(-1).cast("long")

    def places(prefix: str) -> Column:
        return F.array(*[F.coalesce(F.col(f"{prefix}{k}").bitwiseAND(F.lit((1 << _PLACES) - 1)), none) for k in range(min(SET, samples))])

    signed = signed.select("stretch", "turn", F.struct("set", places("a").alias("a"), places("b").alias("b")).alias("part"))
    signed = signed.groupBy("stretch", "turn").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    signed = signed.select("stretch", "turn", F.flatten("parts.a").alias("a"), F.flatten("parts.b").alias("b"))
    facts = edits.select("stretch", "turn", "guest", "at", "n_chars", F.sha2(F.concat("same", "edit"), 256).alias("edited_sha256"))
    empty = F.array_repeat(none, samples)
    whole = facts.join(signed, ["stretch", "turn"], "left").withColumns({"a": F.coalesce("a", empty), "b": F.coalesce("b", empty)})
    order = Window.partitionBy("stretch").orderBy("turn")
    whole = whole.withColumn("c", F.lead("a").over(order)).filter("guest = 0")

    def alike(prefix: str) -> Column:
        same = F.filter(F.arrays_zip(F.col("a").alias("x"), F.col(prefix).alias("y")), lambda p: p["x"] == p["y"])
        return F.size(same) / F.lit(float(samples))

    # -1, no sample, is shown as eight of a letter that no number has
    def shown(prefix: str) -> Column:
        return F.array_join(F.transform(prefix, lambda x: F.when(x < 0, F.lit("x" * 8)).otherwise(F.lower(F.lpad(F.hex(x), 8, "0")))), "")

    return whole.select(
        F.expr(f"nullif(at, cast('{_LEAST}' as bigint))").alias("doc_id"), "n_chars", "edited_sha256", shown("a").alias("fingerprint"),
        shown("b").alias("edited_fingerprint"), alike("b").alias("near_edited"), alike("c").alias("near_next"),
    )


def op7(docs: DataFrame) -> DataFrame:
    return fingerprints(docs)
