"""Character n-gram similarity join with prefix filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultmatch.functions.similarity import jaccard, ngrams

# Rare grams two texts must have in common to become a candidate pair.
SHARED = 1

# 64-bit words of the parity bitmap of a text.
WORDS = 4


def parity_bits(word: int, grams: str = "grams") -> Column:
    """One word of a bitmap in which every gram flips one bit.

    Two bitmaps differ in at most as many bits as the gram sets have unshared
    grams, which makes their difference a safe and very cheap filter.
    """
    mine = f"filter({grams}, g -> pmod(xxhash64(g), {64 * WORDS}) div 64 = {word})"
    return F.expr(f"aggregate({mine}, 0L, (b, g) -> b ^ shiftleft(1L, cast(pmod(xxhash64(g), 64) AS int)))").alias(f"bits{word}")


def _ordered(texts: DataFrame, frequency: DataFrame, min_sim: float) -> DataFrame:
    """Each text with its grams, rarest first, and the prefix that must hold a shared gram."""
    ranked = (
        texts.select("text", F.explode(ngrams("text")).alias("gram"))
        .join(frequency, "gram")
        .groupBy("text")
        .agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("pairs"))
        .select("text", F.transform("pairs", lambda p: p["gram"]).alias("grams"))
    )
    n = F.size("grams")
    least = F.ceil(n * min_sim - 1e-9).cast("int")
    wanted = F.least(F.lit(SHARED), least)
    ranked = ranked.select("*", *[parity_bits(w) for w in range(WORDS)])
    return ranked.withColumn("wanted", wanted).withColumn("prefix", F.slice("grams", 1, n - least + wanted))


def ngram_join(left: DataFrame, right: DataFrame, min_sim: float) -> DataFrame:
    """Pairs of distinct texts with n-gram Jaccard of at least ``min_sim`` (> 0).

    Two sets that similar share at least ``s`` grams among the rarest
    ``n - ceil(min_sim * n) + s`` of each, so only those meet in the join and
    very common grams do not.  Input columns: ``text``.  Copies enter once.
    """
    l, r = left.select("text").distinct(), right.select("text").distinct()
    frequency = (
        l.unionByName(r).select(F.explode(ngrams("text")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    )
    a_sets, b_sets = _ordered(l, frequency, min_sim), _ordered(r, frequency, min_sim)
    a = a_sets.select(
        F.col("text").alias("left_text"), F.size("grams").alias("na"), F.col("wanted").alias("wa"),
        *[F.col(f"bits{w}").alias(f"a{w}") for w in range(WORDS)], F.posexplode("prefix").alias("i", "gram"),
    )
    b = b_sets.select(
        F.col("text").alias("right_text"), F.size("grams").alias("nb"), F.col("wanted").alias("wb"),
        *[F.col(f"bits{w}").alias(f"b{w}") for w in range(WORDS)], F.posexplode("prefix").alias("j", "gram"),
    )
    # Both sides list grams in one order: up to the last shared prefix gram the
    # overlap is counted, beyond it the shorter remainder bounds it.
    bound = F.col("shared") + F.least(F.col("na") - 1 - F.col("i"), F.col("nb") - 1 - F.col("j"))
    needed = (F.col("na") + F.col("nb")) * (min_sim / (1 + min_sim)) - 1e-9
    unshared = F.lit(0)
    for w in range(WORDS):
        unshared = unshared + F.bit_count(F.col(f"a{w}").bitwiseXOR(F.col(f"b{w}")))
    candidates = (
        a.join(b, "gram")
        .filter(unshared <= F.col("na") + F.col("nb") - 2 * needed)
        .filter((F.col("na") >= F.col("nb") * min_sim - 1e-9) & (F.col("nb") >= F.col("na") * min_sim - 1e-9))
        .groupBy("left_text", "right_text", "na", "nb", "wa", "wb")
        .agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"))
        .filter((F.col("shared") >= F.least("wa", "wb")) & (bound >= needed))
        .select("left_text", "right_text")
    )
    return (
        candidates.join(a_sets.select(F.col("text").alias("left_text"), F.col("grams").alias("a")), "left_text")
        .join(b_sets.select(F.col("text").alias("right_text"), F.col("grams").alias("b")), "right_text")
        .select("left_text", "right_text", jaccard("a", "b").alias("similarity"))
        .filter(F.col("similarity") >= min_sim)
    )
