"""String and vector similarity as columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions.text import col


def levenshtein(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(F.lower(col(a)), F.lower(col(b)))


def similarity(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    empty = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(empty, 0.0)
        .when(F.lower(a) == F.lower(b), 1.0)
        .otherwise(1.0 - levenshtein(a, b) / longest)
    )


def _synonym_map() -> Column:
    entries = []
    for key, synonyms in fv.SYNONYM_GROUPS.items():
        group = F.array(*[F.lit(w) for w in [key, *synonyms]])
        for word in [key, *synonyms]:
            if " " not in word:
                entries += [F.lit(word), group]
    return F.create_map(*entries)


def expand(c: Column | str) -> Column:
    """The lower-cased query followed by the synonym groups its words belong to."""
    query = F.lower(col(c))
    groups = F.transform(
        F.split(query, " "),
        lambda w: F.coalesce(F.try_element_at(_synonym_map(), w), F.array().cast("array<string>")),
    )
    return F.array_distinct(F.concat(F.array(query), F.flatten(groups)))


def long_words(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(c)), " "), lambda w: F.length(w) > 2)


def word_match(query_word: Column, target_words: Column) -> Column:
    """0.9 for an equal word, else 0.7 of the best similarity above 0.8."""

    def nearest(best: Column, word: Column) -> Column:
        longest = F.greatest(F.length(query_word), F.length(word))
        return F.greatest(best, 1.0 - F.levenshtein(query_word, word) / longest)

    def comparable(word: Column) -> Column:
        # a length gap of a fifth already rules out a similarity above 0.8
        gap = F.abs(F.length(query_word) - F.length(word))
        return gap * 5 < F.greatest(F.length(query_word), F.length(word))

    near = F.aggregate(
        F.filter(target_words, comparable), F.lit(0.0), nearest, lambda best: F.when(best > 0.8, best * 0.7).otherwise(0.0)
    )
    return F.when(F.array_contains(target_words, query_word), 0.9).otherwise(near)


def fuzzy_score(
    query: Column | str,
    target: Column | str,
    query_words: Column | str | None = None,
    target_words: Column | str | None = None,
    expansions: Column | str | None = None,
) -> Column:
    """Word-wise fuzzy score in [0, 1]; word lists may be passed in ready made."""
    q, t = F.lower(col(query)), F.lower(col(target))
    q_words = long_words(query) if query_words is None else col(query_words)
    t_words = long_words(target) if target_words is None else col(target_words)
    terms = expand(query) if expansions is None else col(expansions)
    words = F.aggregate(
        q_words, F.lit(0.0), lambda total, w: total + word_match(w, t_words)
    )
    bonus = F.when(F.exists(terms, lambda term: F.contains(t, term)), 0.5).otherwise(0.0)
    scored = F.least(F.lit(1.0), (words + bonus) / F.greatest(F.lit(1), F.size(q_words)))
    return F.when(F.contains(t, q), 1.0).otherwise(scored)


def ngrams(c: Column | str, n: int = 3) -> Column:
    """Distinct character n-grams, lower case, in order of appearance."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(col(c)), F.lit("(?s)(?=(.{%d}))" % n), F.lit(1))
    )


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap share of two distinct sets given as arrays; 0 when either is empty."""
    a, b = col(a), col(b)
    total = F.size(a) + F.size(b)
    # the fold binds the overlap, so that the intersection is built once
    share = F.aggregate(
        F.array(F.size(F.array_intersect(a, b))), F.lit(0), lambda s, n: s + n, lambda n: n / (total - n)
    )
    return F.when((F.size(a) > 0) & (F.size(b) > 0), share).otherwise(0.0)


#: 64-bit words of the parity bitmap that goes with the numbers of a text's trigrams.
BITMAP = 4


def trigram_numbers(c: Column | str) -> Column:
    """``codes, b0, b1, ..``: the distinct trigrams of a lower-case text, each as the number its three code points make, and a bitmap
    in which every trigram flips one bit; null without a text.  Counted in Arrow batches."""
    names = ["codes", *(f"b{w}" for w in range(BITMAP))]
    words = BITMAP

    @F.arrow_udf("struct<codes array<bigint>, " + ", ".join(f"{n} bigint" for n in names[1:]) + ">")
    def numbers(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts.to_pylist()]
        sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
        points = np.concatenate([np.empty(0, np.uint32), *(r for r in rows if r is not None)]).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        whole = np.flatnonzero(row[2:] == row[:-2])
        codes, row = points[whole] << 42 | points[whole + 1] << 21 | points[whole + 2], row[whole]
        order = np.lexsort((codes, row))
        codes, row = codes[order], row[order]
        first = np.ones(len(codes), dtype=bool)
        first[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
        codes, row = codes[first], row[first]
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        bits = np.zeros((len(rows), words), dtype=np.uint64)
        np.bitwise_xor.at(bits, (row, (mixed >> np.uint64(6)).astype(np.int64) % words), np.uint64(1) << (mixed & np.uint64(63)))
        missing = pa.array([r is None for r in rows], type=pa.bool_())
        offsets = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), type=pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, pa.array(codes, type=pa.int64()), mask=missing)]
        columns += [pa.array(bits[:, w].astype(np.int64), type=pa.int64()) for w in range(words)]
        return pa.StructArray.from_arrays(columns, names=names)

    return numbers(col(c))


def ngram_overlap(a: Column | str, b: Column | str, n: int = 3) -> Column:
    """``shared, joint``: sizes of the intersection and the union of two texts' distinct n-grams, lower case; null without a text."""

    @F.arrow_udf("struct<shared int, joint int>")
    def overlap(left: pa.Array, right: pa.Array) -> pa.Array:
        shared, joint = [], []
        for x, y in zip(left.to_pylist(), right.to_pylist()):
            if x is None or y is None:
                shared.append(None)
                joint.append(None)
                continue
            g, h = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (x, y))
            shared.append(len(g & h))
            joint.append(len(g) + len(h) - shared[-1])
        return pa.StructArray.from_arrays([pa.array(shared, pa.int32()), pa.array(joint, pa.int32())], names=["shared", "joint"])

    return overlap(F.lower(col(a)), F.lower(col(b)))


def ngram_similarity(a: Column | str, b: Column | str, n: int = 3) -> Column:
    """Jaccard similarity of two texts' n-grams, counted in Arrow batches; 0 without a gram on both sides."""
    found = ngram_overlap(a, b, n)
    return F.coalesce(F.try_divide(found["shared"], found["joint"]), F.lit(0.0))


# --- vectors -------------------------------------------------------------------


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 1e-8, F.transform(col(v), lambda x: x.cast("double") / norm)).otherwise(
        col(v).cast("array<double>")
    )


def cosine(a: Column | str, b: Column | str, mode: str = "index") -> Column:
    """Cosine of two raw vectors.

    ``index``: vectors of unequal length score 0.  ``kb``: the shorter length
    counts, and a missing or empty vector scores -1.
    """
    a, b = l2_normalize(col(a)), l2_normalize(col(b))
    if mode == "index":
        return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(0.0)
    n = F.least(F.size(a), F.size(b))
    return F.when(a.isNull() | b.isNull() | (n <= 0), -1.0).otherwise(dot(F.slice(a, 1, n), F.slice(b, 1, n)))


def projection_weights(dims: int, tables: int = fv.LSH_TABLES) -> list[list[float]]:
    """Reproducible projection directions in [-0.5, 0.5) from an integer congruential rule."""
    return [
        [((i * 100 + j) * 1103515245 + 12345) % 2**31 / 2**31 - 0.5 for j in range(dims)] for i in range(tables)
    ]


def lsh_buckets(v: Column | str) -> Column:
    """One integer bucket per projection of the whole vector, truncated towards zero, as strings.

    The directions are those of ``projection_weights``, as long as the vector is.
    """
    size = F.size(col(v))
    places = F.slice(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), F.lit(1), F.greatest(size, F.lit(0)))

    def direction(table: int) -> Column:
        return F.transform(places, lambda j: ((j + table * 100).cast("long") * 1103515245 + 12345) % F.lit(2**31) / F.lit(2.0**31) - 0.5)

    return F.array(*[(dot(col(v), direction(t)) * fv.LSH_SCALE).cast("int").cast("string") for t in range(fv.LSH_TABLES)])


def parse_vector(c: Column | str) -> Column:
    """Text such as ``[1, 2]`` or ``array(1, 2)`` to floats; bad elements are skipped."""
    t = F.trim(col(c))
    for pattern in [r"^\[", r"\]$", r"(?i)^array\(", r"\)$"]:
        t = F.regexp_replace(t, pattern, "")
    parts = F.filter(F.split(t, "[, ]"), lambda p: p != "")
    floats = F.filter(F.transform(parts, lambda p: p.try_cast("float")), lambda x: x.isNotNull())
    return F.coalesce(floats, F.array().cast("array<float>"))


def parse_json_vector(c: Column | str) -> Column:
    """JSON array text to floats; anything that does not parse gives an empty array."""
    parsed = F.from_json(col(c), "array<float>")
    bad = parsed.isNull() | F.exists(parsed, lambda x: x.isNull())
    return F.when(bad, F.array().cast("array<float>")).otherwise(parsed)


def cache_key(v: Column | str, limit: int, threshold: float) -> Column:
    """First 16 base64 characters of a SHA-256 over the vector and the search settings."""
    text = F.concat_ws("|", F.array_join(col(v).cast("array<string>"), ","), F.lit(str(limit)), F.lit(str(threshold)))
    return F.substring(F.base64(F.unhex(F.sha2(text, 256))), 1, 16)


def result_key(hashes: Column | str) -> Column:
    return F.substring(F.base64(F.unhex(F.sha2(F.array_join(col(hashes), "|"), 256))), 1, 16)
