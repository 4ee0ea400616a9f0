"""Rule patterns against texts without trying every pattern on every text.

A text that matches a pattern has certain literal pieces of it.  Each pattern gives
the longest piece it cannot do without, or one for each of its alternatives.
Texts and pieces meet on the rarest trigram of a piece; patterns are tried only
on the texts that hold a piece of theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultmatch.operators.candidates import grams
from faultmatch.session import in_broadcastable_slices

#: Pieces meet texts on grams of this length; shorter ones tell nothing.
GRAM = 3

_PLAIN = re.compile(r"\(\?[is]+\)|\(\?[=!]|\(\?<[=!]|\(\?:|\(\?<[A-Za-z][A-Za-z0-9]*>|\((?!\?)")
_CLASS = re.compile(r"\[\^?+(?!\])(?:\\[^QEpPxuc0-9]|[^\]\\\[&])+\]")
_ESCAPE = re.compile(r"\\(?:[dDsSwWhHvVRbBAGzZtnrfae]|[^A-Za-z0-9])")
_TIMES = re.compile(r"(?:([?*])|\+|\{([0-9]+)(?:,[0-9]*)?\})[?+]?")


class _Unknown(Exception):
    """The pattern uses something that is not looked into."""


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of pieces, the one whose shortest piece is longer."""
    return max((s for s in (a, b) if s), key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _branch(pattern: str, at: int) -> tuple[frozenset[str] | None, int]:
    """Pieces of which one must occur in what a sequence of atoms matches, and where the sequence ends."""
    best, run = None, ""

    def ended() -> frozenset[str] | None:
        return _better(best, frozenset([run.lower()]) if run else None)

    while at < len(pattern) and pattern[at] not in "|)":
        c, literal, inner = pattern[at], "", None
        if c == "(":
            opening = _PLAIN.match(pattern, at)
            if not opening:
                raise _Unknown
            at = opening.end()
            if not opening[0].endswith(")"):
                inner, at = _alternatives(pattern, at)
                if pattern[at : at + 1] != ")":
                    raise _Unknown
                at += 1
                if opening[0].endswith(("=", "!")):
                    inner = None
        else:
            atom = _CLASS.match(pattern, at) if c == "[" else _ESCAPE.match(pattern, at) if c == "\\" else None
            if (c in "[\\" and not atom) or c in "*+?{":
                raise _Unknown
            at = atom.end() if atom else at + 1
            literal = c if not atom and c not in ".^$" else atom[0][1] if c == "\\" and not atom[0][1].isalnum() else ""
        times = _TIMES.match(pattern, at)
        if times:
            at = times.end()
            optional = times[1] is not None or (times[2] is not None and int(times[2]) == 0)
            if not optional and literal.isascii():
                run, best = run + literal, _better(best, inner)
            best, run = ended(), ""
        elif literal and literal.isascii():
            run += literal
        else:
            best, run = _better(ended(), inner), ""
    return ended(), at


def _alternatives(pattern: str, at: int) -> tuple[frozenset[str] | None, int]:
    found = []
    while True:
        pieces, at = _branch(pattern, at)
        found.append(pieces)
        if pattern[at : at + 1] != "|":
            break
        at += 1
    return (None if None in found else frozenset().union(*found)), at


def pieces(pattern: str) -> list[str]:
    """Lower-case literals of at least ``GRAM`` letters, one of which every text has that the pattern matches.

    Empty where the pattern needs none, or uses what is not looked into here
    (quoting, code points by number, character properties, nested classes,
    flags other than ``i`` and ``s``, atomic groups).
    """
    try:
        found, at = _alternatives(pattern, 0)
    except _Unknown:
        return []
    if at < len(pattern) or not found or min(map(len, found)) < GRAM:
        return []
    return sorted(found)


def with_pieces(patterns: DataFrame) -> DataFrame:
    """Distinct ``pattern_regex`` with ``pieces``."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(pieces=[pieces(p) for p in batch["pattern_regex"]])

    distinct = patterns.select("pattern_regex").filter(F.col("pattern_regex").isNotNull()).distinct()
    return distinct.mapInPandas(step, "pattern_regex string, pieces array<string>")


def proposed(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (signature, pattern_regex) of distinct texts and the patterns of which they hold a piece."""
    by_piece = known.select("pattern_regex", F.explode("pieces").alias("piece"))
    piece_grams = by_piece.select("piece").distinct().select("piece", F.explode(grams("piece", GRAM)).alias("gram"))
    text_grams = (
        texts.select("signature", F.lower("signature").alias("low"))
        .select("signature", "low", F.explode(grams("low", GRAM)).alias("gram"))
        .join(piece_grams.select("gram").distinct(), "gram", "left_semi")
    )
    frequency = text_grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        piece_grams.join(frequency, "gram", "left")
        .groupBy("piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
        .select("piece", F.col("least.gram").alias("gram"))
    )
    holding = text_grams.join(rarest, "gram").filter(F.contains("low", "piece")).select("signature", "piece")
    return holding.join(by_piece, "piece").select("signature", "pattern_regex").distinct()


def pattern_hits(signatures: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs of distinct signatures and the rules whose pattern they match, with all columns of the rules.

    Null signatures and patterns match nothing; equal patterns of several rules
    are tried once.  Patterns without a piece are tried on every text, in slices
    that can be broadcast; there are none of these jobs where no rule needs them.
    """
    distinct = signatures.select("signature").filter(F.col("signature").isNotNull()).distinct()
    rules = with_pieces(patterns)
    matches = F.expr("signature rlike pattern_regex")
    found = proposed(distinct, rules.filter(F.size("pieces") > 0)).filter(matches)
    loose = rules.filter(F.size("pieces") == 0).select("pattern_regex")
    if not loose.isEmpty():
        for part in in_broadcastable_slices(loose, "pattern_regex"):
            found = found.unionByName(distinct.join(part, matches).select("signature", "pattern_regex"))
    return found.join(patterns, "pattern_regex").select("signature", *patterns.columns)
