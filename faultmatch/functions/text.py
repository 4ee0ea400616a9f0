"""Text column functions: normalisation, tokens, step splitting, labels.

Every function takes and returns a ``Column``; nothing here needs a Python UDF.
Regular expressions carry the ``(?U)`` flag so that word, digit and space
classes cover all of Unicode.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, functions as F

from faultmatch import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    return F.coalesce(~col(c).rlike(r"(?U)\S"), F.lit(True))


def strip(c: Column | str) -> Column:
    """Trim white space of any kind from both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


#: What a text must hold for a rewrite to find anything, by its pattern.
REWRITE_NEEDS = {
    pattern: need
    for need, start in [("-", r"\b[0-9a-f]{8}"), (":\\", "[a-z]:"), ("exec", r"\bexec"), ("login failed for user", "login"),
                        ("\\", r"\b[a-z0-9._-]+\\"), ("@", r"\b[a-z0-9._%+-]+@")]
    for pattern, _ in fv.NORMALIZE_REWRITES if pattern.startswith(start)
}
#: The same matches by patterns that pass over the usual characters without a look at Unicode's classes.
REWRITE_FORMS = {
    r"[^\w\s-]": r"(?![a-z0-9 _-])[^\w\s-]",
    r"\b\d+\b": r"(?=\d)\b\d+\b",
    r"\s+": r"\s{2,}|(?! )\s",
}


def normalize(c: Column | str) -> Column:
    """Error signature of a message: lower case, placeholders, no punctuation.

    A rewrite that needs a piece the text does not hold is not tried.
    """
    out = F.lower(F.coalesce(col(c), F.lit("")))
    for need, group in groupby(fv.NORMALIZE_REWRITES, lambda rewrite: REWRITE_NEEDS.get(rewrite[0])):
        rewrites = [("(?U)" + REWRITE_FORMS.get(pattern, pattern), replacement) for pattern, replacement in group]

        def rewritten(text: Column, rewrites: list[tuple[str, str]] = rewrites) -> Column:
            for pattern, replacement in rewrites:
                text = F.regexp_replace(text, pattern, replacement)
            return text

        if need is None:
            out = rewritten(out)
        else:
            # the lambda binds the text, so that it is worked out once
            out = F.transform(F.array(out), lambda t: F.when(F.contains(t, F.lit(need)), rewritten(t)).otherwise(t))[0]
    # never null, and says so, as in ``fingerprint``
    return F.coalesce(F.trim(out), F.lit(""))


def fingerprint(c: Column | str) -> Column:
    # never null, and says so: joins on it need not work it out once more to leave out nulls
    return F.coalesce(F.sha2(F.coalesce(col(c), F.lit("")), 256), F.lit(""))


def tokens(c: Column | str, k: int | None = None) -> Column:
    """Distinct keywords in order of appearance, the first ``k`` if given."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(fv.TOKEN_PATTERN), F.lit(0))
    distinct = F.array_distinct(F.filter(found, lambda w: ~w.isin(fv.STOP_WORDS)))
    return distinct if k is None else F.slice(distinct, 1, k)


def non_blank_lines(c: Column | str) -> Column:
    return F.filter(F.split(col(c), "\n"), lambda line: ~is_blank(line))


def _trim_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def split_steps(c: Column | str) -> Column:
    """Solution text to ordered steps; the first matching format decides."""
    text = col(c)
    as_array = F.filter(
        F.transform(F.split(_trim_chars(text, r"\[\]"), ","), lambda s: _trim_chars(s, " \"'")),
        lambda s: s != "",
    )
    numbered = F.filter(
        F.split(text, f"(?md)(?={fv.NUMBERED_STEP_PATTERN})"), lambda s: ~is_blank(s)
    )
    has_bullets = text.contains(fv.BULLETS[0])
    for bullet in fv.BULLETS[1:]:
        has_bullets = has_bullets | text.contains(bullet)
    return (
        F.when(is_blank(text), F.array().cast("array<string>"))
        .when(text.startswith("[") & text.endswith("]"), as_array)
        .when(text.rlike("(?md)" + fv.NUMBERED_STEP_PATTERN), numbered)
        .when(has_bullets | (F.size(F.split(text, "\n")) > 2), non_blank_lines(text))
        .otherwise(F.array(text))
    )


def steps_text(c: Column | str) -> Column:
    """Steps array as one text, a step per line."""
    return F.array_join(col(c), "\n")


def numbered_lines(c: Column | str) -> Column:
    """Step lines of an assistant's answer, list marks trimmed."""
    lines = F.transform(F.split(col(c), "\n"), strip)

    def wanted(line: Column) -> Column:
        hit = line.startswith(fv.ANSWER_LINE_PREFIXES[0])
        for prefix in fv.ANSWER_LINE_PREFIXES[1:]:
            hit = hit | line.startswith(prefix)
        return hit

    return F.transform(F.filter(lines, wanted), lambda line: strip(F.regexp_replace(line, "^[- ]+", "")))


def teach_steps(c: Column | str) -> Column:
    """Lines typed by a teacher; an empty array means the input is refused."""
    return non_blank_lines(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\r"), F.lit("")))


def _first_contained(c: Column | str, table: list[tuple[str, list[str]]], default: str) -> Column:
    text, out = col(c), None
    for label, words in table:
        hit = text.contains(words[0])
        for word in words[1:]:
            hit = hit | text.contains(word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def categorize(c: Column | str) -> Column:
    return _first_contained(c, fv.CATEGORIES, fv.CATEGORY_DEFAULT)


def kb_category(c: Column | str) -> Column:
    return _first_contained(c, fv.DASHBOARD_CATEGORIES, fv.LABEL_DEFAULT)


def cluster_label(c: Column | str) -> Column:
    return _first_contained(c, fv.CLUSTER_LABELS, fv.LABEL_DEFAULT)


def length_band(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(n > 200, "Long Errors").when(n < 50, "Short Errors").otherwise("Medium Errors")


def rating_band(c: Column | str) -> Column:
    r = col(c)
    return F.when(r >= 4, "High Confidence").when(r >= 3, "Medium Confidence").otherwise("Low Confidence")


def confidence_level(c: Column | str) -> Column:
    v = col(c)
    return F.when(v >= fv.HIGH_CONFIDENCE, "High").when(v >= fv.MEDIUM_CONFIDENCE, "Medium").otherwise("Low")


def label_of(c: Column | str, table: dict[str, str], default: Column | str | None = None) -> Column:
    """Look a source up in a fixed label table; unknown ones keep ``default`` or their own name."""
    mapping = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    fallback = col(c) if default is None else (F.lit(default) if isinstance(default, str) else default)
    return F.coalesce(F.try_element_at(mapping, col(c)), fallback)


def percent(c: Column) -> Column:
    """Whole-number percentage text."""
    return F.concat(F.round(c * 100).cast("long").cast("string"), F.lit("%"))
