"""Input classification: detectors, verdicts, sanitising, severities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions.text import col, is_blank, label_of, strip

FLAGS = "(?iUd)"


def is_error_message(c: Column | str) -> Column:
    return col(c).rlike(FLAGS + fv.ERROR_MESSAGE_PATTERN)


def is_sql_injection(c: Column | str) -> Column:
    return col(c).rlike(FLAGS + fv.SQL_INJECTION_PATTERN)


def is_strict_sql(c: Column | str) -> Column:
    return col(c).rlike(FLAGS + fv.STRICT_SQL_PATTERN)


def is_xss(c: Column | str) -> Column:
    return col(c).rlike(FLAGS + fv.XSS_PATTERN)


def has_command(c: Column | str, strict: bool = False) -> Column:
    commands = fv.DANGEROUS_COMMANDS_STRICT if strict else fv.DANGEROUS_COMMANDS
    text = F.lower(col(c))
    hit = text.contains(commands[0])
    for command in commands[1:]:
        hit = hit | text.contains(command)
    return hit


def sanitize(c: Column | str) -> Column:
    out = col(c)
    for old, new in fv.SANITIZE_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip(out)


def _too_long(text: Column, max_length: int | None) -> Column:
    return F.lit(False) if max_length is None else F.length(text) > max_length


def verdict(c: Column | str, over_limit: Column, max_length: int | None = fv.MAX_QUERY_LENGTH) -> Column:
    """First rule that fires; accepted input is ERROR_ANALYSIS or QUERY.  ``max_length`` refuses longer input, ``None`` none."""
    text = col(c)
    error = is_error_message(text)
    return (
        F.when(is_blank(text), "EMPTY")
        .when(_too_long(text, max_length), "EXCESSIVE_LENGTH")
        .when(~error & is_sql_injection(text), "SQL_INJECTION_ATTEMPT")
        .when(is_xss(text), "XSS_ATTEMPT")
        .when(~error & has_command(text), "DANGEROUS_COMMAND")
        .when(over_limit, "RATE_LIMIT_EXCEEDED")
        .when(error, "ERROR_ANALYSIS")
        .otherwise("QUERY")
    )


def verdict_strict(c: Column | str, over_limit: Column, max_length: int | None = fv.MAX_QUERY_LENGTH) -> Column:
    text = col(c)
    return (
        F.when(is_blank(text), "EMPTY")
        .when(_too_long(text, max_length), "EXCESSIVE_LENGTH")
        .when(is_strict_sql(text), "SQL_INJECTION_ATTEMPT")
        .when(is_xss(text), "XSS_ATTEMPT")
        .when(has_command(text, strict=True), "DANGEROUS_COMMAND")
        .when(over_limit, "RATE_LIMIT_EXCEEDED")
        .otherwise("ACCEPTED")
    )


def is_accepted(v: Column | str) -> Column:
    return col(v).isin("ERROR_ANALYSIS", "QUERY", "ACCEPTED")


def event_type(v: Column | str) -> Column:
    """Logged event of a verdict; empty input and strict acceptance log nothing."""
    return F.when(~col(v).isin("EMPTY", "ACCEPTED"), col(v))


def event_details(v: Column | str, text: Column | str, length: int | None = None) -> Column:
    """What is logged beside a verdict: the refused text, of which ``length`` keeps only the start."""
    refused = col(text) if length is None else F.substring(col(text), 1, length)
    return (
        F.when(col(v) == "RATE_LIMIT_EXCEEDED", "")
        .when(col(v) == "ERROR_ANALYSIS", fv.ACCEPTED_ERROR_DETAIL)
        .when(col(v) == "QUERY", fv.ACCEPTED_QUERY_DETAIL)
        .when(~col(v).isin("EMPTY", "ACCEPTED"), refused)
    )


def severity(c: Column | str, strict: bool = False) -> Column:
    if strict:
        return label_of(c, fv.EVENT_SEVERITY_STRICT, fv.EVENT_SEVERITY_STRICT_DEFAULT)
    return label_of(c, fv.EVENT_SEVERITY, fv.EVENT_SEVERITY_DEFAULT)


def threat_level(high: Column | str, medium: Column | str) -> Column:
    return (
        F.when(col(high) > 10, "CRITICAL")
        .when(col(high) > 0, "HIGH")
        .when(col(medium) > 20, "MEDIUM")
        .otherwise("LOW")
    )


def has_threats(high: Column | str, injections: Column | str) -> Column:
    return (col(high) > 0) | (col(injections) > 0)
