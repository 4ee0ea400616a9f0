"""Feature and confidence columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions.text import categorize, col


# --- features ------------------------------------------------------------------


def error_code(c: Column | str) -> Column:
    code = F.regexp_extract(col(c), "(?iU)" + fv.ERROR_CODE_PATTERN, 1)
    return F.coalesce(code.try_cast("int"), F.lit(0))


def complexity(c: Column | str) -> Column:
    sentences = F.size(F.filter(F.split(col(c), "[.!?]"), lambda s: s != ""))
    words = F.size(F.split(col(c), " "))
    letters = F.length(F.replace(col(c), F.lit(" "), F.lit("")))
    ease = 206.835 - 1.015 * (words / sentences) - 84.6 * ((letters / words) / 10)
    return F.when(sentences == 0, 0.0).otherwise(F.least(F.lit(100.0), ease))


def special_chars(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"(?U)[\p{L}\p{Nd}\s]+", ""))


FEATURE_NAMES = (
    ["length", "words", "lines"]
    + ["has_" + w for w in fv.FEATURE_KEYWORDS]
    + ["error_code", "hour", "weekday", "complexity", "special_chars"]
)


TIME_FEATURES = ["hour", "weekday"]


def text_features(text: Column | str) -> list[Column]:
    """The named feature columns that depend on the message alone."""
    t, lower = col(text), F.lower(col(text))
    values = {"length": F.length(t), "words": F.size(F.split(t, " ")), "lines": F.size(F.split(t, "\n"))}
    values |= {"has_" + w: F.contains(lower, F.lit(w)) for w in fv.FEATURE_KEYWORDS}
    values |= {"error_code": error_code(t), "complexity": complexity(t), "special_chars": special_chars(t)}
    return [v.cast("double").alias(n) for n, v in values.items()]


def time_features(ts: Column | str) -> list[Column]:
    values = {"hour": F.hour(col(ts)), "weekday": F.dayofweek(col(ts)) - 1}
    return [v.cast("double").alias(n) for n, v in values.items()]


def features(text: Column | str, ts: Column | str) -> list[Column]:
    """All 18 feature columns of a message; time features come from the row's timestamp."""
    return [*text_features(text), *time_features(ts)]


# --- confidence ------------------------------------------------------------------


def confidence(rate: Column | str, n: Column | str, conflict: Column | float) -> Column:
    rate, n = col(rate), col(n)
    conflict = F.lit(conflict) if isinstance(conflict, (int, float)) else conflict
    base = F.when(n == 0, 0.5).otherwise(rate)
    sample = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), n / float(fv.MIN_FEEDBACK)))
    return base * sample * F.greatest(F.lit(0.0), 1.0 - conflict * 2)


def feedback_confidence(rate: Column | str, n: Column | str, conflict: Column | str) -> Column:
    rate, n, conflict = col(rate), col(n), col(conflict)
    sample = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), n / float(fv.MIN_FEEDBACK)))
    penalty = F.when(conflict > fv.CONFLICT_THRESHOLD, 1.0 - (conflict - fv.CONFLICT_THRESHOLD) * 3).otherwise(
        1.0 - conflict * 2
    )
    return rate * sample * F.greatest(F.lit(0.0), penalty)


def unified(
    base: Column | None, n: Column, conflict: Column, model: Column | None = None, sim: Column | None = None
) -> Column:
    """Weighted mean of the parts that are present, 0.5 when none is."""
    base = F.lit(None).cast("double") if base is None else base
    feedback = F.when(
        n > 0, feedback_confidence(F.coalesce(base, F.lit(0.5)), n, F.coalesce(conflict, F.lit(0.0)))
    )
    parts = [(base, "base"), (feedback, "feedback")]
    parts += [(c, name) for c, name in [(model, "model"), (sim, "similarity")] if c is not None]
    total, weight = F.lit(0.0), F.lit(0.0)
    for part, name in parts:
        w = fv.UNIFIED_WEIGHTS[name]
        total = total + F.when(part.isNotNull(), part * w).otherwise(0.0)
        weight = weight + F.when(part.isNotNull(), w).otherwise(0.0)
    return F.when(weight > 0, F.try_divide(total, weight)).otherwise(0.5)


def modifiers(base: Column, n: Column, anomaly: Column, steps: Column, days_old: Column) -> Column:
    out = F.when(anomaly, base * 0.8).otherwise(base)
    out = F.when((steps > 4) & (base > 0.7), F.least(F.lit(0.95), out * 1.1)).otherwise(out)
    out = F.when(days_old > 365, out * F.greatest(F.lit(0.8), 1.0 - (days_old - 365) / 1000.0)).otherwise(out)
    out = F.when(
        out > fv.HIGH_CONFIDENCE, F.when(n < 10, fv.HIGH_CONFIDENCE).otherwise(F.least(F.lit(0.99), out))
    ).otherwise(out)
    return F.greatest(F.lit(0.05), F.least(F.lit(0.99), out))


def unified_confidence(
    base: Column | None,
    n: Column,
    conflict: Column,
    model: Column | None = None,
    sim: Column | None = None,
    anomaly: Column | None = None,
    steps: Column | None = None,
    days_old: Column | None = None,
) -> Column:
    """Unified score with modifiers; with no part present the neutral 0.5 stays unmodified."""
    score = unified(base, n, conflict, model, sim)
    changed = modifiers(
        score,
        n,
        F.lit(False) if anomaly is None else anomaly,
        F.lit(0) if steps is None else steps,
        F.lit(0.0) if days_old is None else days_old,
    )
    nothing = n <= 0
    for part in (base, model, sim):
        if part is not None:
            nothing = nothing & part.isNull()
    return F.when(nothing, 0.5).otherwise(changed)


def result_confidence(
    rate: Column, n: Column, has_conflicts: Column, step_count: Column,
    model: Column | None = None, anomaly: Column | None = None,
) -> Column:
    conflict = F.when(has_conflicts, 0.4).otherwise(0.0)
    return unified_confidence(rate, n, conflict, model=model, anomaly=anomaly, steps=step_count)


def is_high_confidence(c: Column | str, n: Column | str) -> Column:
    return (col(c) >= fv.HIGH_CONFIDENCE) & (col(n) >= fv.MIN_FEEDBACK)


def has_significant_conflicts(c: Column | str) -> Column:
    return col(c) > fv.CONFLICT_THRESHOLD


def combine(*parts: Column | str) -> Column:
    """Mean of the positive predictions, 0.5 when there is none."""
    total, n = F.lit(0.0), F.lit(0)
    for p in parts:
        total = total + F.when(col(p) > 0, col(p)).otherwise(0.0)
        n = n + F.when(col(p) > 0, 1).otherwise(0)
    return F.when(n > 0, F.try_divide(total, n)).otherwise(0.5)


def vector_score(sim: Column | str, conf: Column | str, n: Column | str) -> Column:
    return col(sim) + F.when(col(conf) > 0.8, 0.1).otherwise(0.0) + F.least(F.lit(0.1), col(n) * 0.01)


def index_score(sim: Column | str, conf: Column | str) -> Column:
    return col(sim) * (0.7 + col(conf) * 0.3)


def fuzzy_total(fuzzy: Column, ngram: Column, text: Column, query: Column) -> Column:
    """Fuzzy score plus 0.3 when the raw text holds the lower-cased query, plus a fifth of the n-gram score."""
    return fuzzy + F.when(F.contains(text, F.lower(query)), 0.3).otherwise(0.0) + ngram * 0.2


def tree_confidence(values: list[Column | str], predicted: Column | str) -> Column:
    """tanh of the mean absolute feature, damped for class 0, kept in [0.3, 0.95]."""
    total = F.lit(0.0)
    for v in values:
        total = total + F.abs(col(v))
    raw = F.tanh(total / len(values))
    return F.greatest(F.lit(0.3), F.least(F.lit(0.95), F.when(col(predicted) == 0, raw * 0.8).otherwise(raw)))


def neural_confidence(success: Column, failure: Column) -> Column:
    total = success + failure
    p = F.when(total > 0, F.try_divide(success, total)).otherwise(success)
    return F.abs(p - 0.5) * 2


def neural_works(success: Column, failure: Column) -> Column:
    total = success + failure
    return F.when(total > 0, F.try_divide(success, total)).otherwise(success) > 0.5


def guidance(
    conf: Column, steps: Column, conflicts: Column, n: Column, error_text: Column,
    anomaly: Column, works: Column, neural_conf: Column,
) -> tuple[Column, Column, Column]:
    """Guidance score, level and joined reasons from seven criteria."""
    category = categorize(error_text)
    hits = [
        (conf < 0.6, 2),
        (steps >= 4, 1),
        (anomaly, 2),
        (conflicts, 1),
        (n == 0, 1),
        (category.isin(fv.GUIDANCE_CATEGORIES), 1),
        (~works & (neural_conf > 0.7), 2),
    ]
    score, reasons = F.lit(0), []
    for (hit, points), text in zip(hits, fv.GUIDANCE_REASONS):
        hit = F.coalesce(hit, F.lit(False))
        score = score + F.when(hit, points).otherwise(0)
        before, _, after = text.partition("{category}")
        label = F.concat(F.lit(before), category, F.lit(after)) if after else F.lit(text)
        reasons.append(F.when(hit, label))
    level = F.when(score >= 4, "auto").when(score >= 2, "recommended").when(score >= 1, "available").otherwise("none")
    return score, level, F.concat_ws(", ", *reasons)
