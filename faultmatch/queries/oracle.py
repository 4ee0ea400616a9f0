"""Building blocks of the DuckDB statements the queries are checked against."""

from __future__ import annotations

import re

from faultmatch import fixed_values as fv
from faultmatch.sources.fixtures import AS_OF, VIEWS

TS = f"TIMESTAMP '{AS_OF}'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def view(name: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def norm(x: str) -> str:
    out = f"lower(coalesce({x}, ''))"
    for pattern, replacement in fv.NORMALIZE_REWRITES:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return f"trim({out})"


def words(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def ordered_distinct(x: str) -> str:
    """Distinct elements in first-seen order of a list column."""
    return f"list_filter({x}, lambda x, i: list_position({x}, x) = i)"


def tokens(x: str) -> str:
    found = f"list_filter(regexp_extract_all({x}, '[a-z0-9\\-]{{4,}}'), lambda x: NOT list_contains({words(fv.STOP_WORDS)}, x))"
    return ordered_distinct(found)


def expand(x: str) -> str:
    cases = []
    for key, group in fv.SYNONYM_GROUPS.items():
        singles = [w for w in [key, *group] if " " not in w]
        cases.append(f"WHEN w IN ({', '.join(lit(s) for s in singles)}) THEN {words([key, *group])}")
    lists = f"list_transform(string_split(lower({x}), ' '), lambda w: CASE {' '.join(cases)} ELSE [] END)"
    return f"list_concat([lower({x})], flatten({lists}))"


def long_words(x: str) -> str:
    return f"list_filter(string_split(lower({x}), ' '), lambda w: length(w) > 2)"


def similarity(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})))"


def fuzzy(q: str, t: str, qw: str, tw: str, ex: str) -> str:
    """Fuzzy score of lower-cased texts with ready word and expansion lists."""
    s = similarity("w", "v")
    best = (
        f"coalesce(list_max(list_transform({tw}, lambda v: CASE WHEN v = w THEN 0.9::DOUBLE "
        f"WHEN {s} > 0.8 THEN {s} * 0.7 ELSE 0.0 END)), 0.0)"
    )
    total = f"coalesce(list_sum(list_transform({qw}, lambda w: {best})), 0.0)"
    bonus = f"CASE WHEN len(list_filter({ex}, lambda e: contains({t}, e))) > 0 THEN 0.5 ELSE 0.0 END"
    return (
        f"CASE WHEN contains({t}, {q}) THEN 1.0::DOUBLE ELSE "
        f"least(1.0::DOUBLE, ({total} + {bonus}) / greatest(1, len({qw}))) END"
    )


def word_sums(name: str, texts: str, needs: list[str], rows: str, fields: list[str]) -> None:
    """Define ``<name>_fz``: (qid, xid, fz), the fuzzy scores above 0 of the texts of ``texts`` (q) and the field values of ``rows``.

    ``<name>_q`` numbers the texts, ``<name>_x`` the values.  ``<name>_tok`` has
    the pairs in which the value holds a keyword of the text.  Each pair of words, terms and values is compared once.
    """
    define(
        f"{name}_q",
        f"""SELECT *, {tokens("array_to_string(ex, ' ')")} AS toks FROM (SELECT row_number() OVER (ORDER BY q) AS qid, q, lower(q) AS lq,
        {long_words('q')} AS qw, {grams('q')} AS qg, {ordered_distinct('raw_ex')} AS ex FROM (SELECT q, {expand('q')} AS raw_ex FROM ({texts})))""",
        needs,
    )
    values = " UNION ".join(f"SELECT {f} AS x FROM {rows}" for f in fields)
    define(
        f"{name}_x",
        f"""SELECT row_number() OVER (ORDER BY x) AS xid, x, lower(x) AS lx, {long_words('x')} AS xw, {grams('x')} AS xg FROM ({values})""",
        [rows],
    )
    define(
        f"{name}_sums",
        f"""SELECT qid, xid, sum(times * val) AS ws FROM (
        SELECT qid, w, any_value(times) AS times, xid, max(val) AS val FROM (SELECT qid, w, count(*) AS times FROM (SELECT qid, unnest(qw) AS w FROM {name}_q) GROUP BY qid, w)
        JOIN (SELECT w, v, CASE WHEN w = v THEN 0.9::DOUBLE ELSE s * 0.7 END AS val FROM (SELECT w, v, {similarity('w', 'v')} AS s
          FROM (SELECT DISTINCT unnest(qw) AS w FROM {name}_q), (SELECT DISTINCT unnest(xw) AS v FROM {name}_x)) WHERE w = v OR s > 0.8) USING (w)
        JOIN (SELECT DISTINCT xid, v FROM (SELECT xid, unnest(xw) AS v FROM {name}_x)) USING (v) GROUP BY qid, w, xid) GROUP BY qid, xid""",
        [f"{name}_q", f"{name}_x"],
    )

    def holding(column: str) -> str:
        held = f"SELECT e, xid FROM (SELECT DISTINCT unnest({column}) AS e FROM {name}_q), {name}_x WHERE contains(lx, e)"
        return f"SELECT DISTINCT qid, xid FROM (SELECT qid, unnest({column}) AS e FROM {name}_q) JOIN ({held}) USING (e)"

    define(f"{name}_tok", holding("toks"), [f"{name}_q", f"{name}_x"])
    define(
        f"{name}_fz",
        f"""SELECT qid, xid, CASE WHEN whole THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (ws + bonus) / greatest(1, len(qw))) END AS fz FROM (
        SELECT qid, xid, max(ws) AS ws, max(bonus) AS bonus, bool_or(whole) AS whole FROM (
          SELECT qid, xid, ws, 0.0::DOUBLE AS bonus, false AS whole FROM {name}_sums UNION ALL SELECT qid, xid, 0.0, 0.5, false FROM ({holding('ex')})
          UNION ALL SELECT qid, xid, 0.0, 0.0, true FROM {name}_q, {name}_x WHERE contains(lx, lq)) GROUP BY qid, xid) JOIN {name}_q USING (qid)""",
        [f"{name}_sums"],
    )


def grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substring(lower({x}), i::INT, 3)))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return (
        f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {shared}::DOUBLE / (len({a}) + len({b}) - {shared}) ELSE 0.0 END"
    )


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x::DOUBLE / sqrt({dot(v, v)}))"


def confidence(rate: str, n: str, conflict: str) -> str:
    return (
        f"(CASE WHEN {n} = 0 THEN 0.5::DOUBLE ELSE {rate} END) * "
        f"(CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {n} / 5.0::DOUBLE) END) * "
        f"greatest(0.0::DOUBLE, 1.0::DOUBLE - ({conflict}) * 2)"
    )


def first_contained(x: str, table, default: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains({x}, {lit(w)})' for w in ws)} THEN {lit(label)}" for label, ws in table
    )
    return f"CASE {cases} ELSE {lit(default)} END"


def label_of(x: str, table: dict[str, str], default: str | None = None) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {x} {cases} ELSE {x if default is None else lit(default)} END"


HELPFUL = "CASE WHEN was_helpful THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"

CTE = {
    name: f"{name} AS MATERIALIZED ({view(name)})" for name in VIEWS
} | {
    "kb": f"""kb AS MATERIALIZED (SELECT *, sha256(error_signature) AS error_hash,
  list_filter(string_split(steps_text, chr(10)), lambda s: trim(s) <> '') AS resolution_steps
  FROM (SELECT *, {norm('error_text')} AS error_signature FROM kb_raw))""",
    "kbv": """kbv AS MATERIALIZED (SELECT kb.*, e.embedding FROM kb
  LEFT JOIN embeddings e ON CAST(e.vec_id AS STRING) = kb.kb_id)""",
    "fb": """fb AS MATERIALIZED (SELECT f.*, k.error_hash AS solution_hash, k.error_signature
  FROM feedback_raw f JOIN kb k USING (kb_id))""",
    "stats": f"""stats AS MATERIALIZED (SELECT solution_hash, avg({HELPFUL}) AS success_rate, count(*) AS feedback_count,
  avg(CASE WHEN was_helpful THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS conflict_rate FROM fb GROUP BY solution_hash)""",
    "kbs": """kbs AS MATERIALIZED (SELECT kb.*, s.success_rate AS raw_rate, coalesce(s.success_rate, 0.5) AS success_rate,
  coalesce(s.feedback_count, 0) AS feedback_count, coalesce(s.conflict_rate, 0.0) > 0.3 AS has_conflicts
  FROM kb LEFT JOIN stats s ON kb.error_hash = s.solution_hash)""",
    "inc": f"""inc AS MATERIALIZED (SELECT *, sha256(signature) AS error_hash
  FROM (SELECT *, {norm('raw_text')} AS signature FROM incoming))""",
    "sec": f"""sec AS MATERIALIZED (SELECT *, {label_of('event_type', fv.EVENT_SEVERITY, 'INFO')} AS severity
  FROM security_raw)""",
    "taught": f"""taught AS MATERIALIZED (SELECT *, sha256(error_signature) AS error_hash FROM (
  SELECT *, {norm('raw_text')} AS error_signature,
    list_filter(string_split(replace(steps_text, chr(13), ''), chr(10)), lambda s: trim(s) <> '') AS steps
  FROM teachings) WHERE len(steps) > 0)""",
}
NEEDS = {
    "kb": ["kb_raw"],
    "kbv": ["kb"],
    "fb": ["feedback_raw", "kb"],
    "stats": ["fb"],
    "kbs": ["kb", "stats"],
    "inc": ["incoming"],
    "incoming": ["kb_raw"],
    "teachings": ["kb_raw"],
    "taught": ["teachings"],
    "sec": ["security_raw"],
}


def define(name: str, body: str, needs: list[str]) -> None:
    """Add a common table expression for other statements to build on."""
    CTE[name] = f"{name} AS MATERIALIZED ({body})"
    NEEDS[name] = needs


def sql(body: str, *needs: str) -> str:
    """``body`` preceded by the named expressions and everything they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return ("WITH " + ",\n".join(CTE[n] for n in order) + "\n" if order else "") + body
