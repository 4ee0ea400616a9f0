"""E1-E10, G10-G12, A4: input classification and the audit log."""

from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import security as sec
from faultmatch.operators import audit
from faultmatch.queries import oracle as o
from faultmatch.queries.base import register
from faultmatch.sources import tables
from faultmatch.sources.fixtures import AS_OF

ERR = f"regexp_matches(raw_text, {o.lit('(?i)' + fv.ERROR_MESSAGE_PATTERN)})"
INJ = f"regexp_matches(raw_text, {o.lit('(?i)' + fv.SQL_INJECTION_PATTERN)})"
XSS = f"regexp_matches(raw_text, {o.lit('(?i)' + fv.XSS_PATTERN)})"
STRICT = f"regexp_matches(raw_text, {o.lit('(?i)' + fv.STRICT_SQL_PATTERN)})"


def commands(values, x="raw_text"):
    return "(" + " OR ".join(f"contains(lower({x}), {o.lit(v)})" for v in values) + ")"


def sanitized(x):
    for old, new in fv.SANITIZE_REPLACEMENTS:
        x = f"replace({x}, {o.lit(old)}, {o.lit(new)})"
    return f"trim({x})"


o.define(
    "recent",
    """SELECT i.query_id, count(s.event_id) AS recent_queries FROM incoming i
    LEFT JOIN security_raw s ON s.user_id = i.user_id AND s.event_type IN ('QUERY', 'SEARCH')
      AND s.created_at >= i.ts - INTERVAL 24 HOURS AND s.created_at <= i.ts GROUP BY i.query_id""",
    ["incoming", "security_raw"],
)
MESSAGES = o.label_of("verdict", fv.VERDICT_MESSAGES, "~").replace("ELSE '~'", "ELSE NULL")
o.define(
    "checked",
    f"""SELECT *, {MESSAGES} AS message, verdict IN ('ERROR_ANALYSIS', 'QUERY') AS is_valid,
    CASE WHEN verdict = 'QUERY' THEN {sanitized('raw_text')} ELSE raw_text END AS clean_text FROM (
    SELECT i.*, r.recent_queries, CASE WHEN trim(raw_text) = '' THEN 'EMPTY'
    WHEN NOT {ERR} AND {INJ} THEN 'SQL_INJECTION_ATTEMPT' WHEN {XSS} THEN 'XSS_ATTEMPT'
    WHEN NOT {ERR} AND {commands(fv.DANGEROUS_COMMANDS)} THEN 'DANGEROUS_COMMAND'
    WHEN recent_queries >= 1000 THEN 'RATE_LIMIT_EXCEEDED' WHEN {ERR} THEN 'ERROR_ANALYSIS' ELSE 'QUERY' END AS verdict
    FROM incoming i JOIN recent r USING (query_id))""",
    ["incoming", "recent"],
)
o.define(
    "checked_strict",
    f"""SELECT *, {MESSAGES} AS message, verdict = 'ACCEPTED' AS is_valid,
    CASE WHEN verdict = 'ACCEPTED' THEN {sanitized('raw_text')} ELSE raw_text END AS clean_text FROM (
    SELECT i.*, r.recent_queries, CASE WHEN trim(raw_text) = '' THEN 'EMPTY'
    WHEN {STRICT} THEN 'SQL_INJECTION_ATTEMPT' WHEN {XSS} THEN 'XSS_ATTEMPT'
    WHEN {commands(fv.DANGEROUS_COMMANDS_STRICT)} THEN 'DANGEROUS_COMMAND'
    WHEN recent_queries >= 1000 THEN 'RATE_LIMIT_EXCEEDED' ELSE 'ACCEPTED' END AS verdict
    FROM incoming i JOIN recent r USING (query_id))""",
    ["incoming", "recent"],
)
EVENTS = f"""SELECT *, {o.label_of('event_type', fv.EVENT_SEVERITY, 'INFO')} AS severity FROM (
  SELECT query_id AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at, verdict AS event_type,
  coalesce(user_id, 'unknown') AS user_id, coalesce(session_id, 'unknown') AS session_id,
  CASE verdict WHEN 'RATE_LIMIT_EXCEEDED' THEN ''
    WHEN 'ERROR_ANALYSIS' THEN 'SQL error message analyzed' WHEN 'QUERY' THEN 'Validation passed'
    ELSE raw_text END AS details FROM checked WHERE verdict <> 'EMPTY')"""
VERDICT_COLS = ["query_id", "verdict", "is_valid", "message", "clean_text", "recent_queries"]


def verdicts(f, strict=False):
    return audit.validate(f.incoming, f.security_log, strict=strict)


register(
    "a4_security_events",
    lambda f: tables.security_events(verdicts(f)).withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    ),
    o.sql(EVENTS, "checked"),
)
register(
    "e1_validate",
    lambda f: verdicts(f).select(*VERDICT_COLS),
    o.sql(f"SELECT {', '.join(VERDICT_COLS)} FROM checked", "checked"),
)
register(
    "e2_error_message",
    lambda f: f.incoming.select("query_id", sec.is_error_message("raw_text").alias("is_error")),
    o.sql(f"SELECT query_id, {ERR} AS is_error FROM incoming", "incoming"),
)
register(
    "e3_sql_injection",
    lambda f: f.incoming.select("query_id", sec.is_sql_injection("raw_text").alias("is_injection")),
    o.sql(f"SELECT query_id, {INJ} AS is_injection FROM incoming", "incoming"),
)
register(
    "e4_xss",
    lambda f: f.incoming.select(F.concat(F.lit("q"), "query_id").alias("id"), sec.is_xss("raw_text").alias("is_xss"))
    .unionByName(f.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), sec.is_xss("html").alias("is_xss"))),
    o.sql(
        f"""SELECT concat('q', query_id) AS id, {XSS} AS is_xss FROM incoming
        UNION ALL SELECT concat('p', page_id), {XSS.replace('raw_text', 'html')} FROM pages""",
        "incoming",
    ),
)
register(
    "e5_commands",
    lambda f: f.incoming.select(
        F.concat(F.lit("q"), "query_id").alias("id"),
        sec.has_command("raw_text").alias("has_command"),
        sec.has_command("raw_text", strict=True).alias("has_strict_command"),
    ).unionByName(
        f.documents.select(
            F.concat(F.lit("d"), "doc_id").alias("id"),
            sec.has_command("text").alias("has_command"),
            sec.has_command("text", strict=True).alias("has_strict_command"),
        )
    ),
    o.sql(
        f"""SELECT concat('q', query_id) AS id, {commands(fv.DANGEROUS_COMMANDS)} AS has_command,
        {commands(fv.DANGEROUS_COMMANDS_STRICT)} AS has_strict_command FROM incoming
        UNION ALL SELECT concat('d', doc_id), {commands(fv.DANGEROUS_COMMANDS, 'text')},
        {commands(fv.DANGEROUS_COMMANDS_STRICT, 'text')} FROM documents""",
        "incoming",
    ),
)
register(
    "e6_validate_strict",
    lambda f: verdicts(f, strict=True).select(*VERDICT_COLS),
    o.sql(f"SELECT {', '.join(VERDICT_COLS)} FROM checked_strict", "checked_strict"),
)
register(
    "e7_sanitize",
    lambda f: f.incoming.select("query_id", sec.sanitize("raw_text").alias("clean")),
    o.sql(f"SELECT query_id, {sanitized('raw_text')} AS clean FROM incoming", "incoming"),
)
register(
    "e8_event_types",
    lambda f: verdicts(f).select("query_id", sec.event_type("verdict").alias("event_type"),
                                 sec.event_details("verdict", "raw_text").alias("details")),
    o.sql(
        f"""SELECT c.query_id, e.event_type, e.details FROM checked c LEFT JOIN ({EVENTS}) e ON e.event_id = c.query_id""",
        "checked",
    ),
)
register(
    "e9_severity",
    lambda f: f.security_log.select(
        "event_id", "severity", sec.severity("event_type", strict=True).alias("strict_severity")
    ),
    o.sql(
        f"""SELECT event_id, severity, {o.label_of('event_type', fv.EVENT_SEVERITY_STRICT, 'LOW')} AS strict_severity FROM sec""",
        "sec",
    ),
)
register(
    "e10_threat_level",
    lambda f: audit.log_stats(f.security_log, F.date_format("created_at", "yyyy-MM-dd HH").alias("hour")).select(
        "hour",
        sec.threat_level("high_severity", "medium_severity").alias("threat_level"),
        sec.has_threats("high_severity", "sql_attempts").alias("has_threats"),
    ),
    o.sql(
        """SELECT hour, CASE WHEN high > 10 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' WHEN medium > 20 THEN 'MEDIUM'
        ELSE 'LOW' END AS threat_level, high > 0 OR attempts > 0 AS has_threats FROM (
        SELECT strftime(created_at, '%Y-%m-%d %H') AS hour, count(*) FILTER (severity = 'HIGH') AS high,
        count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (event_type = 'SQL_INJECTION_ATTEMPT') AS attempts
        FROM sec GROUP BY 1)""",
        "sec",
    ),
)
register(
    "g10_events_last_day",
    lambda f: audit.within(f.security_log, AS_OF, "24 HOURS").agg(F.count("*").alias("events")),
    o.sql(f"SELECT count(*) AS events FROM security_raw WHERE created_at >= {o.TS} - INTERVAL 24 HOURS", "security_raw"),
)
register(
    "g11_security_stats",
    lambda f: audit.log_stats(audit.within(f.security_log, AS_OF, "24 HOURS")),
    o.sql(
        f"""SELECT count(*) AS total_events, sum(CASE WHEN severity = 'HIGH' THEN 1 ELSE 0 END) AS high_severity,
        sum(CASE WHEN severity = 'MEDIUM' THEN 1 ELSE 0 END) AS medium_severity,
        sum(CASE WHEN event_type = 'SQL_INJECTION_ATTEMPT' THEN 1 ELSE 0 END) AS sql_attempts,
        sum(CASE WHEN event_type = 'RATE_LIMIT_EXCEEDED' THEN 1 ELSE 0 END) AS rate_limits
        FROM sec WHERE created_at >= {o.TS} - INTERVAL 24 HOURS""",
        "sec",
    ),
)


def _sliding(f):
    events = f.security_log.filter(F.col("event_type").isin(fv.RATE_LIMITED_TYPES))
    requests = events.select(F.col("event_id").alias("query_id"), "user_id", F.col("created_at").alias("ts"))
    counts = audit.recent_counts(requests, f.security_log)
    # a request's own log row is written after its check
    earlier = (F.col("recent_queries") - 1).alias("earlier_queries")
    return counts.select(F.col("query_id").alias("event_id"), earlier).withColumn(
        "allowed", F.col("earlier_queries") < fv.MAX_DAILY_QUERIES
    )


register(
    "g12_rate_limit",
    _sliding,
    o.sql(
        """SELECT event_id, n - 1 AS earlier_queries, n - 1 < 1000 AS allowed FROM (
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY created_at
          RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n
        FROM security_raw WHERE event_type IN ('QUERY', 'SEARCH'))""",
        "security_raw",
    ),
)
register(
    "g12_rate_limit_as_of",
    lambda f: audit.counts_as_of(f.security_log, AS_OF).withColumn(
        "allowed", F.col("recent_queries") < fv.MAX_DAILY_QUERIES
    ),
    o.sql(
        f"""SELECT user_id, count(*) AS recent_queries, count(*) < 1000 AS allowed FROM security_raw
        WHERE event_type IN ('QUERY', 'SEARCH') AND created_at >= {o.TS} - INTERVAL 24 HOURS AND created_at <= {o.TS}
        GROUP BY user_id""",
        "security_raw",
    ),
)
