"""Hand-derived rows with their boundary values."""

import pytest
from pyspark.sql import functions as F

from faultmatch.functions import scoring as sc, security as sec, similarity as sim, text as tx
from faultmatch.operators import audit, series as se


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, expected", [
    ("Login failed for user 'john.doe'", "login failed for user user"),
    ("C:\\MyApp\\Config.xml not found", "path"),
    ("Id 3F2504E0-4F89-11D3-9A0C-0305E82C3301 failed", "id guid failed"),
    ("Error code 42 at 10:30", "error code <num> at <num> <num>"),
    ("EXEC [dbo].[usp_Load] failed", "exec proc failed"),
    ("execute failed", "exec proc"),
    ("CORP\\jdoe denied, mail a.b@c.org", "user denied mail user"),
    ("  Café  ÉTÉ ", "café été"),
    ("   ", ""),
])
def test_normalize(spark, text, expected):
    assert one(spark, tx.normalize(F.lit(text))) == expected


def test_fingerprint_of_null_is_that_of_empty(spark):
    assert one(spark, tx.fingerprint(F.lit(None).cast("string"))) == one(spark, tx.fingerprint(F.lit("")))


def test_tokens(spark):
    text = "connection timeout connection abc failed pool-size retry limit"
    assert one(spark, tx.tokens(F.lit(text))) == ["connection", "timeout", "pool-size", "retry", "limit"]
    assert one(spark, tx.tokens(F.lit(text), 4)) == ["connection", "timeout", "pool-size", "retry"]
    assert one(spark, tx.tokens(F.lit("TimeOut pool"))) == ["pool"]


@pytest.mark.parametrize("text, expected", [
    ('["a","b"]', ["a", "b"]),
    ("1. x\n2. y", ["1. x\n", "2. y"]),
    ("1) x", ["1) x"]),
    ("Do\n- a\n- b", ["Do", "- a", "- b"]),
    ("one\ntwo", ["one\ntwo"]),
    ("one\ntwo\nthree", ["one", "two", "three"]),
    ("one\n\nthree", ["one", "three"]),
    ("", []),
    (" \n", []),
])
def test_split_steps(spark, text, expected):
    assert one(spark, tx.split_steps(F.lit(text))) == expected


def test_numbered_lines(spark):
    assert one(spark, tx.numbered_lines(F.lit("x\n1. a \n - b\n4. c\n-d"))) == ["1. a", "b"]


def test_teach_steps(spark):
    assert one(spark, tx.teach_steps(F.lit("a\r\n\r\n b\n"))) == ["a", " b"]


@pytest.mark.parametrize("text, expected", [
    ("x union select 1", "SQL_INJECTION_ATTEMPT"),
    ("select failed: union select", "ERROR_ANALYSIS"),
    ("<script> error", "XSS_ATTEMPT"),
    ("run xp_cmdshell", "DANGEROUS_COMMAND"),
    ("run xp_cmdshell failed", "ERROR_ANALYSIS"),
    ("hello", "QUERY"),
    (" ", "EMPTY"),
    ("x" * 4001, "EXCESSIVE_LENGTH"),
    ("x" * 4000, "QUERY"),
])
def test_verdict(spark, text, expected):
    assert one(spark, sec.verdict(F.lit(text), F.lit(False))) == expected


def test_verdict_over_limit(spark):
    assert one(spark, sec.verdict(F.lit("hello"), F.lit(True))) == "RATE_LIMIT_EXCEEDED"


@pytest.mark.parametrize("text, expected", [
    ("it's", "SQL_INJECTION_ATTEMPT"), ("an update", "SQL_INJECTION_ATTEMPT"), ("updates", "ACCEPTED"),
    ("error; x", "SQL_INJECTION_ATTEMPT"), ("use bcp", "SQL_INJECTION_ATTEMPT"), ("my bcp", "DANGEROUS_COMMAND"),
])
def test_verdict_strict(spark, text, expected):
    assert one(spark, sec.verdict_strict(F.lit(text), F.lit(False))) == expected


def test_sanitize(spark):
    assert one(spark, sec.sanitize(F.lit("it's <b>;--"))) == "it&amp;#39;s &amp;lt;b&amp;gt;,- -"


def test_rate_limit_applies_to_the_log(spark):
    log = spark.sql("SELECT 'u' AS user_id, 'QUERY' AS event_type, TIMESTAMP'2024-01-01 00:00:00' + id * INTERVAL 1 MINUTE AS created_at FROM range(5)")
    incoming = spark.sql("SELECT CAST(id AS STRING) AS query_id, 'hello' AS raw_text, 'u' AS user_id, 's' AS session_id, TIMESTAMP'2024-01-01 00:02:00' + id * INTERVAL 24 HOURS AS ts FROM range(3)")
    rows = {r["query_id"]: r for r in audit.validate(incoming, log, limit=3).collect()}
    assert rows["0"]["recent_queries"] == 3 and rows["0"]["verdict"] == "RATE_LIMIT_EXCEEDED"
    assert rows["1"]["recent_queries"] == 3 and not rows["1"]["is_valid"]
    assert rows["2"]["recent_queries"] == 0 and rows["2"]["is_valid"]


def test_similarity(spark):
    assert one(spark, sim.similarity(F.lit("conection"), F.lit("connection"))) == pytest.approx(0.9)
    assert one(spark, sim.similarity(F.lit("ABC"), F.lit("abc"))) == 1.0
    assert one(spark, sim.similarity(F.lit(""), F.lit("abc"))) == 0.0


def test_expand(spark):
    assert one(spark, sim.expand(F.lit("Login timeout")))[:4] == ["login timeout", "login", "logon", "signin"]
    assert one(spark, sim.expand(F.lit("timeout"))) == ["timeout", "timed out", "time out", "hung", "freeze", "frozen"]


def test_fuzzy_score(spark):
    assert one(spark, sim.fuzzy_score(F.lit("conection refused"), F.lit("connection refused"))) == pytest.approx(0.765)
    assert one(spark, sim.fuzzy_score(F.lit("conection timeout"), F.lit("connection timeout expired"))) == 1.0
    assert one(spark, sim.fuzzy_score(F.lit(""), F.lit("abc"))) == 1.0
    assert one(spark, sim.fuzzy_score(F.lit("zz"), F.lit("abc"))) == 0.0


def test_ngrams(spark):
    assert one(spark, sim.ngram_similarity(F.lit("abc"), F.lit("ab"))) == 0.0
    assert one(spark, sim.ngram_similarity(F.lit("abcd"), F.lit("ABCD"))) == 1.0
    assert one(spark, sim.ngrams(F.lit("a\nb\nb"))) == ["a\nb", "\nb\n", "b\nb"]


def test_cosine_modes(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0), F.lit(0.0))
    assert one(spark, sim.cosine(a, b, "index")) == 0.0
    assert one(spark, sim.cosine(a, b, "kb")) == pytest.approx(1.0)
    assert one(spark, sim.cosine(F.lit(None).cast("array<double>"), b, "kb")) == -1.0


def test_parse_vector(spark):
    assert one(spark, sim.parse_vector(F.lit("array(1, x, 2.5)"))) == [1.0, 2.5]
    assert one(spark, sim.parse_json_vector(F.lit("[1, 2"))) == []
    assert one(spark, sim.parse_json_vector(F.lit("[1, 2.5]"))) == [1.0, 2.5]


@pytest.mark.parametrize("rate, n, conflict, expected", [(1.0, 1, 0.0, 0.2), (0.5, 0, 0.0, 0.5), (0.8, 10, 0.4, 0.16)])
def test_confidence(spark, rate, n, conflict, expected):
    assert one(spark, sc.confidence(F.lit(rate), F.lit(n), conflict)) == pytest.approx(expected)


@pytest.mark.parametrize("n, steps, expected", [(12, 0, 0.9), (3, 0, 0.745714), (3, 5, 0.820286)])
def test_unified_confidence(spark, n, steps, expected):
    got = one(spark, sc.unified_confidence(F.lit(0.9), F.lit(n), F.lit(0.0), steps=F.lit(steps)))
    assert got == pytest.approx(expected, abs=1e-6)


def test_unified_without_parts_is_neutral(spark):
    assert one(spark, sc.unified_confidence(F.lit(None).cast("double"), F.lit(0), F.lit(0.0), anomaly=F.lit(True))) == 0.5


def test_combine(spark):
    assert one(spark, sc.combine(F.lit(0.0), F.lit(0.4), F.lit(0.8))) == pytest.approx(0.6)
    assert one(spark, sc.combine(F.lit(0.0), F.lit(0.0))) == 0.5


def test_guidance(spark):
    nothing = F.lit(None).cast("boolean")
    score, level, reasons = sc.guidance(
        F.lit(0.5), F.lit(4), F.lit(False), F.lit(0), F.lit("odd"), F.lit(False), nothing, F.lit(None).cast("double")
    )
    assert one(spark, score) == 4 and one(spark, level) == "auto"
    assert one(spark, reasons) == "low confidence solution, complex multi-step solution, unvalidated solution"


def test_error_code(spark):
    assert one(spark, sc.error_code(F.lit("Error: 42"))) == 42
    assert one(spark, sc.error_code(F.lit("code 99999999999"))) == 0
    assert one(spark, sc.error_code(F.lit("nothing"))) == 0


def test_smoothing_and_running_rate(spark):
    hours = spark.sql("SELECT 'c' AS category, TIMESTAMP'2024-01-01 00:00:00' + id * INTERVAL 1 HOUR AS hour, id + 1 AS n FROM range(3)")
    got = [r["smoothed"] for r in se.smoothed(hours).orderBy("hour").collect()]
    assert got == pytest.approx([1.0, 1.3, 1.81])
    steps = spark.createDataFrame([("n", 1, True), ("n", 2, False), ("n", 3, True)], "node string, t int, ok boolean")
    rows = se.running_success(steps, "node", [F.col("t")], F.floor(F.col("t") / 2), F.col("ok")).orderBy("t").collect()
    assert [r["success_rate"] for r in rows] == pytest.approx([1, 0.5, 2 / 3])


def test_seasonality_needs_more_than_a_day(spark):
    hours = spark.sql("SELECT 'c' AS category, TIMESTAMP'2024-01-01 00:00:00' + id * INTERVAL 1 HOUR AS hour, 2L AS n FROM range(24)")
    assert se.seasonality(hours).first()["seasonality"] == 0.0
    assert se.fill_gaps(hours.filter("hour(hour) % 2 = 0")).count() == 23
