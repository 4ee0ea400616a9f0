"""Work that several steps need is done once, and once for equal texts; pairs that cannot win are not scored."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from faultmatch.functions import similarity as sim
from faultmatch.operators import audit, best_match as bm
from faultmatch.plans import matching as mt
from test_best_match import asked, knowledge, overlap


def test_rows_that_only_hold_a_synonym_are_not_scored(spark, monkeypatch):
    """All rows hold a synonym of every text, which needs none of their words; few of them can reach the least score."""
    texts = [f"unexpected error in module item{k:05d}" for k in range(3000)] + ["<script> failed customer 0007 error page"]
    kb = knowledge(spark, texts, [0.0] * 3000 + [1.0]).withColumn("feedback_count", F.lit(20).cast("long"))
    queries = asked(spark, [f"<script> failed customer {k:04d}" for k in range(60)])
    counts = []
    plain = bm.scored
    monkeypatch.setattr(bm, "scored", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs, *rest))[1])
    got = {r["query_id"]: r["error_hash"] for r in mt.fuzzy_match(queries, kb).collect()}
    assert got == {f"q{k:04d}": "h03000" for k in range(60)}
    assert sum(counts) < 0.1 * 60 * 3000


def test_keywords_are_found_once_for_equal_texts(spark):
    """What texts are filtered by is not pushed below their grouping, nor over to the queries that have them."""
    queries = asked(spark, ["pool disk page"] * 50)
    plan = mt._with_keywords(queries, "clean_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    kb = knowledge(spark, ["pool disk page"])
    texts = mt._with_keywords(queries, "clean_text")
    best = texts.select("text_id", F.lit("k00000").alias("kb_id"), F.lit(1.0).alias("score"))
    answers = mt._answers(queries, "clean_text", texts, best, kb)
    assert "regexp_extract_all" not in answers._jdf.queryExecution().optimizedPlan().toString()
    assert answers.count() == 50


def test_a_report_judges_its_input_once(spark, monkeypatch):
    calls = []
    plain = audit.validate
    monkeypatch.setattr(audit, "validate", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    entry.queries()["m20_report"](spark, SF)
    assert len(calls) == 1


def test_trigrams_as_numbers_are_those_of_the_text(spark):
    rows = [(0, "abcabc"), (1, "ab"), (2, ""), (3, None), (4, "naïve 你好吗 x"), (5, "page page page")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("t", sim.trigram_numbers("text"))
    got = {r.id: r for r in df.select("id", "text", "t.*", sim.ngrams("text").alias("plain")).collect()}
    for r in got.values():
        if r.text is None:
            assert r.codes is None
            continue
        assert sorted(r.codes) == sorted(ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in r.plain)
        flipped = sum(bin(getattr(r, f"b{w}") & (2**64 - 1)).count("1") for w in range(sim.BITMAP))
        assert flipped <= len(r.codes) and flipped % 2 == len(r.codes) % 2
    pairs = [(a, b) for a in (0, 4, 5) for b in (0, 4, 5)]
    both = spark.createDataFrame([(got[a].text, got[b].text) for a, b in pairs], "a string, b string")
    both = both.withColumns({"x": sim.trigram_numbers("a")["codes"], "y": sim.trigram_numbers("b")["codes"]})
    shares = both.select("a", "b", sim.jaccard("x", "y").alias("s")).collect()
    assert all(abs(r.s - overlap(r.a, r.b)) < 1e-12 for r in shares)
