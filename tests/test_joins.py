"""Blocked joins against brute force, with hot keys and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from faultmatch.functions import similarity as sim, text as tx
from faultmatch.operators import candidates as ca, feedback as fb, knowledge as kn, ngram_join as ng, ranking as rk, vectors as ve
from faultmatch.session import in_broadcastable_slices

WORDS = ["timeout", "connect", "reconnect-x", "pool", "pooling", "disk", "diskfull", "page", "pages", "0001", "00011", "io"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="module")
def kb(spark):
    rows = []
    for i, t in enumerate(random_texts(150, 1) + ["hot pool disk"] * 75):
        rows.append((str(i), "h%03d" % (i % 140), t, t.upper(), None if i % 3 else i / 300, i))
    df = spark.createDataFrame(rows, "kb_id string, error_hash string, error_signature string, error_text string, raw_rate double, s int")
    return df.withColumn("created_at", F.timestamp_seconds(F.col("s"))).drop("s").persist()


def by_rate(row):
    return (row["raw_rate"] is None, -(row["raw_rate"] or 0), -row["created_at"].timestamp(), row["error_hash"], row["kb_id"])


def test_any_token_equals_brute_force(spark, kb):
    lists = [["pool"], ["disk", "page"], ["0001"], ["connect", "timeout", "pages"], ["absent"]]
    terms = spark.createDataFrame([(x,) for x in lists], "tokens array<string>")
    got = {}
    for r in ca.any_token(terms, kb, ["error_text"], ca.by_rate(), 7).orderBy("rank").collect():
        got.setdefault(r["terms_key"], []).append(r["kb_id"])
    rows = sorted(kb.collect(), key=by_rate)
    want = {}
    for x in lists:
        hit = [r["kb_id"] for r in rows if any(t in r["error_text"].lower() for t in x)][:7]
        if hit:
            want[" ".join(x)] = hit
    assert got == want


def test_all_tokens_equals_brute_force(spark, kb):
    lists = [["pool"], ["pool", "disk"], ["page", "0001"], ["pool", "absent"], ["connect", "timeout"]]
    # one signature per hash, as fingerprints guarantee
    kb = kb.withColumn("error_hash", tx.fingerprint("error_signature"))
    terms = spark.createDataFrame([(x,) for x in lists], "tokens array<string>")
    got = {r["terms_key"]: r["kb_id"] for r in ca.all_tokens(terms, kb, ca.by_rate(), 1).collect()}
    rows = sorted(kb.collect(), key=by_rate)
    want = {}
    for x in lists:
        hit = [r["kb_id"] for r in rows if all(t in r["error_signature"] for t in x)]
        if hit:
            want[" ".join(x)] = hit[0]
    assert got == want


def test_containing_equals_brute_force(spark, kb):
    needles = ["pool disk", "ool di", "k", "io", "pool disk page", "hot pool disk", "t pool d", "onnect timeout p", "zzz", "dis"]
    needles += [t for t in random_texts(20, 3)]
    texts = spark.createDataFrame([(n,) for n in set(needles)], "needle string")
    got = {}
    for r in ca.containing(texts, kb, ca.by_rate(), 5).orderBy("rank").collect():
        got.setdefault(r["needle"], []).append(r["kb_id"])
    rows = sorted(kb.collect(), key=by_rate)
    want = {}
    for n in set(needles):
        hit = [r["kb_id"] for r in rows if n in r["error_signature"].lower() or n in r["error_text"].lower()][:5]
        if hit:
            want[n] = hit
    assert got == want


def test_ngram_join_equals_brute_force(spark):
    left, right = random_texts(60, 5) + ["ab", ""], random_texts(60, 6) + random_texts(10, 5)
    l = spark.createDataFrame([(t,) for t in left], "text string")
    r = spark.createDataFrame([(t,) for t in right], "text string")
    grams = lambda s: {s[i:i + 3] for i in range(len(s) - 2)}
    for t in (0.3, 0.6, 1.0):
        got = {(x["left_text"], x["right_text"]) for x in ng.ngram_join(l, r, t).collect()}
        want = set()
        for a in set(left):
            for b in set(right):
                x, y = grams(a), grams(b)
                if x and y and len(x & y) / len(x | y) >= t:
                    want.add((a, b))
        assert got == want


def test_ngram_similarity_is_symmetric(spark, fixtures):
    pairs = fixtures.kb_texts.select("error_text", F.reverse("error_text").alias("b"))
    rows = pairs.select(sim.ngram_similarity("error_text", "b").alias("x"), sim.ngram_similarity("b", "error_text").alias("y")).collect()
    assert all(r["x"] == r["y"] and 0 <= r["x"] <= 1 for r in rows)


def test_near_words_equals_brute_force(spark):
    rng = random.Random(9)
    base = ["connection", "conection", "connections", "timeout", "timeouts", "page", "pages", "abcdefghijk", "abcdxfghijk", "aaaaaa"]
    words = sorted({w[:i] + rng.choice("abcx") + w[i + 1:] for w in base for i in range(len(w))} | set(base))
    a = spark.createDataFrame([(w,) for w in words], "word string")
    b = spark.createDataFrame([(w,) for w in base], "target string")
    got = {(r["word"], r["target"]): round(r["value"], 9) for r in ca.near_words(a, b).collect()}
    want = {}
    pairs = a.crossJoin(b).withColumn("s", sim.similarity("word", "target")).collect()
    for r in pairs:
        if r["word"] == r["target"]:
            want[(r["word"], r["target"])] = 0.9
        elif r["s"] > 0.8:
            want[(r["word"], r["target"])] = round(r["s"] * 0.7, 9)
    assert got == want


def test_vector_join_splits_a_crowded_cell(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    near = centre + 0.4 * rng.normal(size=(60, 16))
    far = rng.normal(size=(60, 16))
    m = np.vstack([near, far])
    kb = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(m)], "kb_id string, embedding array<float>")
    q = kb.select(F.col("kb_id").alias("query_id"), "embedding")
    u = m.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for t in (0.7, 0.2):
        got = {(r["query_id"], r["kb_id"]) for r in ve.vector_join(q, kb, t, pivots=4, block_rows=16).collect()}
        i, j = np.nonzero(u @ u.T >= t)
        assert got == {(str(a), str(b)) for a, b in zip(i, j)}


def test_bucket_candidates_equal_or_join(spark, fixtures):
    q = fixtures.embeddings.select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    kb = fixtures.kb.filter(F.col("embedding").isNotNull())
    got = {(r["query_id"], r["kb_id"]) for r in ve.bucket_candidates(q, kb, 10_000).collect()}
    a = [(r[0], r[1]) for r in q.select("query_id", sim.lsh_buckets("embedding")).collect()]
    b = [(r[0], r[1]) for r in kb.select("kb_id", sim.lsh_buckets("embedding")).collect()]
    assert got == {(x, y) for x, bx in a for y, by in b if any(p == s for p, s in zip(bx, by))}


def test_all_bucket_candidates_are_numbered_without_moving_pairs(spark, fixtures):
    q = fixtures.embeddings.select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    kb = fixtures.kb.filter(F.col("embedding").isNotNull()).withColumn("confidence_score", F.expr("nullif(round(confidence_score, 1), 0.5D)"))
    got = ve.bucket_candidates(q, kb, block_rows=7)
    want = ve.bucket_candidates(q, kb, 10_000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "WindowExec" not in plan and "row_number" not in plan


def test_texts_are_not_worked_out_below_the_spread(spark, fixtures):
    texts = fixtures.incoming.filter("raw_text <> ''").select("query_id", F.lower("raw_text").alias("needle"))
    hits = ca.containing(texts, fixtures.kb_texts, [F.col("kb_id")], None)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter isnotnull(" in line and "sha2(" in line]


def test_running_sums_equal_one_window(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i * 7 % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = rk.running_sums(df, ["k"], [F.col("t"), F.col("id")], F.floor(F.col("t") / 10), {"n": F.lit(1), "s": F.col("id")})
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("n", F.count("*").over(w)).withColumn("s", F.sum("id").over(w))
    assert sorted(map(tuple, got.select("k", "t", "id", "n", "s").collect())) == sorted(map(tuple, want.collect()))


def test_salted_join_equals_join(spark):
    many = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("1", 3)], "k string, v int")
    got = rk.salted_join(many, few, ["k"], "id", 4).select("id", "k", "v")
    want = many.join(few, "k").select("id", "k", "v")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rule_tables_beyond_the_bound_are_sliced(spark):
    rules = spark.range(25).select(F.col("id").cast("string").alias("pattern_id"))
    slices = in_broadcastable_slices(rules, "pattern_id", max_rows=10)
    assert len(slices) > 1
    assert sorted(r[0] for s in slices for r in s.collect()) == sorted(str(i) for i in range(25))


def test_page_and_top_k(spark):
    df = spark.range(25).withColumn("k", F.lit("a"))
    assert [r["id"] for r in rk.page(df, ["k"], [F.col("id")], 10, 2).orderBy("id").collect()] == [20, 21, 22, 23, 24]


def test_teaching_twice_changes_nothing(spark, fixtures):
    taught = fb.taught(fixtures.teachings)
    once = kn.teach(fixtures.kb_texts, taught)
    twice = kn.teach(once, taught)
    steps = lambda df: {r["kb_id"]: r["resolution_steps"] for r in df.collect()}
    assert steps(once) == steps(twice)


def test_null_rating_counts_as_not_helpful(spark):
    df = spark.createDataFrame([("h", None), ("h", True)], "solution_hash string, was_helpful boolean")
    row = fb.solution_stats(df).first()
    assert (row["success_rate"], row["feedback_count"], row["conflict_rate"]) == (0.5, 2, 0.5)
