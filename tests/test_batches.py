"""Nearest centres, bucket products, gram counts and rewrites in batches, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.functions import scoring as sc, similarity as sim, text as tx
from faultmatch.operators import clusters as cl, net as nt, vectors as ve


def test_nearest_centre_is_never_null_and_that_of_the_first_of_equals(spark):
    width = len(sc.FEATURE_NAMES)
    centres = cl.Centres([3, 5, 8], [[0.0] * width, [4.0] * width, [4.0] * width])
    points = [[0.5] * width, [2.0] * width, [4.0] * width, [None] + [4.0] * (width - 1)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, " + ", ".join(f"{n} double" for n in sc.FEATURE_NAMES))
    near = cl.assign(rows, centres)
    assert not near.schema["cluster"].nullable
    found = [(r["cluster"], r["distance"]) for r in near.orderBy("i").collect()]
    assert [c for c, _ in found] == [3, 3, 5, 3]
    assert [d for _, d in found] == [pytest.approx(0.5 * width**0.5), pytest.approx(2 * width**0.5), 0.0, None]


def test_fixed_centres_are_worked_out_once(fixtures):
    from faultmatch.queries import learning

    assert learning.centres(fixtures) is learning.centres(fixtures)


@pytest.mark.parametrize("block_rows", [7, 32768])
def test_bucket_products_are_those_of_all_pairs(spark, block_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8)) * 0.2
    vectors = np.repeat(base, 6, axis=0) + rng.normal(size=(72, 8)) * 0.01
    vectors[1::6] = vectors[::6]
    rows = [(f"k{i:02d}", f"h{i % 5}", None if i % 11 == 3 else i % 7 / 7, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [("long", "h", 1.0, [1.0] * 9), ("empty", "h", 1.0, [])]
    schema = "kb_id string, error_hash string, confidence_score double, embedding array<float>"
    kb = spark.createDataFrame(rows, schema)
    queries = kb.select(F.concat(F.lit("q"), "kb_id").alias("query_id"), "embedding")
    found = ve.bucket_matches(queries, kb, 3, block_rows=block_rows)

    q, k = (df.filter(F.size("embedding") > 0).withColumn("u", sim.l2_normalize("embedding")).withColumn("b", sim.lsh_buckets("embedding")) for df in (queries, kb))
    pairs = q.crossJoin(k.withColumnsRenamed({"u": "v", "b": "c", "embedding": "e"})).filter(F.exists(F.zip_with("b", "c", lambda x, y: x == y), lambda x: x))
    cosine = F.when(F.size("u") == F.size("v"), sim.dot("u", "v")).otherwise(0.0)
    pairs = pairs.select("query_id", "kb_id", "error_hash", "confidence_score", cosine.alias("similarity")).filter("similarity >= 0.7")
    score = F.round(F.col("similarity") * (0.7 + F.col("confidence_score") * 0.3), 9)
    plain = ve.top_k(pairs, ["query_id"], [score.desc(), F.col("error_hash"), F.col("kb_id")], 3, "rank")
    a, b = (sorted((r["query_id"], r["rank"], r["kb_id"], round(r["similarity"], 9)) for r in d.collect()) for d in (found, plain))
    assert a == b and len(a) > 72


def test_gram_counts_are_of_code_points(spark):
    texts = ["Disk failed", "disk\nfailed", "a\U0001f600b\U0001f600a\U0001f600b", "ab", "", None, "\u0130stanbul"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    rows = rows.select(F.lower("a").alias("a"), F.lower("b").alias("b")).withColumn("both", sim.ngram_overlap("a", "b")).withColumn("share", sim.ngram_similarity("a", "b"))
    for r in rows.collect():
        if r["a"] is None or r["b"] is None:
            assert (r["both"]["shared"], r["both"]["joint"], r["share"]) == (None, None, 0.0)
            continue
        g, h = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (r["a"], r["b"]))
        assert (r["both"]["shared"], r["both"]["joint"]) == (len(g & h), len(g | h))
        assert r["share"] == (len(g & h) / len(g | h) if g | h else 0.0)


def test_rewrites_that_are_passed_over_would_have_found_nothing(spark):
    pieces = [
        "Exec [dbo].[p x] now", "execute  sp_help", "EXEC a.b", "c:\\temp\\x y.log", "corp\\ann.b$ ", "Login failed for user  'x y'", "ops@corp.example.com",
        "123e4567-e89b-12d3-a456-426614174000", "12 x34 5", "\u0663\u0664 \u00e9t\u00e9 \u01c5", "a\u00a0 b\u2003c\t\td\r\ne", "_-_ \u200d -- 7", "\U0001f600!", "  ", "",
    ]
    texts = pieces + [a + s + b for a in pieces for b in pieces for s in (" ", "", "\u3000")]
    out = F.lower("t")
    for pattern, replacement in fv.NORMALIZE_REWRITES:
        out = F.regexp_replace(out, "(?U)" + pattern, replacement)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(tx.normalize("t") != F.trim(out)).collect() == []
    assert not rows.select(tx.normalize("t").alias("n")).schema["n"].nullable
    assert set(tx.REWRITE_NEEDS) | set(tx.REWRITE_FORMS) == {p for p, _ in fv.NORMALIZE_REWRITES}
    marks = F.length(F.regexp_replace("t", r"(?U)[\p{L}\p{Nd}\s]", ""))
    assert rows.filter(sc.special_chars("t") != marks).count() == 0


def test_a_step_of_the_net_starts_few_tasks(spark):
    assert [nt.tasks_for(n, 12) for n in (0, 1, 20_001, 10**6, 6 * 10**6, 10**8)] == [1, 1, 2, 12, 12, 200]
    points = spark.range(0, 400, 1, 40).select(
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("double").alias("label"), F.lit(1.0).alias("weight")
    )
    group = spark.sparkContext
    group.setJobGroup("net", "net")
    nt.fit(points, ["x"], [1, 2, 2], np.array([3.0]), np.array([2.0]), 1, 3)
    tracker = group.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("net") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numTasks == 1 for s in stages if s) >= 3 and sum(s.numTasks == 40 for s in stages if s) <= 2
    group.setLocalProperty("spark.jobGroup.id", None)
