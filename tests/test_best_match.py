"""The bounded search for the best row against scoring every pair, beyond the sizes of any candidate list."""

import random

import pytest
from pyspark.sql import functions as F

from faultmatch import fixed_values as fv
from faultmatch.operators import best_match as bm
from faultmatch.plans import matching as mt

VOCABULARY = [
    "timeout", "connection", "connections", "pool", "disk", "page", "corrupt", "permission", "denied", "ledger", "update",
    "deadlock", "syntax", "keyword", "statement", "worker", "process", "io", "a", "retry", "schema", "table", "network",
]


def synonyms(text):
    out = [text.lower()]
    for w in text.lower().split(" "):
        for key, group in fv.SYNONYM_GROUPS.items():
            if w in [x for x in [key, *group] if " " not in x]:
                out += [key, *group]
    return list(dict.fromkeys(out))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def long_words(s):
    return [w for w in s.lower().split(" ") if len(w) > 2]


def fuzzy(q, t):
    q, t = q.lower(), t.lower()
    if q in t:
        return 1.0
    total = 0.0
    targets = set(long_words(t))
    for w in long_words(q):
        if w in targets:
            total += 0.9
        else:
            best = max((1 - levenshtein(w, v) / max(len(w), len(v)) for v in targets), default=0)
            total += 0.7 * best if best > 0.8 else 0
    bonus = 0.5 if any(x in t for x in synonyms(q)) else 0.0
    return min(1.0, (total + bonus) / max(1, len(long_words(q))))


def overlap(a, b):
    x, y = ({s.lower()[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def tokens(text):
    import re

    found = re.findall(fv.TOKEN_PATTERN, " ".join(synonyms(text)))
    return [w for w in dict.fromkeys(found) if w not in fv.STOP_WORDS]


def messages(rng, n):
    out = []
    for _ in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.3:
            k = rng.randrange(len(words))
            words[k] = words[k][:-1] + rng.choice("sxyz") if len(words[k]) > 5 else words[k]
        out.append(" ".join(words))
    return out


def knowledge(spark, texts, rates=None):
    rows = []
    for k, t in enumerate(texts):
        rate = rates[k] if rates else (k * 37 % 100) / 100
        rows.append((f"k{k:05d}", f"h{k:05d}", t, t.upper() if k % 3 else t, f"Step {k}", rate, k % 13, k))
    df = spark.createDataFrame(
        rows, "kb_id string, error_hash string, error_signature string, error_text string, steps_text string, success_rate double, feedback_count long, s int"
    )
    return df.select(
        "*", F.timestamp_seconds("s").alias("created_at"), F.array("steps_text").alias("resolution_steps"), F.col("success_rate").alias("raw_rate"),
        F.lit(False).alias("has_conflicts"),
    )


def asked(spark, texts):
    df = spark.createDataFrame([(f"q{k:04d}", t) for k, t in enumerate(texts)], "query_id string, signature string")
    return df.withColumn("clean_text", F.col("signature"))


def best_of(rows, key):
    return min(rows, key=key)["kb_id"] if rows else None


def hash_of(kb_id):
    return None if kb_id is None else "h" + kb_id[1:]


def wanted(queries, kb, score, allowed, minimum, tie):
    out = {}
    for q in queries:
        rows = []
        for r in kb:
            if allowed(q, r):
                s = round(score(q, r), 9)
                if s > minimum:
                    rows.append((-s, *tie(r), r["error_hash"]))
        if rows:
            out[q] = min(rows)[-1]
    return out


CASES = {
    "keyword": (
        mt.keyword_match,
        lambda q, r: 0.5 * fuzzy(q, r["error_signature"]) + 0.3 * overlap(q, r["error_signature"]) + 0.2 * fuzzy(q, r["error_text"]) + (0.2 if r["success_rate"] > 0.7 else 0),
        lambda q, r: any(t in r["error_signature"].lower() for t in tokens(q)), 0.4,
        lambda r: (-r["raw_rate"], -r["s"], r["error_hash"]),
    ),
    "fuzzy": (
        mt.fuzzy_match,
        lambda q, r: 0.7 * (0.6 * fuzzy(q, r["error_text"]) + 0.4 * overlap(q, r["error_text"])) + 0.3 * (0.6 * fuzzy(q, r["error_signature"]) + 0.4 * overlap(q, r["error_signature"]))
        + r["success_rate"] * min(1, r["feedback_count"] / 10) * 0.2,
        lambda q, r: any(t in r["error_text"].lower() for t in tokens(q)), 0.5, lambda r: (-r["s"], r["error_hash"]),
    ),
    "simple": (
        mt.simple_fuzzy_match,
        lambda q, r: fuzzy(q, r["error_text"]) + (0.3 if q.lower() in r["error_text"] else 0) + 0.2 * overlap(q, r["error_text"]),
        lambda q, r: round(fuzzy(q, r["error_text"]), 9) > 0.5 or overlap(q, r["error_text"]) > 0.4, 0.6, lambda r: (-r["s"], r["error_hash"]),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_layers_equal_scoring_every_pair(spark, name):
    layer, score, allowed, minimum, tie = CASES[name]
    rng = random.Random(4)
    texts = messages(rng, 260) + ["pool disk page"] * 40
    queries = sorted(set(messages(rng, 90) + texts[:25] + ["pool", "io", "a", "ool dis", "disk", "timed out", "db", "connection timeout", "zzzz", "network"]))
    kb = knowledge(spark, texts)
    got = {r["query_id"]: r["error_hash"] for r in layer(asked(spark, queries), kb).collect()}
    want = wanted(queries, [r.asDict() for r in kb.collect()], score, allowed, minimum, tie)
    assert {queries[int(q[1:])]: h for q, h in got.items()} == want


def test_the_best_row_is_found_beyond_every_old_list(spark):
    """Thousands of newer and better rated rows share most words; one old and unrated row is the right one."""
    texts = ["deadlock while update of ledger page x9f3e2"] + [f"deadlock while update of ledger page n{k:05d}" for k in range(3000)]
    kb = knowledge(spark, texts, [0.0] + [0.69] * 3000).withColumn("feedback_count", F.lit(0).cast("long"))
    queries = asked(spark, ["deadlock while update of ledger page x9f3e2 retry", "timeout deadlock while update of ledger page x9f3e2"])
    for layer in (mt.keyword_match, mt.fuzzy_match, mt.simple_fuzzy_match):
        assert {r["error_hash"] for r in layer(queries, kb).collect()} == {"h00000"}


def test_bounds_keep_pairs_few_where_a_word_is_in_every_row(spark, monkeypatch):
    """All rows share five words. The number of pairs scored grows with the rows that can win, not with all."""
    texts = [f"common words in every single row item{k:05d}" for k in range(4000)]
    kb = knowledge(spark, texts, [0.0] * 4000).withColumn("feedback_count", F.lit(0).cast("long"))
    queries = asked(spark, texts[:200])
    counts = []
    plain = bm.scored
    monkeypatch.setattr(bm, "scored", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs, *rest))[1])
    got = {r["query_id"]: r["error_hash"] for r in mt.fuzzy_match(queries, kb).collect()}
    assert got == {f"q{k:04d}": f"h{k:05d}" for k in range(200)}
    assert sum(counts) < 0.1 * 200 * 4000


def test_null_empty_and_repeated_rows(spark):
    kb = knowledge(spark, ["pool disk page", "pool disk page", "", "page"]).withColumn(
        "error_text", F.when(F.col("kb_id") == "k00003", F.lit(None)).otherwise(F.col("error_text"))
    )
    queries = asked(spark, ["pool disk page", "pool disk page", "", "page", None])
    for layer in (mt.keyword_match, mt.fuzzy_match, mt.simple_fuzzy_match):
        got = sorted(r["query_id"] for r in layer(queries, kb).collect())
        assert "q0000" in got and "q0001" in got and "q0002" not in got and "q0004" not in got
    assert mt.keyword_match(queries.limit(0), kb).collect() == []
    assert mt.simple_fuzzy_match(queries, kb.limit(0)).collect() == []
