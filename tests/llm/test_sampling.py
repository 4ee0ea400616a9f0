"""Weighted fingerprints: edits and order against plain rows, likeness against generalised Jaccard similarity."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tests.llm.conftest import ODD_TEXTS

import __spark_entry__ as entry
from faultmatch.llm import sampling


def edits(rows):
    """Rows in order with their edited texts."""
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        quarter = len(text) // 4
        out.append((doc_id, text, text[: len(text) - quarter] + following[:quarter], following))
    return out


def similarity(a, b):
    a, b = (Counter(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in (a, b))
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 1.0


def check(got, rows):
    want = edits(rows)
    facts = sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str)
    assert facts == sorted([(i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want], key=str)
    by_text = {}
    for r in got:
        assert len(r.fingerprint) == 8 * sampling.SAMPLES == len(r.edited_fingerprint)
        own = [r.fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)]
        other = [r.edited_fingerprint[k : k + 8] for k in range(0, len(r.fingerprint), 8)]
        assert r.near_edited == pytest.approx(sum(x == y for x, y in zip(own, other)) / sampling.SAMPLES)
        by_text.setdefault((r.doc_id, r.n_chars), r)
    fingerprint = {}
    for doc_id, text, _, _ in want:
        r = by_text[doc_id, len(text)]
        assert fingerprint.setdefault(text, r.fingerprint) == r.fingerprint
    return want, by_text


@pytest.mark.parametrize("stretch", [2000, 23])
def test_query(spark, given, monkeypatch, stretch):
    monkeypatch.setattr(sampling, "STRETCH", stretch)
    rows = [(r.doc_id, r.text) for r in given("documents")]
    got = entry.queries()["op7_weighted_fingerprints"](spark, SF).collect()
    want, by = check(got, rows)
    own = np.array([by[i, len(t)].near_edited - similarity(t, e) for i, t, e, _ in want])
    following = np.array([by[i, len(t)].near_next - similarity(t, f) for i, t, _, f in want])
    deviation = 0.5 / np.sqrt(sampling.SAMPLES)
    for off in (own, following):
        assert abs(off.mean()) < 4 * deviation / np.sqrt(len(off)) and np.abs(off).max() < 5 * deviation
    for i, t, _, f in want:
        assert t != f or by[i, len(t)].near_next == 1


def test_odd_rows(spark, frame):
    check(sampling.op7(frame(ODD_TEXTS, ["at", "stretch", "fingerprint"])).collect(), ODD_TEXTS)
    check(sampling.op7(frame([(1, "alone in the table")])).collect(), [(1, "alone in the table")])
    assert sampling.op7(frame([])).collect() == []


def test_weights_decide(spark):
    """Collisions of weighted samples over many draws come at the rate of the generalised Jaccard similarity."""
    one, two = {1: 5.0, 2: 1.0, 3: 2.0}, {1: 2.0, 2: 1.0, 4: 3.0}
    terms = spark.createDataFrame([(t * 7919, one.get(t), two.get(t)) for t in (1, 2, 3, 4)], "term long, own double, other double")
    draws = terms.crossJoin(spark.range(6000).withColumnRenamed("id", "k"))
    own, other = sampling.sample(F.xxhash64("term"), [F.log("own"), F.log("other")], F.col("k"))
    least = draws.groupBy("k").agg(F.min(own).alias("a"), F.min(other).alias("b"))
    mask = (1 << 32) - 1
    rate = least.agg(F.avg((F.col("a").bitwiseAND(F.lit(mask)) == F.col("b").bitwiseAND(F.lit(mask))).cast("int"))).first()[0]
    assert rate == pytest.approx(3 / 11, abs=0.03)


def test_no_python_in_the_plan(spark, frame):
    plan = sampling.op7(frame([(1, "a b c")])) ._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
