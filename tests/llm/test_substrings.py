"""Repeated windows against a plain dictionary of all windows."""

import hashlib
import re

import pytest
from conftest import SF
from tests.llm.conftest import ODD_TEXTS

import __spark_entry__ as entry
from faultmatch.llm import substrings


def plain(rows, window=13):
    """Sorted rows of (doc_id, n_words, n_removed, sha of the kept words)."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    rank = lambda i: (i is not None, i or 0)
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank(i):
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch, bucket", [(1000, 1 << 20), (17, 1 << 9)])
def test_query(spark, given, monkeypatch, stretch, bucket):
    monkeypatch.setattr(substrings, "STRETCH", stretch)
    monkeypatch.setattr(substrings, "BUCKET_EDGES", bucket)
    got = entry.queries()["op10_substring_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == plain([(r.doc_id, r.text) for r in given("documents")])


def test_odd_rows(spark, frame, monkeypatch):
    long = " ".join(f"w{k}" for k in range(40))
    rows = ODD_TEXTS + [(None, long), (20, long), (20, long), (21, "x " + long + " y"), (22, long[:60]), (23, "rep eat " * 40), (24, "rep eat " * 9)]
    for size in (1000, 3):
        monkeypatch.setattr(substrings, "STRETCH", size)
        df = frame(rows, ["stretch", "bucket", "kept"])
        assert sorted(map(tuple, substrings.op10(df).collect()), key=str) == plain(rows)
        out = substrings.without_repeats(df)
        assert out.columns == df.columns and out.count() == len(rows)
        by = {(r.doc_id, r.text) for r in out.collect()}
        assert (21, "x y") in by and (20, "") in by and (None, long) in by and (5, None) in by
    assert substrings.op10(frame([])).collect() == [] and substrings.without_repeats(frame([])).collect() == []


def test_cutting_leaves_the_rest_alone():
    text = "a  b\n\nc d\te "
    assert substrings.without(text, [(1, 3)]) == "a  d\te "
    assert substrings.without(text, [(0, 5)]) == ""
    assert substrings.without(text, []) == text
    assert substrings.without(text, [(0, 1), (4, 5)]) == "b\n\nc d\t"


def test_texts_are_shuffled_once(spark, frame, monkeypatch):
    monkeypatch.setattr(substrings, "STRETCH", 5)
    df = substrings.op10(frame([(i, "a b c " * 20) for i in range(30)]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_edges_of_one_number_are_told_apart(spark, frame, given, monkeypatch):
    """Numbers of 3 bits make nearly all windows alike; the words still decide, across stretches and inside them."""
    monkeypatch.setattr(substrings, "EDGE_BITS", 3)
    rows = [(r.doc_id, (r.text or "")[:900]) for r in given("documents")][:120]
    for size in (1000, 7):
        monkeypatch.setattr(substrings, "STRETCH", size)
        assert sorted(map(tuple, substrings.op10(frame(rows)).collect()), key=str) == plain(rows)
