"""Rule matching through literal pieces against trying every pattern on every text."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from faultmatch.operators import rules


@pytest.mark.parametrize("pattern, pieces", [
    ("timeout (expired|while)", ["timeout "]), ("syntax|corrupt", ["corrupt", "syntax"]), ("^zzzz", ["zzzz"]), ("deadlock$", ["deadlock"]),
    ("(?i)Login +FAILURE", ["failure"]), ("colou?r", ["colo"]), ("(abc|def)?ghij", ["ghij"]), ("(abc|def)+", ["abc", "def"]), ("(abc|de)+", []),
    ("abc{0,2}def", ["def"]), ("abc{2}def", ["abc"]), ("a.b.c", []), ("", []), ("x|", []), (r"\d+ errors? in \[main\]", [" in [main]"]),
    (r"code\.exe", ["code.exe"]), (r"\Qabc+\E", []), (r"\x41bcd", []), ("[a-z[bc]]defg", []), ("[a&&b]cdef", []), ("[^]abc]defg", []),
    ("(?x)abc def", []), ("(?!abcdef)xyz", ["xyz"]), ("(?<n>hello)+w", ["hello"]), ("(?>abc)def", []), ("äbcdeföghij", ["bcdef"]), ("abc)", []), ("abc++d", ["abc"]),
    ("[)|]abcd", ["abcd"]), (r"[\]|]abcd", ["abcd"]), ("abc**", []),
])
def test_pieces(pattern, pieces):
    assert rules.pieces(pattern) == pieces


ATOMS = st.sampled_from(["abc", "b", "cab", ".", r"\d", "[ab]", "[^c]", r"\.", "^", "x"])
PATTERNS = st.recursive(
    ATOMS,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=4).map("".join),
        st.lists(inner, min_size=2, max_size=3).map(lambda p: "(" + "|".join(p) + ")"),
        st.tuples(inner, st.sampled_from(["?", "*", "+", "{2}", "{0,1}", "+?"])).map(lambda p: "(?:" + p[0] + ")" + p[1]),
    ),
    max_leaves=12,
)


@settings(max_examples=500, deadline=None)
@given(PATTERNS, st.lists(st.sampled_from(["abc", "ab", "c", "cab", "b", "x", ".", "7"]), max_size=8).map("".join))
def test_every_match_has_a_piece(pattern, text):
    pieces = rules.pieces(pattern)
    if pieces and re.search(pattern, text):
        assert any(p in text.lower() for p in pieces)


def test_hits_equal_trying_everything(spark):
    rng = random.Random(4)
    words = ["Disk", "full", "timeout", "while", "reading", "PAGE", "7", "page", "is\nlost", "ünder"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(300)] + ["hot word disk"] * 200 + [None, ""]
    patterns = [
        ("a", "[Dd]isk (full|while)"), ("b", "(?i)page"), ("c", "page"), ("c", "page"), ("d", r"\d"), ("e", "^$"), ("f", "timeout.+(lost|7)"),
        ("g", None), (None, "word disk$"), ("h", "nowhere|reading page"), ("i", "(?i)ÜNDER"), ("j", r"lost\s+ünder"), ("k", "disk"),
    ]
    asked = spark.createDataFrame([(t, 1) for t in texts], "signature string, pattern_id int").drop("pattern_id")
    table = spark.createDataFrame([(i, p, n) for n, (i, p) in enumerate(patterns)], "pattern_id string, pattern_regex string, low int")
    want = asked.distinct().join(table, F.expr("signature rlike pattern_regex")).select("signature", *table.columns)
    got = rules.pattern_hits(asked, table)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rules.pattern_hits(asked.limit(0), table).collect() == []
    assert rules.pattern_hits(asked, table.limit(0)).collect() == []


def test_no_nested_loop_where_every_rule_has_a_piece(spark, fixtures):
    plan = rules.pattern_hits(fixtures.queries, fixtures.patterns)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
