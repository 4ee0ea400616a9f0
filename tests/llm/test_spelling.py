"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
from conftest import SF
from hypothesis import given as examples, settings, strategies as st
from tests.llm.conftest import ODD_TEXTS

import __spark_entry__ as entry
from faultmatch.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_counts(rows, least_length=7, least_count=2, misspelt=31):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if misspelt and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


def plain_forms(words, times=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def test_query(spark, given):
    got = entry.queries()["op12_spelling_forms"](spark, SF)
    assert got.columns == COLUMNS
    want = plain_forms(plain_counts([(r.doc_id, r.text) for r in given("documents")]))
    assert sum(r[1] is not None for r in want) > 0
    assert sorted(map(tuple, got.collect())) == want


def test_odd_rows(spark, frame):
    long = "abcdefghij" * 400
    rows = [
        *ODD_TEXTS, (30, "Straße STRASSE straßen Äpfelchen äpfelchen äpfelchem " * 30), (31, "a×b÷cdefg a×b÷cdefh " * 9),
        (32, f"{long} {long} {long}x {long}x {long[:-1]} {long[:-1]}"), (None, None), (None, "variant variant variamt variamt"),
    ]
    df = frame(rows, ["word", "n"])
    assert sorted(map(tuple, spelling.op12(df).collect())) == plain_forms(plain_counts(rows))
    assert spelling.op12(frame([])).collect() == []
    assert spelling.op12(frame([(1, None), (2, "")])).collect() == []


def test_families_and_chains(spark):
    """Many variants of a few words, links between variants, and chains of forms of forms."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyzéü")
    words = {}
    for k in range(6):
        base = "".join(rng.choice(letters, 9))
        words[base] = 200_000
        now, n = base, 200_000
        while n >= 10:
            n //= 10
            at = int(rng.integers(0, len(now) + 1))
            now = now[:at] + str(rng.choice(letters)) + now[at:]
            words.setdefault(now, n)
        for _ in range(150):
            at, kind = int(rng.integers(0, 9)), int(rng.integers(0, 3))
            other = base[:at] + (str(rng.choice(letters)) if kind else "") + base[at + (kind != 2) :]
            words.setdefault(other, int(rng.integers(2, 40_000)))
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = plain_forms(words)
    assert max(len({r[0] for r in want if r[2] == root}) for root in {r[2] for r in want}) > 40
    for symbols in (1, 4):
        assert sorted(map(tuple, spelling.forms(table, 1, 10, symbols).collect())) == want


def keys(word, near, places):
    block = spelling.Block(np.frombuffer(word.encode("utf-32-le"), "<u4").reshape(1, -1))
    if not near:
        return set(block.own_keys().ravel().tolist())
    parts = [k for at in range(0, len(word), places) for k in block.near_keys(1, at, at + places)]
    return set(np.concatenate(parts, axis=1).ravel().tolist()) - {0} | keys(word, False, 1)


@settings(max_examples=500, deadline=None)
@examples(st.text("abcé", min_size=2, max_size=12), st.data())
def test_words_one_edit_apart_share_a_key(word, data):
    at = data.draw(st.integers(0, len(word)))
    c = data.draw(st.sampled_from(["a", "z", "é", ""]))
    other = word[:at] + c + word[at + data.draw(st.integers(0, 1)) :]
    if one_edit(word, other) and other:
        places = data.draw(st.integers(1, 5))
        assert keys(word, True, places) & keys(other, False, 1) or keys(other, True, places) & keys(word, False, 1)
