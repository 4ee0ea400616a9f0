"""Token counts by the compiled transducer against the tokenizers library."""

import importlib
import random

import pytest
from conftest import SF
from hypothesis import given as examples, settings, strategies as st
from tests.llm.conftest import ODD_TEXTS
from tokenizers import Tokenizer

import __spark_entry__ as entry
from faultmatch.llm import counts

PATH = importlib.import_module("public_tokenizers").path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODER = counts.compiled(PATH)


def wanted(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def rows_of(rows):
    return sorted([(i, len((t or "").encode()), wanted(t or "")) for i, t in rows], key=str)


def test_query(spark, given):
    got = entry.queries()["op13_token_counts"](spark, SF).collect()
    want = [(*r, r[2] > 1024) for r in rows_of([(r.doc_id, r.text) for r in given("documents")])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_odd_rows_whole_and_cut(spark, frame, chunk):
    rows = [*ODD_TEXTS, (20, "ab" * 500 + "<|endoftext|>" + " " * 300 + "x"), (20, "ab" * 500), (20, "ab" * 500), (None, None)]
    df = frame(rows, ["n_bytes", "k", "chunk"])
    got = counts.token_counts(df, PATH, chunk=chunk)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect()), key=str) == rows_of(rows)
    assert counts.op13(frame([]), PATH).collect() == []


MARKS = ["'re", "'ll", "'s", " '", "<|endoftext|>", "<|endof", "<|", "  ", "\n\n", "　", "the", " an", "’", "42", "é", "你", "\U0001f600"]
TEXTS = st.lists(st.one_of(st.sampled_from(MARKS), st.text(max_size=3), st.text("abehlrstv'md <|>1 \n\t", max_size=6)), max_size=20).map("".join)


@settings(max_examples=400, deadline=None)
@examples(TEXTS)
def test_every_prefix_has_its_count(text):
    node, n = CODER.start, 0
    for k, c in enumerate(text):
        node = node[c]
        n += node.change
        assert n == wanted(text[: k + 1])


@settings(max_examples=400, deadline=None)
@examples(TEXTS, st.integers(1, 9), st.randoms(use_true_random=False))
def test_maps_of_chunks_compose_in_any_grouping(text, size, rng: random.Random):
    maps = [CODER.map_of(text[i : i + size]) for i in range(0, len(text), size)] or [("", 0, None)]
    while len(maps) > 1:
        at = rng.randrange(len(maps) - 1)
        maps[at : at + 2] = [CODER.compose(maps[at : at + 2])]
    assert CODER.applied(maps[0]) == wanted(text)


def test_forgetting_states_changes_no_count(monkeypatch):
    monkeypatch.setattr(counts, "KEPT_STATES", 50)
    coder = counts.Transducer(PATH)
    for text in ("some words and more of them " * 20, "x" * 3000, "other text, other states " * 9):
        assert coder.count(text) == wanted(text)
