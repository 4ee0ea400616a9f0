"""Byte-pair ids against the tokenizers library."""

import hashlib

from conftest import SF
from hypothesis import given as draw, settings, strategies as st
from tests.llm.conftest import ODD_TEXTS
from tokenizers import Tokenizer

import __spark_entry__ as entry
from faultmatch.llm import pairs
from faultmatch.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIBRARY, CODER = Tokenizer.from_file(PATH), pairs.BytePairs(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(rows):
    out = []
    for doc_id, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_query(spark, given):
    got = entry.queries()["op3_byte_pairs"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == wanted([(r.doc_id, r.text) for r in given("documents")])


def test_odd_rows(spark, frame):
    df = frame(ODD_TEXTS, ["n_tokens", "ids"])
    assert sorted(map(tuple, pairs.op3(df, PATH).collect()), key=str) == wanted(ODD_TEXTS)
    back = pairs.decode(pairs.encode(df, PATH), PATH).collect()
    assert sorted(map(tuple, back), key=str) == sorted([(i, t or "") for i, t in ODD_TEXTS], key=str)
    assert pairs.op3(frame([]), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@draw(st.one_of(st.text(max_size=30), st.text(alphabet="abehint '\né–1", max_size=40)))
def test_any_text(text):
    assert CODER.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_tasks_of_a_worker_share_the_pieces_met():
    coder = pairs.byte_pairs(PATH)
    coder.encode("a piece met")
    assert " piece" in pairs.byte_pairs(PATH)
    assert coder.encode("a piece met").tolist() == LIBRARY.encode("a piece met", add_special_tokens=False).ids
