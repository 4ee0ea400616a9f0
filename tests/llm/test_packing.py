"""Packing: pieces against the tokenizers library, places against the rules, counts against the bound."""

import zlib

import numpy as np
import pytest
from conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tokenizers import Tokenizer

import __spark_entry__ as entry
from faultmatch.llm import packing
from faultmatch.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def wanted(rows, capacity):
    tokenizer, out = Tokenizer.from_file(PATH), []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out, key=str)


def check(rows, source, capacity):
    got = rows.collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == wanted(source, capacity)
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert all(n <= capacity for n in full.values())
    bound = packing.lower_bound(np.bincount([r.length for r in got], minlength=capacity + 1), capacity)
    return len(full), bound


def test_query(spark, given):
    n, bound = check(entry.queries()["op4_best_fit_packing"](spark, SF), [(r.doc_id, r.text) for r in given("documents")], 4096)
    assert n == bound


def test_odd_rows(spark, frame):
    check(packing.op4(frame(ODD_TEXTS, ["length", "row", "sequence_id"]), PATH, 1, 512), ODD_TEXTS, 512)
    assert packing.op4(frame([]), PATH, 1, 512).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_exchange_reaches_the_bound(spark, seed):
    lengths = np.random.default_rng(seed).integers(1, 100, 2000).tolist()
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    got = packing.pack(rows, 100, group_rows=250).collect()
    assert sorted(r.row for r in got) == list(range(2000))
    used = len({r.sequence_id for r in got})
    bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
    alone = sum(len(packing.best_fit(np.array(lengths[k::8]), 100)[2]) for k in range(8))
    assert bound <= used <= min(alone, bound * 1.02 + 1)


def test_lower_bound_never_exceeds_best_packing():
    for lengths, best in (([60, 60, 60], 3), ([34, 34, 34, 34], 2), ([50, 50, 50], 2), ([51, 50, 49], 2), ([100], 1), ([], 0), ([0, 0], 0)):
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= best
    assert packing.lower_bound(np.bincount([60, 60, 60], minlength=101), 100) == 3
    assert packing.lower_bound(np.bincount([34, 34, 34, 34], minlength=101), 100) == 2


def test_sequences_hold_their_documents(spark, frame):
    cut_up = packing.pieces(frame([(i, "word " * (i * 7 % 40)) for i in range(30)]), PATH, 1, 64)
    out = packing.sequences(packing.placed(cut_up, 64)).collect()
    assert sum(len(r.ids) for r in out) == 4 * sum(i * 7 % 40 + 1 for i in range(30))
    assert sorted(d for r in out for d in r.doc_ids) == list(range(30))
