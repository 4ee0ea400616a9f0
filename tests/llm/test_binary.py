"""Token files against the tokenizers library, document by document."""

import zlib

import numpy as np
from conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tokenizers import Tokenizer

import __spark_entry__ as entry
from faultmatch.llm import binary
from faultmatch.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def wanted(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()], key=lambda r: r[1])


def test_query(spark, given):
    rows = [(r.doc_id, r.text) for r in given("documents")]
    assert got(entry.queries()["op9_token_files"](spark, SF)) == wanted(rows)


def test_odd_rows(spark, frame):
    assert got(binary.op9(spark, frame(ODD_TEXTS, ["n_tokens", "part"]), PATH, 2)) == wanted(ODD_TEXTS)
    assert got(binary.op9(spark, frame([]), PATH, 2)) == []


def test_filter_reaches_the_files(spark, frame, tmp_path):
    binary.write_ids(frame([(i, "word " * (i + 1)) for i in range(50)]), str(tmp_path / "ids"), PATH)
    found = binary.read_ids(spark, str(tmp_path / "ids")).filter("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in found._jdf.queryExecution().toString()
    assert [len(r.ids) for r in found.collect()] == [8]
