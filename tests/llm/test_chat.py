"""Formatted conversations, read back, against the rows they were made from."""

import hashlib
import os
import sys

from conftest import SF
from hypothesis import given as draw, settings, strategies as st

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as entry
import check
from faultmatch.llm import chat


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    state, _, _, note = check.compare(spark, check.duck(SF), SF, "op2_chat_format", entry.queries(), entry.oracle_sql())
    assert state == "ok", note


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a</s>b\\"), (1, 1, "assistant", "a</s>b\\"), (1, None, None, "x\\[INST]"),
        (None, 0, "tool\n%1", "<\\/s><s>\n<"), (None, 1, "assistant", ""), (2, 5, "system", "é\U0001f600" * 30000), (3, 0, "", ""),
    ] + [(9, t, "assistant" if t % 2 else "user", f"text {t} <s>") for t in range(3000)]
    df = spark.createDataFrame([r + ("clash",) for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.formatted(df)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    assert got == want
    assert chat.digests(chat.formatted(df.limit(0))).collect() == []


@settings(max_examples=200, deadline=None)
@draw(st.lists(st.tuples(st.sampled_from(["assistant", "user", "a\n%0A[INST]", ""]), st.text(alphabet="<>/s[]INST\\ \né", max_size=24)), max_size=5))
def test_reversible(turns):
    out, _, spans = chat.assembled([r for r, _ in turns], [t for _, t in turns])
    assert chat.read_turns(out.tobytes()) == turns
    assert [chat.unescape(out[a:b].tobytes().decode()) for a, b in spans] == [t for _, t in turns]
