"""The manifest against one tree built in memory."""

import hashlib
import zlib

import pytest
from conftest import SF
from tests.llm.conftest import ODD_TEXTS

import __spark_entry__ as entry
from faultmatch.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    out = []
    for nodes in tree[:-1]:
        start = at // 3 * 3
        out.append((nodes[start:at], nodes[at + 1 : start + 3]))
        at //= 3
    return out


def plain(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    sources = {}
    for r in rows:
        text = r[1]
        if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        sources.setdefault(r[3], []).append((r[0], plain_leaf(r, r[1]), plain_leaf(r, text)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda e: (e[0] is not None, e[0] or 0, e[1], e[2]))
        trees[s] = levels([e[1] for e in sources[s]])
    top = levels([trees[s][-1][0] for s in names]) if names else None
    out = []
    for k, s in enumerate(names):
        for at, (doc_id, leaf, changed) in enumerate(sources[s]):
            path = siblings(trees[s], at) + siblings(top, k)
            node = changed
            for left, right in path:
                node = H(*left, node, *right)
            proof = H(*(x for left, right in path for x in left + right))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def test_query(spark, given):
    got = entry.queries()["op11_merkle_manifest"](spark, SF)
    want = plain([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in given("documents")])
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


def odd_rows():
    rows = [(i, t, None, None, None) for i, t in ODD_TEXTS]
    rows += [(k, f"line\nof {k}", "en", s, k) for s in ("", "a", "é", "z", "0", "1") for k in range(-3, 7)]
    rows += [(None, "no\nid", "de", "a", 1)] * 9 + [(4, "equal\nrows", "de", "z", 1)] * 11 + [(50, "alone", None, "lone", 5)]
    return rows


@pytest.mark.parametrize("height", [2, 6])
def test_odd_rows_in_small_blocks(spark, frame, height):
    rows = odd_rows()
    df = frame(rows, ["key", "pos", "leaf", "node"])
    assert sorted(map(tuple, merkle.op11(df, height).collect()), key=str) == plain(rows)


def test_empty_table_and_one_row(spark, frame):
    assert merkle.op11(frame([])).collect() == []
    assert merkle.manifest(merkle.leaves(frame([]))).roots().collect() == []
    one = [(7, "only\none", "en", None, 8)]
    got = [tuple(r) for r in merkle.op11(frame(one)).collect()]
    assert got == plain(one) and got[0][1] == got[0][3] and got[0][4] == H()


def test_many_equal_ids_and_one_large_source(spark, frame):
    """Most rows in one source, most of them without an id or equal; blocks stay small and places are whole."""
    rows = [(None, f"t{k % 7}", None, "big", None) for k in range(3000)] + [(k, "x\ny", "en", "big", k) for k in range(900)]
    rows += [(k, "x", None, f"s{k}", None) for k in range(40)]
    made = merkle.manifest(merkle.leaves(frame(rows)))
    places = made.leaves.groupBy("key").agg(merkle.F.collect_list("pos").alias("p"), merkle.F.max("n").alias("n")).collect()
    assert all(sorted(r.p) == list(range(r.n)) for r in places)
    assert sorted(map(tuple, merkle.op11(frame(rows)).collect()), key=str) == plain(rows)


def test_proofs_and_versions(spark, frame):
    rows = odd_rows()
    docs = frame(rows)
    made = merkle.manifest(merkle.leaves(docs, merkle.F.concat(merkle.F.lit("!"), merkle.F.coalesce("text", merkle.F.lit("")))))
    root = made.roots().first().root
    assert {r.source for r in made.roots().collect()} == {r[3] for r in rows}
    for r in made.proofs().collect():
        assert r.root == root == merkle.folded(r.leaf, [(p.left, p.right) for p in r.path])
    versions = made.versions().collect()
    assert len(versions) == len(rows)
    for r in versions:
        assert r.version == r.copies[-1] != root


def test_a_version_shares_all_untouched_nodes():
    leaves = [H(str(k)) for k in range(200)]
    base = merkle.Block(leaves, 5)
    before = [list(level) for level in base.levels]
    one = base.version(77, H("tampered"))
    other = levels([*leaves[:77], H("tampered"), *leaves[78:]])
    assert [[one.node(level, k) for k in range(len(nodes))] for level, nodes in enumerate(base.levels)] == other
    assert base.levels == before and len(one.copies) == 6
    assert all(one.node(0, k) is leaves[k] for k in range(200) if k != 77)
