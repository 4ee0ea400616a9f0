"""SimHash groups against all pairs; the Golay keys against every word of the code's length."""

from itertools import combinations

import numpy as np
import xxhash
from conftest import SF
from tests.llm.conftest import ODD_TEXTS

import __spark_entry__ as entry
from faultmatch.llm import simhash
from faultmatch.llm.components import components


def plain_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def wanted(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i, j in combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = roots(range(len(rows)), edges)
    names = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root[k]] = min(doc_id, names.get(root[k], doc_id))
    return sorted([(i, f"{fp:016x}", names.get(root[k])) for k, ((i, _), fp) in enumerate(zip(rows, fps))], key=str)


def test_query(spark, given):
    got = entry.queries()["op5_simhash_groups"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == wanted([(r.doc_id, r.text) for r in given("documents")])


def test_odd_rows(spark, frame):
    df = frame(ODD_TEXTS, ["fp", "component_id"])
    assert sorted(map(tuple, simhash.op5(df).collect()), key=str) == wanted(ODD_TEXTS)
    assert simhash.op5(frame([])).collect() == []


def test_words_up_to_two_bits_apart_share_a_codeword_key():
    """The code is linear, so one word of each coset and every error pattern prove it for all pairs."""
    _, patterns = simhash._code()
    cosets = patterns[:, 0].copy()
    own = simhash.codeword_keys(cosets)
    assert len(np.unique(cosets)) == 2048
    for bits in [()] + list(combinations(range(23), 1)) + list(combinations(range(23), 2)):
        other = simhash.codeword_keys(cosets ^ sum(1 << b for b in bits))
        assert (own[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_golay_keys_find_every_pair_of_two_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 40, dtype=np.uint64)
    for a, b in [(a, b) for a in range(64) for b in range(a, 64)]:
        other = fps ^ np.uint64((1 << a) | (1 << b))
        assert (simhash.golay_keys(fps)[:, :, None] == simhash.golay_keys(other)[:, None, :]).any(axis=(1, 2)).all()


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """A cloud of fingerprints around one: with and without pairing, the same components as all pairs."""
    rng = np.random.default_rng(2)
    centre = int(rng.integers(1 << 62))
    fps = sorted({simhash.signed(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5)))) for _ in range(700)})
    edges = [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    want = {n: r for n, r in roots(fps, edges).items() if n != r}
    for paired in (2, 48, 10000):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
        assert {r.u: r.v for r in found.collect()} == want


def least_of_each(rows):
    """Ids that stay: those that are the least of the group of one of their rows."""
    return {i for i, _, least in wanted([(i, t) for i, t in rows if i is not None]) if i == least}


def test_one_of_each_group_stays(spark, given, frame):
    rows = [(r.doc_id, r.text) for r in given("documents")]
    assert {r.doc_id for r in simhash.one_of_each(frame(rows)).collect()} == least_of_each(rows)


def test_stage_on_odd_rows(spark, frame):
    df = frame(ODD_TEXTS, ["key", "fp"])
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([None, *least_of_each(ODD_TEXTS)], key=str)
    assert simhash.one_of_each(frame([])).collect() == []


def test_a_large_family_of_versions_keeps_what_all_pairs_keep(spark, frame):
    """Over a thousand versions of one text and exact copies of them, linked through fingerprints of 2 bits or fewer."""
    rng = np.random.default_rng(7)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(1100):
        own = list(base)
        for at in rng.integers(0, 400, int(rng.integers(0, 6))):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    rows += [(2000 + k, t) for k, t in rows[:100]]
    assert {r.doc_id for r in simhash.one_of_each(frame(rows)).collect()} == least_of_each(rows)
