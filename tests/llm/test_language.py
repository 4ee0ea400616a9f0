"""Language profiles: held-out accuracy, rules for odd texts, and the algebra of the vectors."""

import zlib

import numpy as np
from conftest import SF
from tests.llm.conftest import ODD_TEXTS

import __spark_entry__ as entry
from faultmatch.llm import language


def test_held_out_accuracy(spark, given):
    lang = {r.doc_id: r.lang for r in given("documents")}
    got = entry.queries()["op6_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    fold = [r for r in got if r.held_out]
    assert len(fold) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in fold) / len(fold) >= 0.97


def test_odd_rows(spark, frame):
    rows = [(i, t, "en") for i, t in ODD_TEXTS] + [(90, "123 !!", "en"), (91, "der die das und nicht", "de"), (92, "und der nicht die", None)] * 2
    df = frame(rows, ["lang_pred", "score", "held_out"])
    got = language.op6(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3, 4, 5, 90))
    assert by[None].held_out is False
    assert by[92].lang_pred == "de"
    assert language.op6(frame([])).collect() == []
    alone = language.op6(frame([(1, "no label", None), (2, None, "en")])).collect()
    assert {r.lang_pred for r in alone} == {"und"}
    kept = language.in_known_language(df, language.learn(df))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 90})


def test_training_bound_is_by_hash_of_all_rows(spark, frame):
    df = frame([(i, "the and of to" if i % 2 else "der die und das", "en" if i % 2 else "de") for i in range(400)])
    profiles = language.learn(df, rows=60)
    assert profiles.languages == ("de", "en") and np.allclose(np.linalg.norm(profiles.vectors, axis=1), 1)


def test_vectors_of_different_trigrams_are_nearly_orthogonal():
    assert abs(float(language.profile("xyz") @ language.profile("zyx"))) < 0.35
    assert np.allclose(language.profile("Größe"), language.profile("größe"))
    assert language.profile("12 34") is None


FOREIGN = (
    "Bugün hava çok güzel olduğu için çocuklar parkta oynamaya gittiler ve akşam eve döndüklerinde anneleri onlara sıcak çorba hazırlamıştı. ",
    "Tänään on hyvin kaunis päivä ja lapset menivät puistoon leikkimään ystäviensä kanssa. Illalla he palasivat kotiin syömään. ",
    "Сегодня очень хорошая погода, поэтому дети пошли играть в парк со своими друзьями. Вечером они вернулись домой. ",
    "Dzisiaj jest bardzo piękna pogoda, dlatego dzieci poszły bawić się do parku ze swoimi przyjaciółmi. ",
)


def test_unlearned_languages_and_random_letters_go(spark, frame):
    rng = np.random.default_rng(8)
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    clean = {r.doc_id for r in spark.read.parquet(f"{path}/labels.parquet").collect() if r.quality}
    planted = [(10**9 + k, (FOREIGN[k % 4] * 200)[: 100 * 2 ** (k // 4)], None) for k in range(28)]
    planted += [(2 * 10**9 + k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 100 * 2 ** (k // 8))), None) for k in range(56)]
    df = frame(rows + planted)
    kept = {r.doc_id for r in language.in_known_language(df, language.learn(df)).collect()}
    assert not kept & {i for i, _, _ in planted}
    assert clean <= kept


def test_least_scores_equal_medians(spark, given, frame):
    rows = [(r.doc_id, r.text, r.lang) for r in given("documents")]
    df = frame(rows)
    profiles = language.learn(df)
    names, scores = profiles.nearest([t or "" for _, t, _ in rows])
    by = {}
    for (i, text, lang), name, score in zip(rows, names, scores):
        if name == lang and zlib.crc32(str(i).encode()) % 4 != 2:
            by.setdefault(sum(map(str.isalpha, text.lower())).bit_length(), []).append(round(score * 1000))
    got, usual = language.least_scores(df, profiles), 0.0
    for size in range(64):
        own = sorted(by.get(size, []))
        usual = max(usual, own[(len(own) - 1) // 2] / 1000) if own else usual
        assert abs(got[size] - 0.3 * usual) < 1e-9
