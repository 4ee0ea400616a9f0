"""The pipeline's stages, each on its own input, against plain versions."""

from conftest import SF
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_packing import check
from tests.llm.test_quality import plain as plain_quality
from tests.llm.test_simhash import least_of_each
from tests.llm.test_substrings import plain as plain_repeats

import __spark_entry__ as entry
import corpus_pipeline
from faultmatch.llm import quality


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    given, spoken, good, single, cut = inputs
    # stages that filter return rows of their input
    for before, after in ((given, spoken), (spoken, good), (good, single)):
        assert set(rows_of(after)) <= set(rows_of(before))
    assert {r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "") and len(r.text) > 200} <= {r.doc_id for r in spoken.collect()}
    verdict = {r.doc_id: r.kept for r in quality.judge(spoken).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, kept in verdict.items() if kept}
    assert not any(plain_quality(r.text)[-1] for r in good.collect())
    assert {r.doc_id for r in single.collect()} == least_of_each([(r.doc_id, r.text) for r in good.collect()])
    want = {i: n - gone for i, n, gone, _ in plain_repeats([(r.doc_id, r.text) for r in single.collect()])}
    assert {r.doc_id: len((r.text or "").split()) for r in cut.collect()} == want
    n, bound = check(docs, [(r.doc_id, r.text) for r in cut.collect()], corpus_pipeline.CAPACITY)
    assert n == bound
    # run() gives the same pieces; sequences are numbered anew
    places = {"sequence_id", "offset"}
    ran = entry.queries()["pipeline"](spark, SF)
    assert rows_of(ran.drop(*places)) == rows_of(docs.drop(*places))


def test_odd_rows(spark, frame):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(*r, "en") for r in ODD_TEXTS] + [(40, words, "en"), (41, words, None), (None, words, "de"), (42, None, None)]
    docs = frame(rows, ["__turn", "sequence_id"])
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        docs.collect()
    empty = frame([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_clean_documents_stay(spark, given):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
    kept = {r.doc_id for r in docs.collect()}
    clean = {r.doc_id for r in given("labels") if r.quality and not r.toxic}
    long = {r.doc_id for r in given("documents") if len((r.text or "").split()) >= 50}
    assert len(clean & long & kept) >= 0.95 * len(clean & long)
