from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from contrail.llm import decontaminate as D
from contrail.llm.pii import personal_data
from contrail.llm.shared import written
from tests.llm.test_decontaminate import brute_score
from tests.llm.test_near_copies import brute_survivors

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage, with a few odd rows added to the documents."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = docs.where("doc_id = 1").first().text
    odd = [(5000, None, None, None, None), (5001, "", "en", "src0", 0), (None, text, "en", "src0", 1), (1, text, "en", "src0", 9), (1, text, "en", "src0", 9)]
    docs = docs.unionAll(spark.createDataFrame(odd, docs.schema))
    out = [docs]
    for name, stage in P.STAGES:
        out.append(written(stage(spark, out[-1], FOLDER), name))
    return out


def test_stages_keep_the_columns_of_documents(steps):
    assert [name for name, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "mixing"]
    for out in steps[1:5]:
        assert out.dtypes == steps[0].dtypes


def test_only_texts_without_language_are_rejected(steps):
    gone = steps[0].count() - steps[1].count()
    assert gone == 2 and steps[1].where("doc_id >= 5000").count() == 0


def test_one_document_of_each_group_stays(steps):
    rows = [(float("inf") if r.doc_id is None else r.doc_id, r.text) for r in steps[1].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in steps[2].collect()) == brute_survivors(rows)


def test_contaminated_documents_go(spark, steps):
    items = [D.words_of(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in steps[3].collect()}
    shared = 0
    for r in steps[2].collect():
        words = D.words_of(r.text)
        if not any(set(zip(q, q[1:], q[2:])) & set(zip(words, words[1:], words[2:])) for q in items):
            assert r.doc_id in kept
            continue
        number: dict = {}
        doc = [number.setdefault(w, len(number)) for w in words]
        best = max(
            brute_score(doc, [number.setdefault(w, len(number)) for w in q]) / (D.MATCH * len(q))
            for q in items
            if set(zip(q, q[1:], q[2:])) & set(zip(words, words[1:], words[2:]))
        )
        assert (best < D.LEAST_SCORE) == (r.doc_id in kept)
        shared += best >= D.LEAST_SCORE
    assert shared


def test_personal_data_is_masked(steps):
    before, after = steps[3], steps[4]
    assert before.count() == after.count()
    assert personal_data(before).where("spans <> ''").count() > 0
    assert personal_data(after).where("spans <> ''").count() == 0
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_every_kept_document_is_in_the_mix(spark, steps):
    assert {r.doc_id for r in steps[5].collect()} == {r.doc_id for r in steps[4].collect()}
    whole = {r.doc_id for r in P.run(spark, FOLDER).select("doc_id").distinct().collect()}
    assert whole and whole <= {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_empty_documents(spark, steps):
    docs = steps[0].limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
