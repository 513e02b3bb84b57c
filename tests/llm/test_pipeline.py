"""Every stage of the pipeline on its own input, and the whole of it, against brute force."""

import hashlib

import pytest

import corpus_pipeline
from lexiphyte.llm import secrets, toxicity
from lexiphyte.llm.common import stored

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, SF), name)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, stages):
    from test_operators import naive_contamination, naive_groups

    docs, mild, single, clean, hidden, ids = stages
    assert [d.columns for d in stages[:-1]] == [docs.columns] * 5
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert texts(mild) == {d: t for d, t in texts(docs).items() if scores[d] < 0.5}
    assert set(texts(single)) == {d for d, _, _, kept in naive_groups(list(texts(mild).items())) if kept}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts(clean)) == {d for d, _, _, n, _, _ in naive_contamination(list(texts(single).items()), bench) if n < 1}
    before = texts(clean)
    assert texts(hidden) == {d: secrets.redacted(t, secrets.find_secrets(t)[1]) for d, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in hidden.collect())
    assert {r["doc_id"]: r["decoded_sha256"] for r in ids.collect()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts(hidden).items()}


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_empty_and_null(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, None, "en", "a", None)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for d in (docs.limit(0), docs):
        for _, f in corpus_pipeline.STAGES[:-1]:
            d = stored(f(spark, d, SF), "edge")
        assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() in (0, 4)
