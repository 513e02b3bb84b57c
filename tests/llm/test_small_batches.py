"""Whole texts reach Python in small batches, and the session's own setting comes back."""

import public_tokenizers

from lexiphyte.llm import bpe

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_digests_take_small_batches(spark, monkeypatch):
    before, seen, stored = spark.conf.get(KEY), [], bpe.stored
    monkeypatch.setattr(bpe, "stored", lambda df, label: seen.append((label, int(spark.conf.get(KEY)))) or stored(df, label))
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert bpe.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 2
    assert seen == [("pre-tokens", 1_000), ("token-digests", 1_000)]
    assert spark.conf.get(KEY) == before
