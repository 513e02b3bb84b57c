"""Each stage of the pipeline first has executors give back the heap that the stage before it left them."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def collections(spark):
    """Full collections of the JVM so far; with a local master it is the executor too."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


@pytest.mark.parametrize("name, operator", [("toxicity", "drop_toxic"), ("near_dedup", "drop_near_duplicates"), ("decontamination", "drop_contaminated"), ("secret_scans", "redact_secrets"), ("bpe", "token_digests")])
def test_stage_begins_with_a_collection(spark, monkeypatch, name, operator):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = collections(spark), []
    monkeypatch.setattr(corpus_pipeline, operator, lambda docs, *a, **b: seen.append(collections(spark)) or docs)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF) is docs
    assert seen[0] > before
