"""The corpus pipeline: five stages from raw documents to token ids, each one of the operators in ``lexiphyte.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``. Each begins by
having executors give back the heap that the one before left them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiphyte.llm.bpe import token_digests
from lexiphyte.llm.common import collect_garbage, stored
from lexiphyte.llm.decontamination import drop_contaminated
from lexiphyte.llm.near_duplicates import drop_near_duplicates
from lexiphyte.llm.secrets import redact_secrets
from lexiphyte.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go."""
    collect_garbage(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more) stays, that of the smallest id."""
    collect_garbage(spark)
    return drop_near_duplicates(docs, size=5, similarity=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of a benchmark item go."""
    collect_garbage(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, nested ones included, become ``[secret]``, and n_chars follows; every document stays."""
    collect_garbage(spark)
    return redact_secrets(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    collect_garbage(spark)
    return token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scans", secret_scans), ("bpe", bpe)]

#: A trained classifier and byte-pair merges can't be said in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
