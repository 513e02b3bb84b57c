"""Names that arrive as a stream: parsing is a plain projection, matching meets a static reference batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexiphyte.operators.match import match_names
from lexiphyte.operators.parse import PARSED, with_parts


def parse_stream(names: DataFrame) -> DataFrame:
    """Parsed names of a streaming table with ``id`` and ``name``; append mode, no state."""
    return with_parts(names.select(F.lit(0).cast("long").alias("pos"), "id", "name")).where(F.col("genus_name").isNotNull()).select(*PARSED)


def match_stream(spark: SparkSession, names: DataFrame, reference: DataFrame, path: str, **options) -> DataStreamWriter:
    """Write every micro-batch's matches as Parquet under ``path``; a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        own = batch.select(F.monotonically_increasing_id().alias("pos"), "id", "name")
        match_names(spark, own, reference, validate=False, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return names.writeStream.foreachBatch(one)
