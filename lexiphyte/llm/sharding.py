"""Balanced shards by longest-processing-time scheduling; documents of equal text stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiphyte.llm.common import stored

#: A group counts as large from 1/FINE of a mean shard on, so there are at most FINE large groups a shard.
FINE = 256
#: Rows that one sub-bucket of a shard holds on average while slots are numbered.
SLOT_ROWS = 2048


def lpt(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(key, size) items, largest first, each to the shard least loaded so far; ties go to smaller keys and shards."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to ``shards`` shards of nearly equal bytes.

    A document weighs the UTF-8 bytes of its text (null: none) plus 16. Rows of equal text form a group and share a
    shard. Large groups (over ``1 / FINE`` of a mean shard, so at most ``shards * FINE`` of them) are scheduled one by
    one; the small ones are first bundled by text hash into ``shards * FINE`` bundles, which are scheduled with them.
    So the driver's heap sees a bounded number of items however large the corpus is, and no group is ever split. A
    hash collision can only put two different texts into one shard.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``, one row per input row. ``slot`` counts from 0
    without gaps in each shard; it is numbered in sub-buckets of about SLOT_ROWS rows whose offsets are summed, so that
    a shard with very many rows isn't one task. Null ids and texts, empty and repeated rows are dealt like any other;
    an empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-base",
    )
    bundles = shards * FINE
    total = base.agg(F.sum("size")).first()[0] or 0
    groups = base.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    large = F.col("size") * F.lit(bundles) > F.lit(total)
    # One pass: a large group is its own item, a small one adds to its bundle; bundles have keys without a hash.
    items = (
        groups.withColumn("large", large)
        .groupBy(
            F.when(F.col("large"), F.col("h")).alias("h"),
            F.when(~F.col("large"), F.pmod("h", F.lit(bundles))).alias("bundle"),
        )
        .agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        .collect()  # at most 2 * shards * FINE rows, by the definition of large
    )
    placed = lpt([(k, r["size"]) for k, r in enumerate(sorted(items, key=lambda r: (r["h"] is None, r["h"] or 0, r["bundle"] or 0)))], shards)
    ordered = sorted(items, key=lambda r: (r["h"] is None, r["h"] or 0, r["bundle"] or 0))
    rows = [0] * shards
    for k, r in enumerate(ordered):
        rows[placed[k]] += r["n"]
    by_hash = [(r["h"], placed[k]) for k, r in enumerate(ordered) if r["h"] is not None]
    by_bundle = [(r["bundle"], placed[k]) for k, r in enumerate(ordered) if r["h"] is None]
    own = _small(spark, by_hash, "h long, own int")
    rest = _small(spark, by_bundle, "bundle long, rest int")
    subs = max(1, -(-max(rows) // SLOT_ROWS))
    dealt = (
        base.join(F.broadcast(own), "h", "left")
        .withColumn("bundle", F.pmod("h", F.lit(bundles)).cast("long"))
        .join(F.broadcast(rest), "bundle", "left")
        .select(
            "id",
            "size",
            "crc",
            "h",
            F.coalesce("own", "rest").alias("shard"),
            F.pmod(F.xxhash64("id", "h"), F.lit(subs)).cast("int").alias("sub"),
        )
    )
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "sub").orderBy("id", "h", "crc", "size")
    return (
        dealt.withColumn("r", F.row_number().over(within))
        .join(offsets, ["shard", "sub"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("r") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver rows, in one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLE_SQL: dict[str, str] = {}
