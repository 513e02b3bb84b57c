"""Ids of name lists: a hash of the whole list and the place in it, so equal lists have equal ids."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession


def list_hash(names: list[str]) -> str:
    """Eight hexadecimal digits over the whole list, in the serialised form of a character vector."""
    h = hashlib.md5(struct.pack(">ii", 16, len(names)), usedforsecurity=False)
    for name in names:
        raw = name.encode()
        h.update(struct.pack(">ii", 0x40009 if name.isascii() else 0x8009, len(raw)) + raw)
    return h.hexdigest()[:8]


def name_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """``pos, id, name`` of a list; raises on nulls and repeats."""
    if any(x is None for x in names):
        raise ValueError("Names may not be null")
    if not all(isinstance(x, str) for x in names):
        raise TypeError("taxa must be strings")
    if len(set(names)) < len(names):
        raise ValueError("Names must be unique")
    prefix = list_hash(names)
    return spark.createDataFrame([(k, f"{prefix}-{k}", x) for k, x in enumerate(names, 1)], "pos long, id string, name string")
