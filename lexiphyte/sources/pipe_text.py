"""Pipe-delimited text of parsed names, and taxonomies from tab-separated files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.functions.keys import PARTS
from lexiphyte.functions.text import blank_to_null

COLUMNS = ("id", *PARTS)


def as_lines(parsed: DataFrame) -> DataFrame:
    """One ``value`` a name: id and seven parts joined by ``|``, null as nothing."""
    if not isinstance(parsed, DataFrame):
        raise TypeError("df must be of class DataFrame")
    if missing := [c for c in COLUMNS if c not in parsed.columns]:
        raise ValueError(f"df must include the following columns: {', '.join(COLUMNS)} (missing: {', '.join(missing)})")
    return parsed.select(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COLUMNS)).alias("value"))


def write_parsed(parsed: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write parsed names as text, without a header; returns the path."""
    as_lines(parsed).write.mode(mode).text(path)
    return path


def from_lines(lines: DataFrame) -> DataFrame:
    """Parsed columns of ``value`` lines; what lies beyond the seventh bar belongs to the author."""
    fields = F.split("value", r"\|", 8)
    return lines.select(*(blank_to_null(fields[k]).alias(c) for k, c in enumerate(COLUMNS)))


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    return from_lines(spark.read.text(path))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated taxonomy with a header, all columns as strings; an initial of one small letter, which no name
    parser takes, is written large in the name."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return raw.withColumn("scientificName", F.regexp_replace("scientificName", "v. d. (?=Bosch)", "V. D. "))
