"""Resolving matched names to accepted names through a taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiphyte.operators.match import Names, match_names
from lexiphyte.sources.tables import stored

RESOLVED = ("query", "resolved_name", "matched_name", "resolved_status", "matched_status", "match_type")
#: Parts over which matches to no name go.
DEALT = 64
TAXONOMY = tuple("taxonID acceptedNameUsageID taxonomicStatus scientificName".split())


def classify(matches: DataFrame) -> DataFrame:
    """The match table with ``result_type``: single_match, mult_match or no_match, by its rows of each query string."""
    if not isinstance(matches, DataFrame):
        raise TypeError("match_results must be of class DataFrame")
    return matches.withColumn("result_type", result_type(F.count("*").over(Window.partitionBy("query"))))


def result_type(n: Column) -> Column:
    """Of a match whose query has ``n`` of them."""
    unknown = F.when(F.col("match_type").isNull(), F.raise_error(F.lit("match_type must not be null")))
    return unknown.when(F.col("match_type") == "no_match", "no_match").when(n == 1, "single_match").otherwise("mult_match")


def resolve_names(spark: SparkSession, query: Names, taxonomy: DataFrame, max_dist: float = 10, match_no_auth: bool = False, match_canon: bool = False, collapse_infra: bool = False, collapse_infra_exclude: list[str] | None = None) -> DataFrame:
    """Accepted names of queries; columns RESOLVED, the first ones null where none is certain.

    ``query`` is a list or table of names, matched here to the taxonomy's distinct names, or a match table (columns
    ``query, reference, match_type``). A single match to an accepted row (accepted id null, empty or its own) resolves
    to itself. Matches to synonyms resolve, by one step, if all of a query's synonym rows lead to the same name; a
    dangling step counts as the name null. All other queries keep their matches and stay unresolved.
    """
    if not isinstance(query, (list, tuple, DataFrame)):
        raise TypeError("query must be of class DataFrame or list")
    if not isinstance(taxonomy, DataFrame):
        raise TypeError("ref_taxonomy must be of class DataFrame")
    if missing := set(TAXONOMY) - set(taxonomy.columns):
        raise ValueError(f"ref_taxonomy lacks columns: {', '.join(sorted(missing))}")
    # Ids may be numbers; they're compared as strings. Stored, as it is read several times and Spark, going by the size of
    # the file that it comes from, would send it to the driver.
    keep = F.col("pos") if "pos" in taxonomy.columns else F.monotonically_increasing_id()
    taxa = stored(taxonomy.select(keep.alias("pos"), *(F.col(c).cast("string").alias(c) for c in TAXONOMY)), "taxa")
    if isinstance(query, DataFrame) and {"query", "reference", "match_type"} <= set(query.columns):
        matches = query.select("query", "reference", "match_type")
    else:
        reference = taxa.where(F.col("scientificName").isNotNull()).groupBy(F.col("scientificName").alias("name")).agg(F.min("pos").alias("pos"))
        matches = match_names(spark, query, reference, None, max_dist, match_no_auth, match_canon, collapse_infra, collapse_infra_exclude, simple=True)

    # Matches may be very many, so they meet the taxonomy once and are grouped once. No match at all (null) meets taxa
    # without a name, of which there are hardly any: those go wherever such matches are dealt.
    deal = F.when(F.col("reference").isNull(), F.pmod(F.xxhash64("query"), F.lit(DEALT)).cast("int")).otherwise(0)
    met = matches.withColumn("dealt", deal).join(_steps(taxa).hint("merge"), (F.col("dealt") == F.col("at")) & F.col("reference").eqNullSafe(F.col("scientificName")), "left")
    # A reference that the taxonomy lacks has no accepted id either.
    own, syn, first, lead = (F.coalesce(c, F.lit(if_none)).alias(c) for c, if_none in (("own", True), ("syn", False), ("first", True), ("lead", True)))
    met = met.select("query", "reference", "match_type", "status", "target", "target_status", own, syn, first, lead)
    group, target = Window.partitionBy("query"), F.when(F.col("syn"), F.col("target"))
    met = met.select(
        "*",
        F.count_if("first").over(group).alias("n"),
        F.max("own").over(group).alias("any_own"),
        F.count_if("syn").over(group).alias("steps"),
        F.count(target).over(group).alias("named"),
        F.min(target).over(group).alias("lo"),
        F.max(target).over(group).alias("hi"),
    )
    # One distinct target, null counted as a value.
    agreed = F.col("query").isNotNull() & (F.col("steps") > 0) & ((F.col("named") == 0) | ((F.col("named") == F.col("steps")) & (F.col("lo") == F.col("hi"))))
    single = result_type(F.col("n")) == "single_match"
    marked = met.select("*", (F.col("own") & single).alias("accepted"), (F.col("syn") & agreed).alias("through"), (agreed | (F.col("any_own") & single)).alias("done"))
    return marked.where("accepted OR through OR (lead AND NOT done)").select(
        "query",
        F.when(F.col("accepted"), F.col("reference")).when(F.col("through"), F.col("target")).alias("resolved_name"),
        F.col("reference").alias("matched_name"),
        F.when(F.col("accepted"), F.col("status")).when(F.col("through"), F.col("target_status")).alias("resolved_status"),
        F.col("status").alias("matched_status"),
        "match_type",
    )


def _steps(taxa: DataFrame) -> DataFrame:
    """Each taxon with what its accepted id leads to, a row a target; ``lead`` marks one row of a taxon, ``first`` one of a
    name, ``at`` where matches to the name are dealt."""
    accepted_id = F.col("acceptedNameUsageID")
    own = F.coalesce(accepted_id.isNull() | (accepted_id == "") | (F.col("taxonID") == accepted_id), F.lit(False))
    syn = F.coalesce(accepted_id.isNotNull() & (accepted_id != "") & (accepted_id != F.col("taxonID")), F.lit(False))
    side = taxa.select("scientificName", F.col("taxonomicStatus").alias("status"), own.alias("own"), syn.alias("syn"), F.when(syn, accepted_id).alias("leads"))
    named = Window.partitionBy("to").orderBy("target", "target_status")
    targets = taxa.where(F.col("taxonID").isNotNull()).select(F.col("taxonID").alias("to"), F.col("scientificName").alias("target"), F.col("taxonomicStatus").alias("target_status")).withColumn("nth", F.row_number().over(named))
    met = side.join(targets.hint("merge"), F.col("leads") == F.col("to"), "left")
    nth = F.row_number().over(Window.partitionBy("scientificName").orderBy("leads", "nth", "status"))
    at = F.explode(F.when(F.col("scientificName").isNull(), F.sequence(F.lit(0), F.lit(DEALT - 1))).otherwise(F.array(F.lit(0))))
    return met.select("scientificName", "status", "own", "syn", "target", "target_status", (F.coalesce("nth", F.lit(1)) == 1).alias("lead"), (nth == 1).alias("first")).select("*", at.alias("at"))
