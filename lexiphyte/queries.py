"""The name queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte import oracle
from lexiphyte.corpus import query_names, reference_names, taxonomy
from lexiphyte.functions.keys import KINDS, PARTS, with_keys
from lexiphyte.operators.match import match_names
from lexiphyte.operators.parse import parse_names, parse_with_positions, rejected_names
from lexiphyte.operators.resolve import classify, resolve_names
from lexiphyte.sources.pipe_text import read_parsed, write_parsed
from lexiphyte.sources.tables import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def parse_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_names(spark, query_names(spark, sf_dir)).select("name", *PARTS)


def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected_names(spark, query_names(spark, sf_dir)).select("name")


def depunct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = with_keys(parse_with_positions(spark, reference_names(spark, sf_dir)))
    return keyed.select("name", *(f"k_{k}" for k in KINDS), "no_author", "auct")


def _rule(label: str) -> Query:
    """What the one rule settles when all of them run."""
    return lambda spark, sf_dir: _match(max_dist=3, match_no_auth=True, match_canon=True)(spark, sf_dir).where(F.col("match_type") == label)


def _match(simple: bool = True, **options) -> Query:
    return lambda spark, sf_dir: match_names(spark, query_names(spark, sf_dir), reference_names(spark, sf_dir), simple=simple, **options)


def match_self_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = reference_names(spark, sf_dir)
    return match_names(spark, names, names, max_dist=3, simple=True)


def match_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last of references that differ in punctuation alone can be reached."""
    return match_names(spark, query_names(spark, sf_dir), _twice(spark, sf_dir), max_dist=0, simple=True)


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = reference_names(spark, sf_dir)
    return names.unionByName(names.select(F.concat("name", F.lit(".")).alias("name"), (F.col("pos") + 10_000_000).alias("pos")))


def match_auct_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_names(spark, query_names(spark, sf_dir), reference_names(spark, sf_dir), match_canon=True).where("author_query LIKE 'auct%'").select("query", "reference", "match_type")


def _manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = query_names(spark, sf_dir), reference_names(spark, sf_dir)
    return q.select(F.col("name").alias("query"), "pos").join(r.select(F.col("name").alias("match"), "pos"), "pos").where("query LIKE '%zz %'").select("query", "match")


def _manually(**options) -> Query:
    return lambda spark, sf_dir: match_names(spark, query_names(spark, sf_dir), reference_names(spark, sf_dir), manual_match=_manual(spark, sf_dir), simple=True, **options)


def classify_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_match()(spark, sf_dir))


def _resolve(where: str = "true") -> Query:
    return lambda spark, sf_dir: resolve_names(spark, query_names(spark, sf_dir), taxonomy(spark, sf_dir), max_dist=4).where(where)


def resolve_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = taxonomy(spark, sf_dir)
    reference = names.groupBy(F.col("scientificName").alias("name")).agg(F.min("pos").alias("pos"))
    return resolve_names(spark, match_names(spark, query_names(spark, sf_dir), reference, max_dist=10), names)


def write_pipe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed names written as pipe-delimited text and read again."""
    return read_parsed(spark, write_parsed(parse_names(spark, reference_names(spark, sf_dir)), f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"))


def match_parsed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were parsed apart and united, whose ids end in the same numbers."""
    names = reference_names(spark, sf_dir)
    side = lambda x, name: parse_names(spark, names.select(F.concat(F.lit(f"{x}-"), F.col("pos").cast("string")).alias("id"), name.alias("name"), "pos"))
    both = side("a", F.col("name")).unionByName(side("b", F.concat("name", F.lit("."))))
    return match_names(spark, parse_names(spark, query_names(spark, sf_dir)), both, max_dist=2)


_ACCEPTED = "resolved_name IS NOT NULL AND resolved_name = matched_name AND match_type <> 'no_match'"
_SYNONYM = "resolved_name IS NOT NULL AND resolved_name <> matched_name"
_AMBIGUOUS = "resolved_name IS NULL AND matched_name IS NOT NULL"
_DANGLING = "resolved_name IS NULL AND matched_status = 'synonym'"

_RULE_NAMES = {"exact": "exact", "auto_punct": "punct", "auto_noauth": "noauth_unique", "auto_basio-": "basio_minus", "auto_basio+": "basio_plus", "auto_in-": "in_minus", "auto_in+": "in_plus", "auto_exin-": "exin_minus", "auto_exin+": "exin_plus", "auto_basexin": "basexin", "auto_irank": "irank", "auto_cfonly": "cfonly"}

QUERIES: dict[str, Query] = {
    "parse_components": parse_components,
    "parse_rejects": parse_rejects,
    "depunct_keys": depunct_keys,
    **{f"match_{name}": _rule(label) for label, name in _RULE_NAMES.items()},
    "match_simple": _match(),
    "match_cascade_full": _match(simple=False, max_dist=5, match_no_auth=True, match_canon=True),
    "match_canon": _match(match_canon=True, max_dist=2),
    "match_fuzzy_k2": _match(max_dist=2),
    "match_fuzzy_k10": _match(max_dist=10, match_no_auth=True),
    "match_fuzzy_boundary": _match(max_dist=3),
    "match_fuzzy_fraction": _match(max_dist=2.5),
    "match_self_suppressed": match_self_suppressed,
    "match_last_wins": match_last_wins,
    "match_parsed_union": match_parsed_union,
    "match_auct_gate": match_auct_gate,
    "match_collapse_infra": _match(collapse_infra=True),
    "match_manual": _manually(),
    "match_manual_collapse": _manually(collapse_infra=True),
    "classify_multiplicity": classify_multiplicity,
    "resolve_full": _resolve(),
    "resolve_accepted": _resolve(_ACCEPTED),
    "resolve_synonym": _resolve(_SYNONYM),
    "resolve_ambiguous": _resolve(_AMBIGUOUS),
    "resolve_dangling": _resolve(_DANGLING),
    "resolve_match_table": resolve_match_table,
    "write_pipe_roundtrip": write_pipe_roundtrip,
}

_PARTS = ", ".join(PARTS)
_TWICE = f"SELECT name, pos FROM ({oracle.REFERENCE}) a UNION ALL SELECT name || '.', pos + 10000000 FROM ({oracle.REFERENCE}) b"
_APART = f"SELECT name, pos, 'a-' || pos AS id FROM ({oracle.REFERENCE}) a UNION ALL SELECT name || '.', pos, 'b-' || pos FROM ({oracle.REFERENCE}) b"
ORACLE_SQL: dict[str, str] = {
    "parse_components": f"SELECT name, {_PARTS} FROM ({oracle.parsed(oracle.QUERY, 'q')}) p",
    "parse_rejects": f"SELECT name FROM ({oracle.QUERY}) a WHERE name NOT IN (SELECT name FROM ({oracle.parsed(oracle.QUERY, 'q')}) p)",
    "depunct_keys": f"SELECT name, {', '.join(f'k_{k}' for k in KINDS)}, no_author, auct FROM ({oracle.keyed(oracle.parsed(oracle.REFERENCE, 'r'))}) k",
    **{f"match_{name}": oracle.rule(label) for label, name in _RULE_NAMES.items()},
    "match_simple": oracle.match(),
    "match_cascade_full": oracle.match(oracle.FULL, k=5, no_auth=True, canon=True),
    "match_canon": oracle.match(k=2, canon=True),
    "match_fuzzy_k2": oracle.match(k=2),
    "match_fuzzy_k10": oracle.match(k=10, no_auth=True),
    "match_fuzzy_boundary": oracle.match(k=3),
    "match_fuzzy_fraction": oracle.match(k=2.5),
    "match_self_suppressed": oracle.match(query=oracle.REFERENCE, ids=("df", "df"), k=3),
    "match_last_wins": oracle.match(reference=_TWICE, k=0),
    "match_parsed_union": oracle.match(oracle.FULL, query=f"SELECT *, 'df-' || pos AS id FROM ({oracle.QUERY}) x", reference=_APART, ids=(None, None), k=2, order="pos * 2 + CASE WHEN id LIKE 'b%' THEN 1 ELSE 0 END"),
    "match_auct_gate": oracle.match(oracle.SIMPLE + " WHERE q.author LIKE 'auct%'", canon=True),
    "match_collapse_infra": oracle.COLLAPSED,
    "match_manual": oracle.MANUALLY,
    "match_manual_collapse": oracle.MANUALLY_COLLAPSED,
    "classify_multiplicity": oracle.CLASSIFIED,
    "resolve_full": oracle.resolve(),
    "resolve_accepted": oracle.resolve(_ACCEPTED),
    "resolve_synonym": oracle.resolve(_SYNONYM),
    "resolve_ambiguous": oracle.resolve(_AMBIGUOUS),
    "resolve_dangling": oracle.resolve(_DANGLING),
    "resolve_match_table": oracle.resolve(k=10),
    "write_pipe_roundtrip": f"SELECT id, {_PARTS} FROM ({oracle.parsed(oracle.REFERENCE, 'df')}) p",
}
