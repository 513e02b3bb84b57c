"""The match rules as data: priority, label, the query's key and the kind of reference key that it is looked up in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    priority: int
    label: str
    query_kind: str
    ref_kind: str


#: First hit wins. The last one is tried only after edit distance has found nothing.
RULES = (
    Rule(1, "exact", "exact", "exact"),
    Rule(2, "auto_punct", "punct", "punct"),
    Rule(3, "auto_noauth", "noauth", "noauth"),
    Rule(4, "auto_basio-", "punct", "basio"),
    Rule(5, "auto_basio+", "basio", "punct"),
    Rule(6, "auto_in-", "punct", "in"),
    Rule(7, "auto_in+", "in", "punct"),
    Rule(8, "auto_exin-", "punct", "exin"),
    Rule(9, "auto_exin+", "exin", "punct"),
    Rule(10, "auto_basexin", "basexin", "basexin"),
    Rule(11, "auto_irank", "irank", "irank"),
)
UNIQUE = RULES[2]
CANONICAL = Rule(13, "auto_cfonly", "cfonly", "cfonly")


def used(match_no_auth: bool, match_canon: bool) -> list[Rule]:
    return [r for r in RULES if match_no_auth or r is not UNIQUE] + ([CANONICAL] if match_canon else [])


def probes(match_no_auth: bool, match_canon: bool) -> Column:
    """All lookups of a query as an array of (pri, kind, key); gated ones are null entries that the explode drops."""
    made = []
    for r in used(match_no_auth, match_canon):
        one = F.struct(F.lit(r.priority).alias("pri"), F.lit(r.ref_kind).alias("kind"), F.col(f"k_{r.query_kind}").alias("key"))
        made.append(F.when(F.col("no_author"), one) if r is UNIQUE else one)
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def label(priority: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for r in (*RULES, CANONICAL) for x in (r.priority, r.label))), priority)
