"""The nine comparison keys of a parsed name, in one projection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiphyte.functions.text import cleaned, depunct_squeezed, squeeze

PARTS = tuple("genus_hybrid_sign genus_name species_hybrid_sign specific_epithet infraspecific_rank infraspecific_epithet author".split())
KINDS = tuple("exact punct noauth cfonly irank basio in exin basexin".split())

_BASIONYM, _IN = r"^\([^)]+\)", " [iI]n .*$"
_EXIN = " (?:[eE]x|[iI]n) .*$"


#: What a part, or the author without some of it, adds to keys.
_BARE = {p: f"_{p}" for p in PARTS}


def bare_columns() -> dict[str, Column]:
    """The (cleaned) parts without marks and punctuation, as keys are made of: of the author also without the bracket,
    without what follows *in*, and without what follows *ex* or *in*."""
    author, whole = F.col("author"), depunct_squeezed(F.col("author"))
    has = lambda *words: functools.reduce(Column.__or__, (author.contains(w) for w in words))
    without = lambda pattern: depunct_squeezed(F.regexp_replace(author, pattern, ""))
    return {_BARE[p]: depunct_squeezed(F.col(p)) for p in PARTS} | {
        "_basio": F.when(author.startswith("("), without(_BASIONYM)).otherwise(whole),
        "_in": F.when(has(" in ", " In "), without(_IN)).otherwise(whole),
        "_exin": F.when(has(" in ", " In ", " ex ", " Ex "), without(_EXIN)).otherwise(whole),
    }


def key_columns() -> dict[str, Column]:
    """Each key as an expression over the (cleaned) part columns and ``bare_columns``."""
    xg, g, xs, s, rank, infra, author = (F.col(c) for c in _BARE.values())
    stem = F.concat(xg, g, xs, s, rank, infra)
    return {
        "exact": squeeze(F.concat_ws(" ", *(F.col(p) for p in PARTS))),
        "punct": F.concat(stem, author),
        "noauth": stem,
        "cfonly": F.concat(g, s, infra),
        "irank": F.concat(xg, g, xs, s, infra, author),
        "basio": F.concat(stem, "_basio"),
        "in": F.concat(stem, "_in"),
        "exin": F.concat(stem, "_exin"),
        # One of the two goes, the bracket first: never both.
        "basexin": F.concat(stem, F.when(F.col("author").rlike(_BASIONYM), F.col("_basio")).otherwise(F.col("_exin"))),
    }


def with_keys(parsed: DataFrame) -> DataFrame:
    """The parsed names with cleaned parts (never null), nine keys ``k_<kind>``, ``no_author`` and ``auct``."""
    plain = parsed.withColumns({p: cleaned(F.col(p)) for p in PARTS}).withColumns(bare_columns())
    keyed = plain.withColumns({f"k_{k}": c for k, c in key_columns().items()} | {"no_author": F.col("author") == "", "auct": F.col("author").rlike(r"^auct\.?$")})
    return keyed.drop(*bare_columns())
