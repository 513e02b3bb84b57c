"""Parsing scientific names into their parts."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.functions.ids import name_table
from lexiphyte.functions.keys import PARTS
from lexiphyte.functions.text import NAME_PATTERN, PART_PATTERNS, blank_to_null, depunct, depunct_squeezed, squeeze

PARSED = ("name", "id", *PARTS)
#: Names that a warning spells out.
SHOWN = 20


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _holds(*texts: str) -> Callable[[Column], Column]:
    return lambda c: functools.reduce(Column.__or__, (c.contains(t) for t in texts))


def _mended(look: Callable[[Column], Column], pattern: str, to: str) -> Callable[[Column], Column]:
    return lambda c: F.when(look(c), F.regexp_replace(c, pattern, to)).otherwise(c)


def split_name(name: Column) -> Column:
    """The seven parts of a name as an array; null where it can't be parsed.

    A name that holds a ``|`` itself is never parsed.
    """
    clean = F.translate(F.replace(squeeze(name), F.lit(" ssp. "), F.lit(" subsp. ")), "\u00a0\u2014\u00bf/\"", " -")

    def found(c: Column) -> Column:
        x = F.regexp_replace(c, NAME_PATTERN, "$1|$2|$3|$4|$5|$6|$7")
        # Each pattern is tried only where a look says that it may be there.
        for look, pattern, to in ((_holds(" |"), r" *\|", "|"), (_holds("|auct"), r"\|(auctt?)\|\.", "||$1."), (_holds("|d|"), r"\|d\|", "||d"), (_holds("|x|", "|X|"), r"\|[xX]\|", "|×|"), (_holds("x|", "X|"), r"^[xX]\|", "×|")):
            x = bound(x, _mended(look, pattern, to))
        return x

    def checked(c: Column, f: Column) -> Column:
        # Put together again the parts have no double spaces, and single ones and bars don't count.
        same = F.replace(depunct_squeezed(f), F.lit("×"), F.lit("x")) == F.replace(depunct(c), F.lit("×"), F.lit("x"))

        def parts(x: Column) -> Column:
            good = (F.size(x) == 7) & same
            for k, pattern in enumerate(PART_PATTERNS):
                good = good & F.get(x, F.lit(k)).rlike(pattern)
            return F.when(good, x)

        return bound(F.split(f, r"\|", -1), parts)

    return F.when(~name.contains("|"), bound(clean, lambda c: bound(found(c), lambda f: checked(c, f))))


def with_parts(names: DataFrame) -> DataFrame:
    """``pos, id, name`` with the parts, all null where a name can't be parsed. Lazy, row by row, no shuffle.

    The parts pass through an explode of one element: without it, a filter on a part would be pushed below and have
    every name parsed twice.
    """
    joined = names.withColumn("_parts", F.explode(F.array(split_name(F.col("name")))))
    return joined.withColumns({p: blank_to_null(F.get("_parts", F.lit(k))) for k, p in enumerate(PARTS)}).drop("_parts")


def as_names(spark: SparkSession, names: list[str] | DataFrame, prefix: str = "df") -> DataFrame:
    """``pos, id, name``: of a list in its order, of a table by its ``pos``, or else by its rows' places in the scan.

    A table without ids gets them from its positions. Positions matter, as of equal keys the last one holds; so a table
    that comes out of a shuffle should bring ``pos`` along.
    """
    if isinstance(names, (list, tuple)):
        return name_table(spark, list(names))
    if not isinstance(names, DataFrame) or "name" not in names.columns:
        raise TypeError("names must be a list of strings or a DataFrame with a column `name`")
    pos = F.col("pos").cast("long") if "pos" in names.columns else F.monotonically_increasing_id()
    out = names.select(pos.alias("pos"), *(["id"] if "id" in names.columns else []), "name")
    return out if "id" in out.columns else out.select("pos", F.concat(F.lit(f"{prefix}-"), F.col("pos").cast("string")).alias("id"), "name")


def check_names(names: DataFrame) -> None:
    """Raise on nulls and repeats among the names of a table. An action."""
    repeated = names.groupBy("name").count().where("count > 1 OR name IS NULL").limit(1).collect()
    if repeated:
        raise ValueError("Names may not be null" if repeated[0]["name"] is None else f"Names occur more than once, such as {repeated[0]['name']!r}")


def check_parse(tried: DataFrame, quiet: bool = False, failed: Column | None = None) -> None:
    """Raise if nothing of a table with rows could be parsed, warn of what couldn't. An action."""
    failed = F.col("genus_name").isNull() if failed is None else failed
    total, bad = tried.agg(F.count("*"), F.count_if(failed)).first()
    if total and total == bad:
        raise ValueError("None of the names can be parsed")
    if bad and not quiet:
        listed = [r[0] for r in tried.where(failed).orderBy("pos").limit(SHOWN).select("name").collect()]
        rest = f" and {bad - len(listed)} more; see rejected_names()" if bad > len(listed) else ""
        warnings.warn(f"Names that could not be parsed are left out: {', '.join(listed)}{rest}", stacklevel=3)


def parse_with_positions(spark: SparkSession, names: list[str] | DataFrame, quiet: bool = False, validate: bool | None = None, prefix: str = "df") -> DataFrame:
    given = as_names(spark, names, prefix)
    tried = with_parts(given)
    if validate if validate is not None else isinstance(names, (list, tuple)):
        check_names(given)
        check_parse(tried, quiet)
    return tried.where(F.col("genus_name").isNotNull())


def parse_names(spark: SparkSession, names: list[str] | DataFrame, quiet: bool = False, validate: bool | None = None) -> DataFrame:
    """``name, id`` and seven parts of every name that can be parsed; the others are left out.

    A list is checked at once: it must be unique, without nulls and hold a parseable name; others bring a warning unless
    ``quiet``. A table stays lazy, and what can't be parsed in it goes without a word, unless ``validate``.
    """
    return parse_with_positions(spark, names, quiet, validate).select(*PARSED)


def rejected_names(spark: SparkSession, names: list[str] | DataFrame) -> DataFrame:
    """``name, id`` of what ``parse_names`` leaves out."""
    return with_parts(as_names(spark, names)).where(F.col("genus_name").isNull()).select("name", "id")
