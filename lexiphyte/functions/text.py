"""Text normalisation for scientific names, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HYBRID = "×"
_MARKS = "̧̦́̀̈̆̌̃̊̂"
RANKS = ("var", "f", "forma", "subf", "taxon", "fo", "subsp", "prol", "nothovar", "lus")

#: Seven groups: hybrid sign, genus, hybrid sign, epithet, rank, infraspecific epithet, author. Java and RE2 read it alike.
NAME_PATTERN = (
    "^([×xX]?) ?([A-Z][a-zë-]+) ?([×xX]? |[×X]?) ?([a-zﬂ-][a-zﬂ-]+)? ?"
    r"(var\.|f\.|forma|subf\.|taxon|fo\.|subsp\.|prol\.|nothovar\.|lus\.|\[infrasp\.unranked\])? ?([a-zﬂ_-]+)? ?"
    r"([\] \[().&;,’'\p{L}\p{N}" + _MARKS + "-]+)?$"
)
#: What each of the first six parts must look like; an epithet is required.
PART_PATTERNS = ("^[×xX]?$", "^[A-Z][a-zë-]+$", "^[×xX]?$", "^[a-zﬂ-][a-zﬂ-]+$", r"^([a-z]+\.?|\[infrasp\.unranked\])?$", "^([a-zﬂ-][a-zﬂ_-]+)?$")

PLAIN_FROM = "ùúûüÑÀÁÂÃÄÅìíîïÒÓÔÕÖØÇÐýÿÈÉÊËñàáâãäåòóôõöøßÙÚÛÜÞþçčÌÍÎÏðèéêëÝ"
PLAIN_TO = "uuuuNAAAAAAiiiiOOOOOOCDyyEEEEnaaaaaaoooooobUUUUppccIIIIdeeeeY"


def squeeze(c: Column) -> Column:
    """Runs of spaces to one, none at either end."""
    return F.trim(F.regexp_replace(c, " +", " "))


def depunct(c: Column) -> Column:
    """Letters without marks, digits, ``&`` and the hybrid sign, in lower case; all else goes."""
    return _bare(F.regexp_replace(_unmarked(c), " (and|et.?)  ", " & "))


def depunct_squeezed(c: Column) -> Column:
    """``depunct`` of a text without double spaces, of which it is that of its pieces one after the other."""
    return _bare(_unmarked(c))


def _unmarked(c: Column) -> Column:
    marked = F.replace(F.replace(F.translate(c, PLAIN_FROM, PLAIN_TO), F.lit("æ"), F.lit("ae")), F.lit("Æ"), F.lit("Ae"))
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(marked)  # most have ASCII alone


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9&×]+", ""))


def cleaned(c: Column) -> Column:
    """A field as keys take it: ``NULL`` and ``\\N`` are empty, spaces squeezed."""
    c = F.coalesce(c, F.lit(""))
    return squeeze(F.when(c.isin("NULL", "\\N"), F.lit("")).otherwise(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
