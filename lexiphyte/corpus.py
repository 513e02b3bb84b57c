"""A synthetic list of scientific names from the ``part`` table, for queries and their checks.

Every part gives one reference name and one query, which repeats it, loses or changes its author, rank or sign, or has
a letter wrong. Both come from one SQL text that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LETTER = "substr('abcdefghijklmnopqrstuvwxyz', CAST(({}) % 26 AS INT) + 1, 1)"
_A, _B, _G = (_LETTER.format(x) for x in ("p_partkey", "floor(p_partkey / 7)", "p_partkey % 17"))

#: Every accented letter that names may be written without, one a part.
_ACCENTED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿÑñÇçčÐðÞþßÆæ"
_TYPE = "concat(upper(substr(p_type, 1, 1)), lower(substr(p_type, 2)))"
#: k, genus (its sign before it), epithet, infra (epithet or empty), rank, author and sign of each part. Names hold what
#: parsers stumble over: signs apart or not, ligatures, hyphens, fixed spaces, dashes, stray marks and accents.
BASE = f"""
SELECT p_partkey AS k,
  concat(CASE p_partkey % 37 WHEN 0 THEN 'x ' WHEN 1 THEN '×' ELSE '' END, upper(substr(adj, 1, 1)), substr(adj, 2), {_G}, CASE WHEN p_partkey % 43 = 0 THEN 'ë' ELSE '' END) AS genus,
  concat(CASE WHEN p_partkey % 41 = 0 THEN 'ﬂ' WHEN p_partkey % 47 = 0 THEN 'novae-' ELSE '' END, noun, {_A}, {_B}) AS epithet,
  CASE p_partkey % 5 WHEN 0 THEN concat(noun, {_B}) WHEN 1 THEN concat(noun, {_A}, {_B}) ELSE '' END AS infra,
  CASE p_partkey % 20 WHEN 0 THEN 'var.' WHEN 1 THEN 'var.' WHEN 5 THEN 'subsp.' WHEN 6 THEN 'ssp.' WHEN 10 THEN 'f.' WHEN 11 THEN 'var.' WHEN 15 THEN '[infrasp.unranked]' ELSE 'subsp.' END AS infra_rank,
  CASE p_partkey % 19 WHEN 0 THEN '' WHEN 1 THEN 'L.' WHEN 2 THEN '(L.) Smith' WHEN 3 THEN concat('Smith ex ', {_TYPE}) WHEN 4 THEN 'Smith in Jones' WHEN 5 THEN '(Bl.) K.\u00a0Iwats.'
    WHEN 6 THEN 'auct.' WHEN 7 THEN 'Smith & Jones' WHEN 8 THEN concat({_TYPE}, ' ex Brandt in Flora') WHEN 9 THEN 'Fée' WHEN 10 THEN 'd’Urv.' WHEN 11 THEN 'auctt.' WHEN 12 THEN 'Smith—Jones'
    WHEN 13 THEN 'Smith and \u00a0Jones' WHEN 14 THEN '¿Brown' WHEN 15 THEN 'De/Vol "K."' WHEN 16 THEN 'Smith and Jones' ELSE concat('B', substr('{_ACCENTED}', CAST(p_partkey % {len(_ACCENTED)} AS INT) + 1, 1), 'rn.') END AS author,
  CASE p_partkey % 23 WHEN 0 THEN 'x ' WHEN 1 THEN '×' WHEN 2 THEN '× ' ELSE '' END AS sign
FROM (SELECT p_partkey, p_type, split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun FROM part) p
"""
_NAME = "concat({g}, ' ', {sign}, {e}, CASE WHEN infra = '' THEN '' ELSE concat(' ', {rank}, ' ', infra) END, CASE WHEN {a} = '' THEN '' ELSE concat(' ', {a}) END)"


def _name(g: str = "genus", sign: str = "sign", e: str = "epithet", rank: str = "infra_rank", a: str = "author") -> str:
    return _NAME.format(g=g, sign=sign, e=e, rank=rank, a=a)


_NO_BRACKET = "CASE WHEN author LIKE '(%' THEN substr(author, strpos(author, ')') + 2) ELSE author END"
_FIRST = "CASE WHEN strpos(author, ' ') > 0 THEN split_part(author, ' ', 1) ELSE author END"
_BARE = "translate({}, 'ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿÑñÇçčÐðÞþß', 'AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOOooooooUUUUuuuuYyyNnCccDdppb')".format("author")
_UPPER = f"upper({_name()})"
REFERENCE = f"SELECT name, min(k) AS pos FROM (SELECT k, {_name()} AS name FROM ({BASE}) b) n GROUP BY name"
QUERY = f"""
SELECT name, min(k) AS pos FROM (
  SELECT k, CASE k % 17
    WHEN 0 THEN {_name()} WHEN 1 THEN {_name(a="''")} WHEN 2 THEN {_name(a=_NO_BRACKET)} WHEN 3 THEN {_name(a="concat('(X.) ', author)")}
    WHEN 4 THEN {_name(e="concat(substr(epithet, 1, length(epithet) - 1), 'q')")} WHEN 5 THEN {_name(rank="'f.'")} WHEN 6 THEN {_name(a=_FIRST)}
    WHEN 7 THEN {_name(a="concat(author, ' ex Young')")} WHEN 8 THEN {_name(a="concat(author, ' in Bull')")} WHEN 9 THEN {_name(a="'auct.'")}
    WHEN 10 THEN {_UPPER} WHEN 11 THEN {_name(g="concat(genus, 'zz')")} WHEN 12 THEN {_name(rank="'ssp.'")} WHEN 13 THEN {_name(a=_BARE)}
    WHEN 14 THEN concat('  ', replace({_name()}, ' ', '  ')) WHEN 15 THEN {_name(sign="''")} ELSE replace({_name()}, '. ', '.') END AS name
  FROM ({BASE}) b) n GROUP BY name
"""
#: Parts as taxa: most accepted (with no, an empty or their own accepted id), the others synonyms, some of them dangling.
TAXONOMY = f"""
SELECT CAST(k AS {{text}}) AS taxonID,
  CASE WHEN k % 6 = 0 THEN CAST(k - k % 24 + 1 AS {{text}}) WHEN k % 31 = 0 THEN CAST(-k AS {{text}}) WHEN k % 6 = 1 THEN '' WHEN k % 6 = 2 THEN CAST(k AS {{text}}) ELSE NULL END AS acceptedNameUsageID,
  CASE WHEN k % 6 = 0 OR k % 31 = 0 THEN 'synonym' ELSE 'accepted name' END AS taxonomicStatus, {_name()} AS scientificName, k AS pos
FROM ({BASE}) b
"""


def _upper(x: str) -> str:
    """Spark's SQL for what DuckDB's ``upper`` gives: each letter becomes one letter, where Java makes FL of a ligature."""
    return f"array_join(transform(split({x}, ''), c -> CASE WHEN c = 'ß' THEN 'ẞ' WHEN length(upper(c)) = 1 THEN upper(c) ELSE c END), '')"


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    # DuckDB says strpos where Spark says instr. The lateral view keeps the parts of a name columns: inlined into each of
    # the many cases that use them, they would pass the size that code is generated for.
    own = sql.replace(_UPPER, _upper(_name())).replace("strpos(", "instr(").replace("FROM part)", "FROM {part})").replace(") b", ") b LATERAL VIEW explode(array(1)) one AS one")
    return spark.sql(own, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def query_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, QUERY)


def reference_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, REFERENCE)


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxa = _view(spark, sf_dir, TAXONOMY.format(text="STRING"))
    # As above: filters and join keys would each hold a copy of what makes a name.
    return taxa.select(F.explode(F.array(F.struct(*taxa.columns))).alias("t")).select("t.*")
