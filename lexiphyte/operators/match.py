"""Matching query names to reference names: one probe join for all key rules, then edit distance within blocks of a genus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiphyte.functions.keys import KINDS, PARTS, with_keys
from lexiphyte.functions.text import blank_to_null
from lexiphyte.operators.near import with_near
from lexiphyte.operators.parse import PARSED, as_names, check_names, check_parse, with_parts
from lexiphyte.plans.cascade import CANONICAL, UNIQUE, label, probes, used
from lexiphyte.sources.tables import stored

SIMPLE = ("query", "reference", "match_type")
FULL = (*SIMPLE, "id_query", "id_ref", *(f"{p}_query" for p in PARTS), *(f"{p}_ref" for p in PARTS))

Names = list[str] | DataFrame


def is_parsed(names: Names) -> bool:
    return isinstance(names, DataFrame) and set(PARSED) <= set(names.columns)


def loaded(spark: SparkSession, names: Names, what: str, prefix: str = "df") -> DataFrame:
    """``row, pos, id, name`` and the parts of all names of a list, of a table, or of a table that is parsed already.

    ``row`` tells rows apart and is what everything joins on, so it must be stored before it is used twice; (pos, row) is
    their order. Without ``pos``, a parsed table is ordered by the numbers that its ids end in, as ``parse_names`` makes
    them from a list, where they have any, then by place in the scan.
    """
    if isinstance(names, (list, tuple)) or isinstance(names, DataFrame) and "name" in names.columns:
        if is_parsed(names):
            number = F.try_to_number(F.regexp_extract("id", "([0-9]{1,18})$", 1), F.lit("9" * 18))
            pos = F.col("pos") if "pos" in names.columns else F.coalesce(number, F.lit(0))
            found = names.select(pos.cast("long").alias("pos"), "id", "name", *PARTS)
        else:
            found = with_parts(as_names(spark, names, prefix))
        return found.select(F.monotonically_increasing_id().alias("row"), "pos", "id", "name", *PARTS)
    raise TypeError(f"{what} must be of class DataFrame or list")


def parses() -> Column:
    """Which rows of a ``prepared`` table are names that could be parsed."""
    return F.col("genus_name") != ""


def prepared(spark: SparkSession, names: Names, what: str, validate: bool | None, prefix: str) -> DataFrame:
    """All names with their keys, computed once and stored; what can't be parsed has no genus. Checks them unless
    ``validate`` is False."""
    every = stored(with_keys(loaded(spark, names, what, prefix)), what)
    if validate is not False:
        if is_parsed(names):
            if every.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count():
                raise ValueError(f"{what}: ids of parsed names must be unique and not null")
        elif isinstance(names, DataFrame):
            check_names(every)
        check_parse(every, failed=~parses())
    return every


def reference_keys(keyed: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """``kind, key``: the last reference row with each key (``last``: pos, row, id) and how many have it (``n``)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k_{k}").alias("key")) for k in KINDS if kinds is None or k in kinds))
    return keyed.select("pos", "row", "id", F.explode(pairs).alias("e")).groupBy("e.kind", "e.key").agg(F.max(F.struct("pos", "row", "id")).alias("last"), F.count("*").alias("n"))


def cascade(query: DataFrame, asked: DataFrame, ref: DataFrame, of_query: list[str], of_ref: dict[str, Column], max_dist: float = 10, match_no_auth: bool = False, match_canon: bool = False) -> DataFrame:
    """``of_query, of_ref, match_type`` for keyed tables: a row for each of ``asked``, more where edit distance finds several.

    ``asked`` holds the queries with what is shown of them, and may hold one several times. All lookups of a query go
    through one join on (kind, key); the reference side is reduced before it, with partial aggregation, so a key that very
    many rows share is one row. A hit on a query's own id doesn't count, and no earlier row with the key takes its place.
    Queries left over meet the references of their genus. As those may give very many pairs, pairs carry all that is
    shown and take part in no join any more. Joins are merged: a table read back is larger than its file lets Spark think.
    """
    rules = used(match_no_auth, match_canon)
    looked = query.select(F.col("row").alias("qrow"), F.col("id").alias("qid"), F.explode(probes(match_no_auth, match_canon)).alias("p")).select("qrow", "qid", "p.*")
    hits = looked.join(reference_keys(ref, {r.ref_kind for r in rules}).hint("merge"), ["kind", "key"]).where("last.id <> qid")
    if match_no_auth:
        hits = hits.where((F.col("pri") != UNIQUE.priority) | (F.col("n") == 1))
    row = F.col("last.row")
    best = hits.groupBy("qrow").agg(
        F.min(F.when(F.col("pri") < CANONICAL.priority, F.struct("pri", row.alias("rrow")))).alias("equi"),
        F.max(F.when(F.col("pri") == CANONICAL.priority, row)).alias("canon"),
    )
    # A genus is null for settled and for auct. queries, so that they meet none.
    state = asked.join(best.hint("merge"), asked["row"] == best["qrow"], "left").select(
        *of_query,
        F.coalesce("equi.rrow", "canon").alias("rrow"),
        F.when(F.col("equi").isNotNull(), label(F.col("equi.pri"))).when(F.col("canon").isNotNull(), CANONICAL.label).otherwise("no_match").alias("match_type"),
        F.when(F.col("equi").isNull() & ~F.col("auct"), F.col("genus_name")).alias("_genus"),
        F.col("id").alias("_id"),
        F.col("k_punct").alias("_key"),
        F.xxhash64("row", "query").alias("_hash"),
    )
    shown = [c.alias(name) for name, c in of_ref.items()]
    state = state.join(ref.select(F.col("row").alias("rrow"), *shown).hint("merge"), "rrow", "left")
    if max_dist < 0:
        return state.select(*of_query, *of_ref, "match_type")
    targets = ref.select(F.col("genus_name").alias("_genus"), F.col("id").alias("_id"), F.col("k_punct").alias("_key"), *shown)
    return with_near(state, targets, asked.groupBy(F.col("genus_name").alias("_genus")).count(), max_dist, of_query, list(of_ref))


def collapsed(query: DataFrame, exclude: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Queries whose infraspecific epithet repeats the species' lose it; names equal then are one. Also, for every query,
    ``query`` (its name) and ``qrow``, the row of the one that stands for it."""
    same = (F.col("specific_epithet") == F.col("infraspecific_epithet")) & (F.col("specific_epithet") != "")
    if exclude:
        same = same & ~F.coalesce(F.col("name").isin(list(exclude)), F.lit(False))
    cut = query.select("row", "pos", "id", "name", *(F.when(~same, F.col(p)).otherwise("").alias(p) if p.startswith("infraspecific") else p for p in PARTS))
    # The parts run together without separators, null as NA: names that read alike so count as one.
    cut = cut.withColumn("string", F.concat(*(F.coalesce(blank_to_null(F.col(p)), F.lit("NA")) for p in PARTS), F.lit("_")))
    first = cut.groupBy("string").agg(F.min(F.struct("pos", "row")).alias("m")).select("string", F.col("m.row").alias("qrow"))
    kept = cut.join(first.select(F.col("qrow").alias("row")), "row", "left_semi").drop("string")
    return kept, cut.join(first, "string").select(F.col("name").alias("query"), "qrow")


def match_names(
    spark: SparkSession,
    query: Names,
    reference: Names,
    manual_match: DataFrame | None = None,
    max_dist: float = 10,
    match_no_auth: bool = False,
    match_canon: bool = False,
    collapse_infra: bool = False,
    collapse_infra_exclude: list[str] | None = None,
    simple: bool = False,
    validate: bool | None = None,
) -> DataFrame:
    """Match every query name to reference names; columns SIMPLE or FULL, with ``query_new`` if matched manually too.

    ``manual_match`` (columns ``query``, ``match``; unique queries) overrides queries given as names;
    a match must be a name of the reference, and where that can't be parsed, its query is left out like any that can't.
    With ``collapse_infra``, a query like *Aus bus var. bus* is matched as *Aus bus*, unless its full name is excluded.
    Queries that can't be parsed are left out. Both sides are parsed and given their keys at once, and stored where
    executors share a folder, so that no branch of the plan does it again; what comes after is lazy. Unless ``validate``
    is False, repeated or null names, and repeated or null ids of parsed tables, raise, and names that can't be parsed warn.
    """
    _check(query, reference, max_dist, match_no_auth, match_canon, collapse_infra, simple)
    replaced = None
    if manual_match is not None:
        query, replaced, picks = _manual(spark, query, manual_match)
    # Tables without ids get them by side; a table matched to itself has the same on both, as equal lists have.
    q = prepared(spark, query, "query", validate, "df" if query is reference else "q")
    r = prepared(spark, reference, "reference", validate, "df" if query is reference else "r")
    if manual_match is not None:
        known = r.select(F.col("name").alias("match"))
        if picks.join(known.hint("merge"), "match", "left_anti").limit(1).count():
            raise ValueError("manual_match names references that are not there")
    q, r = q.where(parses()), r.where(parses())
    asked = q.withColumn("query", F.col("name"))
    if collapse_infra:
        left, stands_for = collapsed(q, collapse_infra_exclude)
        q = stored(with_keys(left), "query-collapsed")
        asked = q.join(stands_for.hint("merge"), F.col("row") == F.col("qrow"))
    if replaced is not None:
        asked = replaced.join(asked.withColumnRenamed("query", "query_new").hint("merge"), "query_new")
    of_query, of_ref = ["query"], {"reference": F.col("name")}
    if not simple:
        of_ref |= {"id_ref": F.col("id"), **{f"{p}_ref": blank_to_null(F.col(p)) for p in PARTS}}
        asked = asked.withColumns({"id_query": F.col("id"), **{f"{p}_query": blank_to_null(F.col(p)) for p in PARTS}})
        of_query += ["id_query", *(f"{p}_query" for p in PARTS)] + ["query_new"] * (replaced is not None)
    if replaced is not None:
        of_query.append("manual")
    out = cascade(q, asked, r, of_query, of_ref, max_dist, match_no_auth, match_canon)
    if replaced is None:
        return out.select(*(SIMPLE if simple else FULL))
    out = out.withColumn("match_type", F.when(F.col("manual"), "manual").otherwise(F.col("match_type")))
    return out.select(*(SIMPLE if simple else ("query", "query_new", *FULL[1:])))


def _manual(spark: SparkSession, query: Names, manual: DataFrame) -> tuple[Names, DataFrame, DataFrame]:
    """The names to match in place of the queries, the table from the queries to them, and the overrides, stored."""
    if not isinstance(manual, DataFrame):
        raise TypeError("manual_match must be of class DataFrame")
    if not {"query", "match"} <= set(manual.columns):
        raise ValueError("manual_match must have `query` and `match` columns")
    picks = stored(manual.select("query", "match"), "manual")
    if picks.groupBy("query").count().where("count > 1 OR query IS NULL").limit(1).count():
        raise ValueError("Queries of manual_match must be unique and not null")
    if is_parsed(query):
        raise TypeError("manual_match can only be used if query is given as names")
    if isinstance(query, (list, tuple)):
        # A list is on the driver already; only its own overrides come there.
        own = spark.createDataFrame([(x,) for x in dict.fromkeys(query)], "query string").join(picks, "query")
        to = {x["query"]: x["match"] for x in own.collect()}
        rows = [(x, to[x] if to.get(x) is not None else x, x in to) for x in query]
        return list(dict.fromkeys(new for _, new, _ in rows)), spark.createDataFrame(rows, "query string, query_new string, manual boolean"), picks
    pos = F.col("pos").cast("long") if "pos" in query.columns else F.monotonically_increasing_id()
    rows = query.select(pos.alias("pos"), F.col("name").alias("query")).join(picks.withColumn("manual", F.lit(True)).hint("merge"), "query", "left")
    rows = stored(rows.select("pos", "query", F.coalesce("match", "query").alias("query_new"), F.coalesce("manual", F.lit(False)).alias("manual")), "replaced")
    return rows.groupBy(F.col("query_new").alias("name")).agg(F.min("pos").alias("pos")), rows.drop("pos"), picks


def _check(query: Names, reference: Names, max_dist: float, *flags: bool) -> None:
    for what, x in (("query", query), ("reference", reference)):
        if not isinstance(x, (list, tuple, DataFrame)):
            raise TypeError(f"{what} must be of class DataFrame or list")
    if isinstance(max_dist, bool) or not isinstance(max_dist, (int, float)):
        raise TypeError("max_dist must be a number")
    if not all(isinstance(x, bool) for x in flags):
        raise TypeError("options must be True or False")
