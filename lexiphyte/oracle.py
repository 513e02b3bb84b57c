"""The name operators once more as SQL for DuckDB, written from their rules and used only to check results.

Nothing here comes from the modules under check but the synthetic names themselves: patterns, letters and the list of
rules are stated anew.
"""

from __future__ import annotations

from lexiphyte.corpus import QUERY, REFERENCE, TAXONOMY

PARTS = ("genus_hybrid_sign", "genus_name", "species_hybrid_sign", "specific_epithet", "infraspecific_rank", "infraspecific_epithet", "author")
KINDS = ("exact", "punct", "noauth", "cfonly", "irank", "basio", "in", "exin", "basexin")

#: Letters that stand for others, by what they become.
_LETTERS = {
    "A": "ÀÁÂÃÄÅ", "C": "Ç", "D": "Ð", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "N": "Ñ", "O": "ÒÓÔÕÖØ", "U": "ÙÚÛÜ", "Y": "Ý",
    "a": "àáâãäå", "b": "ß", "c": "çč", "d": "ð", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "p": "Þþ", "u": "ùúûü", "y": "ýÿ", "ae": "æ", "Ae": "Æ",
}
_SIGN, _LIGATURE, _GRAVES = "×", "ﬂ", "̧̦̀́̂̃̆̈̊̌"
_RANK = "|".join([*(r + r"\." for r in ("var", "f", "subf", "fo", "subsp", "prol", "nothovar", "lus")), "forma", "taxon", r"\[infrasp\.unranked\]"])
#: Each part with the blanks around it, in its place in a whole name; and what it must be when it stands alone.
_WHOLE = [
    f"([xX{_SIGN}]?) ?", "([A-Z][-a-zë]+) ?", f"([xX{_SIGN}]? |[X{_SIGN}]?) ?", f"([-a-z{_LIGATURE}][-a-z{_LIGATURE}]+)? ?", f"({_RANK})? ?", f"([-_a-z{_LIGATURE}]+)? ?",
    rf"([-\]\[ ().&;,'’\p{{L}}\p{{N}}{_GRAVES}]+)?",
]
_ALONE = [f"[xX{_SIGN}]?", "[A-Z][-a-zë]+", f"[xX{_SIGN}]?", f"[-a-z{_LIGATURE}]{{2,}}", r"(?:[a-z]+\.?|\[infrasp\.unranked\])?", f"(?:[-a-z{_LIGATURE}][-_a-z{_LIGATURE}]+)?"]
#: Priority, label, the query's key, the reference's key.
_RULES = [
    (1, "exact", "exact", "exact"), (2, "auto_punct", "punct", "punct"), (3, "auto_noauth", "noauth", "noauth"), (4, "auto_basio-", "punct", "basio"), (5, "auto_basio+", "basio", "punct"), (6, "auto_in-", "punct", "in"),
    (7, "auto_in+", "in", "punct"), (8, "auto_exin-", "punct", "exin"), (9, "auto_exin+", "exin", "punct"), (10, "auto_basexin", "basexin", "basexin"), (11, "auto_irank", "irank", "irank"), (13, "auto_cfonly", "cfonly", "cfonly"),
]


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_s(pattern)}, {_s(to)}, 'g')"


def _squeeze(x: str) -> str:
    return _sub(_sub(x, " {2,}", " "), "^ | $", "")


def _depunct(x: str) -> str:
    for plain, letters in _LETTERS.items():
        x = _sub(x, f"[{letters}]", plain) if len(letters) > 1 else f"replace({x}, '{letters}', '{plain}')"
    return f"lower({_sub(_sub(_sub(x, '[()]', '_'), ' (?:and|et.?)  ', ' & '), f'[^a-zA-Z0-9&{_SIGN}]', '')})"


def parsed(source: str, prefix: str | None) -> str:
    """pos, id, name and parts (null where empty) of a (name, pos) query, or one with an id of its own; only what parses."""
    clean = f"replace(replace({_sub(f"replace({_squeeze('name')}, ' ssp. ', ' subsp. ')", '[¿/\"]', '')}, chr(160), ' '), chr(8212), '-')"
    found = _sub("clean", f"^{''.join(_WHOLE)}$", "|".join(f"\\{k}" for k in range(1, 8)))
    found = _sub(found, r" *\|", "|")
    found = _sub(_sub(found, r"\|(auctt?)\|\.", r"||\1."), r"\|d\|", "||d")
    found = _sub(_sub(found, r"\|[xX]\|", f"|{_SIGN}|"), r"^[xX]\|", f"{_SIGN}|")
    remade = _sub(_sub("replace(found, '|', ' ')", " {2,}", " "), "^ | $", "")
    good = " AND ".join(f"regexp_full_match(f[{k}], {_s(p)})" for k, p in enumerate(_ALONE, 1))
    parts = ", ".join(f"CASE WHEN f[{k}] <> '' THEN f[{k}] END AS {p}" for k, p in enumerate(PARTS, 1))
    own = "id" if prefix is None else f"'{prefix}-' || pos AS id"
    return f"""
SELECT pos, {own}, name, {parts} FROM (
  SELECT *, string_split(found, '|') AS f FROM (SELECT *, {found} AS found FROM (SELECT *, {clean} AS clean FROM ({source}) s) c) d)
WHERE len(f) = 7 AND NOT contains(name, '|') AND {good} AND replace({_depunct(remade)}, '{_SIGN}', 'x') = replace({_depunct("clean")}, '{_SIGN}', 'x')"""


def keyed(source: str) -> str:
    """The parsed names with their nine keys, from the parts squeezed and never null."""
    parts = ", ".join(f"{_squeeze(f"coalesce({p}, '')")} AS p{k}" for k, p in enumerate(PARTS, 1))
    stem = "p1 || p2 || p3 || p4 || p5 || p6"
    bracket, ex_in = r"^\([^)]+\)", " (?:[eE]x|[iI]n) .*$"
    once = lambda pattern: f"regexp_replace(p7, {_s(pattern)}, '')"
    keys = {
        "exact": _squeeze("p1 || ' ' || p2 || ' ' || p3 || ' ' || p4 || ' ' || p5 || ' ' || p6 || ' ' || p7"),
        "punct": _depunct(f"{stem} || p7"),
        "noauth": _depunct(stem),
        "cfonly": _depunct("p2 || p4 || p6"),
        "irank": _depunct("p1 || p2 || p3 || p4 || p6 || p7"),
        "basio": _depunct(f"{stem} || {once(bracket)}"),
        "in": _depunct(f"{stem} || {once(' [iI]n .*$')}"),
        "exin": _depunct(f"{stem} || {once(ex_in)}"),
        "basexin": _depunct(f"{stem} || {once(f'(?:{bracket}|{ex_in})')}"),
    }
    columns = ", ".join(f"{keys[k]} AS k_{k}" for k in KINDS)
    return f"SELECT * EXCLUDE (p1, p2, p3, p4, p5, p6, p7), {columns}, p7 = '' AS no_author, p7 IN ('auct', 'auct.') AS auct FROM (SELECT *, {parts} FROM ({source}) p) w"


def _within(k: float) -> str:
    # Bytes are what DuckDB's distance counts, so the one sign beyond ASCII becomes a byte.
    return f"""(d < {k} OR (d = {k} AND NOT (length(t) > 0 AND levenshtein(q, left(t, -1)) + 1 = d
  AND d < levenshtein(left(q, -1), left(t, -1)) + CASE WHEN q = '' OR right(q, 1) <> right(t, 1) THEN 1 ELSE 0 END
  AND d < levenshtein(left(q, -1), t) + 1)))"""


def matched(q: str, r: str, k: float = 10, no_auth: bool = False, canon: bool = False, order: str = "pos") -> str:
    """CTEs up to ``out``: qpos, rpos, match_type for parsed queries. ``order`` puts the references in order."""
    rules = [x for x in _RULES if (no_auth or x[0] != 3) and (canon or x[0] != 13)]
    probes = " UNION ALL ".join(f"SELECT pos AS qpos, id AS qid, {pri} AS pri, '{label}' AS label, '{to}' AS kind, k_{of} AS key FROM q" + (" WHERE no_author" if pri == 3 else "") for pri, label, of, to in rules)
    keys = " UNION ALL ".join(f"SELECT '{x}' AS kind, k_{x} AS key, id, {order} AS place FROM r" for x in KINDS)
    return f"""
q AS MATERIALIZED ({keyed(q)}), r AS MATERIALIZED ({keyed(r)}),
rk AS (SELECT kind, key, arg_max(id, place) AS rid, count(*) AS n FROM ({keys}) GROUP BY kind, key),
hits AS (SELECT p.qpos, p.pri, p.label, rk.rid FROM ({probes}) p JOIN rk USING (kind, key) WHERE rk.rid <> p.qid AND (p.pri <> 3 OR rk.n = 1)),
equi AS (SELECT qpos, arg_min(rid, pri) AS rid, arg_min(label, pri) AS match_type FROM hits WHERE pri <= 11 GROUP BY qpos),
rest AS (SELECT * FROM q WHERE pos NOT IN (SELECT qpos FROM equi)),
fuzzy AS (SELECT qpos, rid, 'auto_fuzzy' AS match_type FROM (
  SELECT rest.pos AS qpos, r.id AS rid, replace(rest.k_punct, '×', '#') AS q, replace(r.k_punct, '×', '#') AS t, levenshtein(replace(rest.k_punct, '×', '#'), replace(r.k_punct, '×', '#')) AS d
  FROM rest JOIN r ON rest.genus_name = r.genus_name AND r.id <> rest.id WHERE NOT rest.auct) WHERE {_within(k)}),
loose AS (SELECT hits.qpos, hits.rid, label AS match_type FROM hits JOIN rest ON rest.pos = hits.qpos WHERE pri = 13 AND hits.qpos NOT IN (SELECT qpos FROM fuzzy)),
settled AS (SELECT * FROM equi UNION ALL SELECT * FROM fuzzy UNION ALL SELECT * FROM loose),
out AS (SELECT * FROM settled UNION ALL SELECT pos, NULL, 'no_match' FROM q WHERE pos NOT IN (SELECT qpos FROM settled))"""


_ROWS = "FROM out JOIN q ON q.pos = out.qpos LEFT JOIN r ON r.id = out.rid"
SIMPLE = f"SELECT q.name AS query, r.name AS reference, match_type {_ROWS}"
FULL = (
    "SELECT q.name AS query, r.name AS reference, match_type, q.id AS id_query, r.id AS id_ref, "
    + ", ".join(f"q.{p} AS {p}_query" for p in PARTS)
    + ", "
    + ", ".join(f"r.{p} AS {p}_ref" for p in PARTS)
    + f" {_ROWS}"
)


def match(select: str = SIMPLE, query: str = QUERY, reference: str = REFERENCE, ids: tuple[str | None, str | None] = ("q", "r"), **options) -> str:
    return f"WITH {matched(parsed(query, ids[0]), parsed(reference, ids[1]), **options)} {select}"


def rule(label: str) -> str:
    return match(f"{SIMPLE} WHERE match_type = '{label}'", k=3, no_auth=True, canon=True)


def collapse(query: str) -> str:
    """CTEs c (queries with their collapsed parts and key_pos) and the collapsed, distinct queries as parsed rows."""
    same = "coalesce(specific_epithet = infraspecific_epithet, false)"
    cut = ", ".join(f"CASE WHEN {same} THEN NULL ELSE {p} END AS {p}" if p.startswith("infraspecific") else p for p in PARTS)
    string = " || ".join(f"coalesce({p}, 'NA')" for p in PARTS)
    return f"c AS MATERIALIZED (SELECT *, min(pos) OVER (PARTITION BY {string}) AS key_pos FROM (SELECT pos, id, name, {cut} FROM ({parsed(query, 'q')}) p))"


COLLAPSED = f"""
WITH {collapse(QUERY)}, {matched("SELECT * EXCLUDE (key_pos) FROM c WHERE pos = key_pos", parsed(REFERENCE, "r"))}
SELECT c.name AS query, r.name AS reference, match_type FROM c JOIN out ON out.qpos = c.key_pos LEFT JOIN r ON r.id = out.rid"""

MANUAL = f"SELECT a.name AS query, b.name AS match FROM ({QUERY}) a JOIN ({REFERENCE}) b ON a.pos = b.pos WHERE a.name LIKE '%zz %'"
_REPLACED = f"SELECT a.pos, a.name AS query, coalesce(m.match, a.name) AS query_new, m.query IS NOT NULL AS manual FROM ({QUERY}) a LEFT JOIN ({MANUAL}) m ON m.query = a.name"
_NEW = "SELECT query_new AS name, min(pos) AS pos FROM replaced GROUP BY query_new"
MANUALLY = f"""
WITH replaced AS MATERIALIZED ({_REPLACED}), {matched(parsed(_NEW, "q"), parsed(REFERENCE, "r"))}
SELECT replaced.query, r.name AS reference, CASE WHEN manual THEN 'manual' ELSE match_type END AS match_type
FROM replaced JOIN q ON q.name = replaced.query_new JOIN out ON out.qpos = q.pos LEFT JOIN r ON r.id = out.rid"""
MANUALLY_COLLAPSED = f"""
WITH replaced AS MATERIALIZED ({_REPLACED}), {collapse(_NEW)}, {matched("SELECT * EXCLUDE (key_pos) FROM c WHERE pos = key_pos", parsed(REFERENCE, "r"))}
SELECT replaced.query, r.name AS reference, CASE WHEN manual THEN 'manual' ELSE match_type END AS match_type
FROM replaced JOIN c ON c.name = replaced.query_new JOIN out ON out.qpos = c.key_pos LEFT JOIN r ON r.id = out.rid"""

CLASSIFIED = f"""SELECT *, CASE WHEN match_type = 'no_match' THEN 'no_match' WHEN count(*) OVER (PARTITION BY query) = 1 THEN 'single_match' ELSE 'mult_match' END AS result_type FROM ({match()}) m"""


def resolve(where: str = "true", query: str = QUERY, k: float = 4) -> str:
    taxa = TAXONOMY.format(text="VARCHAR")
    names = "SELECT scientificName AS name, min(pos) AS pos FROM taxa GROUP BY 1"
    return f"""
WITH taxa AS MATERIALIZED ({taxa}), {matched(parsed(query, "q"), parsed(names, "r"), k)},
m AS ({SIMPLE}),
j AS MATERIALIZED (SELECT m.*, count(*) OVER (PARTITION BY query) AS n, taxonID, acceptedNameUsageID, taxonomicStatus FROM m LEFT JOIN taxa ON taxa.scientificName IS NOT DISTINCT FROM m.reference),
multi AS (SELECT query, count(*) AS n FROM m GROUP BY query),
a AS (SELECT j.query, reference AS resolved_name, reference AS matched_name, taxonomicStatus AS resolved_status, taxonomicStatus AS matched_status, match_type
  FROM j JOIN multi USING (query) WHERE (acceptedNameUsageID IS NULL OR acceptedNameUsageID = '' OR taxonID = acceptedNameUsageID) AND multi.n = 1 AND match_type <> 'no_match'),
s AS (SELECT j.query, taxa.scientificName AS resolved_name, reference AS matched_name, taxa.taxonomicStatus AS resolved_status, j.taxonomicStatus AS matched_status, match_type
  FROM j LEFT JOIN taxa ON taxa.taxonID = j.acceptedNameUsageID WHERE j.acceptedNameUsageID <> '' AND j.acceptedNameUsageID <> j.taxonID),
one AS (SELECT query FROM s GROUP BY query HAVING count(DISTINCT resolved_name) + CASE WHEN count(*) > count(resolved_name) THEN 1 ELSE 0 END = 1),
good AS (SELECT * FROM a UNION ALL SELECT * FROM s WHERE query IN (SELECT query FROM one)),
every AS (SELECT * FROM good UNION ALL SELECT query, NULL, reference, NULL, taxonomicStatus, match_type FROM j WHERE query NOT IN (SELECT query FROM good))
SELECT * FROM every WHERE {where}"""
