"""Parsing, matching and resolving against worked examples."""

import warnings

import pytest

from lexiphyte import classify, match_names, parse_names, read_parsed, read_taxonomy, rejected_names, resolve_names, write_parsed
from lexiphyte.functions.ids import list_hash
from lexiphyte.operators.match import FULL
from lexiphyte.sources.pipe_text import as_lines

BAD = "Vanden kalamocarpa x Vanden nipponica x Vanden striata"


def matched(spark, query, reference, **options):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return sorted((tuple(r) for r in match_names(spark, query, reference, simple=True, **options).collect()), key=str)


def types(spark, query, reference, **options):
    return [r[2] for r in matched(spark, [query], [reference], **options)]


def test_list_hashes():
    assert list_hash(["Foogenus x barspecies var. foosubsp (L.) F. Bar"]) == "5f207ff2"
    assert list_hash(["Crepidomanes minutus"]) == "c1ad73ec"


def test_parse(spark):
    given = {
        "Foogenus x barspecies var. foosubsp (L.) F. Bar": (None, "Foogenus", "×", "barspecies", "var.", "foosubsp", "(L.) F. Bar"),
        "Crepidomanes minutum (Bl.) K. Iwats.": (None, "Crepidomanes", None, "minutum", None, None, "(Bl.) K. Iwats."),
        "Foo bar V. D. Bosch": (None, "Foo", None, "bar", None, None, "V. D. Bosch"),
        "Foo bar auct.": (None, "Foo", None, "bar", None, None, "auct."),
        "Foo bar d'Urv.": (None, "Foo", None, "bar", None, None, "d'Urv."),
        "x Foo bar": ("×", "Foo", None, "bar", None, None, None),
        "Foo bar ssp. baz L.": (None, "Foo", None, "bar", "subsp.", "baz", "L."),
        "Foo  bar   L. ": (None, "Foo", None, "bar", None, None, "L."),
        "Foo bar [infrasp.unranked] baz": (None, "Foo", None, "bar", "[infrasp.unranked]", "baz", None),
        "Foo bar nothosubsp. baz": (None, "Foo", None, "bar", None, "nothosubsp", ". baz"),
        "Foo bar agg.": (None, "Foo", None, "bar", None, "agg", "."),
    }
    bad = [BAD, "Foogenus", "Foo b", "foo bar", "Foo bar L. 5%", "Foo bar v. d. Bosch", "|Foo||bar|||L."]
    with pytest.warns(UserWarning, match="could not be parsed"):
        got = {r["name"]: tuple(r)[2:] for r in parse_names(spark, [*given, *bad]).collect()}
    assert got == given
    assert {r["name"] for r in rejected_names(spark, [*given, *bad]).collect()} == set(bad)


def test_parse_errors(spark):
    with pytest.raises(ValueError, match="must be unique"):
        parse_names(spark, ["Foo bar", "Foo bar"])
    with pytest.raises(ValueError, match="may not be null"):
        parse_names(spark, ["Foo bar", None])
    with pytest.raises(ValueError, match="None of the names can be parsed"):
        parse_names(spark, [BAD])


def test_text_round_trip(spark, tmp_path):
    parsed = parse_names(spark, ["Foo bar", "Foogenus x barspecies var. foosubsp (L.) F. Bar"])
    one = parse_names(spark, ["Foogenus x barspecies var. foosubsp (L.) F. Bar"])
    assert as_lines(one).first()[0] == "|".join(["5f207ff2-1", "", *"Foogenus × barspecies var. foosubsp".split(), "(L.) F. Bar"])
    again = read_parsed(spark, write_parsed(parsed, str(tmp_path / "names")))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, parsed.drop("name").collect()), key=str)
    with pytest.raises(TypeError, match="df must be of class"):
        as_lines([1])
    with pytest.raises(ValueError, match="must include the following columns"):
        as_lines(parsed.drop("author"))


def test_taxonomy_source(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("taxonID\tscientificName\n1\tFoo bar v. d. Bosch\n")
    assert read_taxonomy(spark, str(tmp_path / "t.tsv")).first()["scientificName"] == "Foo bar V. D. Bosch"


def test_full_match(spark):
    row = match_names(spark, ["Crepidomanes minutus"], ["Crepidomanes minutum"]).first()
    assert tuple(row.asDict()) == FULL
    assert (row["match_type"], row["id_query"], row["id_ref"], row["author_ref"]) == ("auto_fuzzy", "c1ad73ec-1", "19b861c8-1", None)


RULES = {
    "Foo bar (L.)Smith": "auto_punct", "Foo bar": "auto_noauth", "Foo bar Smith": "auto_basio-", "Foo bar (X.) Smith": "auto_basexin", "Foo baz A ex B": "auto_in-", "Foo bar subsp. bar (L.) Smith": "no_match",
    "Foo qux D": "auto_in-", "Foo baz A": "auto_exin-", "Foo bar (L.) Smith ex Y": "auto_exin+", "Foo baz A ex Z": "auto_basexin", "Foo bar auct.": "auto_cfonly", "Foo qux D in F": "auto_basexin",
}


def test_rules(spark):
    got = {q: t for q, _, t in matched(spark, list(RULES), ["Foo bar (L.) Smith", "Foo baz A ex B in C", "Foo qux D in E"], max_dist=3, match_no_auth=True, match_canon=True)}
    assert got == RULES
    assert types(spark, "Foo bar (L.) Smith", "Foo bar Smith", max_dist=3) == ["auto_basio+"]
    assert types(spark, "Foo bar var. baz L.", "Foo bar subsp. baz L.", max_dist=3) == ["auto_irank"]


@pytest.mark.parametrize(("q", "t", "k", "result"), [("Foo bar", "Foo bar Abc", 3, "no_match"), ("Foo bar", "Foo bar Abc", 4, "auto_fuzzy"), ("Foo bar Abc", "Foo bar", 3, "auto_fuzzy"), ("Foo bar", "Foo bax", 1, "auto_fuzzy"), ("Foo bar", "Foo bax", 0.5, "no_match"), ("Foo bar", "Foo bax", 0, "no_match")])
def test_boundary(spark, q, t, k, result):
    assert types(spark, q, t, max_dist=k) == [result]


def test_own_list_is_not_matched_to_itself(spark):
    assert matched(spark, ["Foo bar", "Foo bax"], ["Foo bar", "Foo bax"], max_dist=1) == [("Foo bar", "Foo bax", "auto_fuzzy"), ("Foo bax", "Foo bar", "auto_fuzzy")]


def test_last_reference_wins_and_all_fuzzy_hits_stay(spark):
    assert matched(spark, ["Foo bar (L.)Smith"], ["Foo bar (L.) Smith", "Foo bar (L.)  Smith"]) == [("Foo bar (L.)Smith", "Foo bar (L.)  Smith", "auto_punct")]
    assert len(matched(spark, ["Hymenophyllum wilsonii"], ["Hymenophyllum wilsonii Fée", "Hymenophyllum wilsonii Hook."])) == 2


def test_manual_and_collapse(spark):
    manual = spark.createDataFrame([("Bar foo var. foo", "Bar foo"), ("Davallia tenuiblah", "Davallia tenuis")], "query string, match string")
    queries = ["Bar foo", "Davallia tenuix", "Osmunda alta", "Osmunda alta var. alta", "Davallia tenuiblah", "Bar foo var. foo"]
    reference = ["Osmunda alta", "Davallia tenuis", "Bar foo", "Todea barbara"]
    got = {q: t for q, _, t in matched(spark, queries, reference, collapse_infra=True, manual_match=manual)}
    assert got == dict(zip(queries, ["exact", "auto_fuzzy", "exact", "exact", "manual", "manual"], strict=True))
    assert matched(spark, ["Bar foo var. foo"], ["Bar foo"], collapse_infra=True, collapse_infra_exclude=["Bar foo var. foo"]) == [("Bar foo var. foo", "Bar foo", "auto_fuzzy")]
    rescued = spark.createDataFrame([(BAD, "Bar foo")], "query string, match string")
    assert matched(spark, [BAD], ["Bar foo", "Bar fop"], manual_match=rescued) == [(BAD, "Bar foo", "manual")]
    # Replaced queries that are the reference list itself have its ids, and no name is matched to itself.
    assert matched(spark, [BAD], ["Bar foo"], manual_match=rescued) == [(BAD, None, "manual")]
    assert match_names(spark, ["Bar fop"], ["Bar foo"], manual_match=rescued.limit(0)).columns[:2] == ["query", "query_new"]


def test_match_errors(spark):
    table = lambda rows: spark.createDataFrame(rows, "query string, match string")
    with pytest.raises(TypeError, match="query must be of class"):
        match_names(spark, 1, ["Foo bar"])
    with pytest.raises(TypeError, match="reference must be of class"):
        match_names(spark, ["Foo bar"], 1)
    with pytest.raises(ValueError, match="references that are not there"):
        match_names(spark, ["Foo bar"], ["Foo baz"], manual_match=table([("Foo bar", "Foo qux")]))
    with pytest.raises(ValueError, match="must be unique"):
        match_names(spark, ["Foo bar"], ["Foo baz"], manual_match=table([("Foo bar", "Foo baz"), ("Foo bar", "Foo baz")]))
    with pytest.raises(ValueError, match="must have `query` and `match` columns"):
        match_names(spark, ["Foo bar"], ["Foo baz"], manual_match=table([]).withColumnRenamed("match", "m"))
    with pytest.raises(TypeError, match="only be used if query is given as names"):
        match_names(spark, parse_names(spark, ["Foo bar"]), ["Foo baz"], manual_match=table([("Foo bar", "Foo baz")]))


TAXA = [
    ("1", None, "accepted name", "Aa aa"), ("2", "", "accepted name", "Bb bb"), ("3", "3", "accepted name", "Cc cc"), ("4", "1", "synonym", "Dd dd"), ("5", "99", "synonym", "Ee ee"),
    ("6", "1", "synonym", "Ff ff L."), ("7", "2", "synonym", "Ff ff K."), ("8", "1", "synonym", "Gg gg L."), ("9", "1", "synonym", "Gg gg K."), ("10", None, "accepted name", "Hh hh L."), ("11", "2", "synonym", "Hh hh K."), ("12", None, "accepted name", None),
]


def test_resolve(spark):
    taxa = spark.createDataFrame(TAXA, "taxonID string, acceptedNameUsageID string, taxonomicStatus string, scientificName string")
    queries = ["Aa aa", "Bb bb", "Cc cc", "Dd dd", "Ee ee", "Ff ff", "Gg gg", "Hh hh", "Zz zz"]
    got = {}
    for r in resolve_names(spark, queries, taxa).collect():
        got.setdefault(r["query"], set()).add((r["resolved_name"], r["matched_name"], r["resolved_status"], r["matched_status"]))
    ok = "accepted name"
    assert got == {
        "Aa aa": {("Aa aa", "Aa aa", ok, ok)}, "Bb bb": {("Bb bb", "Bb bb", ok, ok)}, "Cc cc": {("Cc cc", "Cc cc", ok, ok)},
        "Dd dd": {("Aa aa", "Dd dd", ok, "synonym")},
        "Ee ee": {(None, "Ee ee", None, "synonym")},  # a dangling step
        "Ff ff": {(None, "Ff ff L.", None, "synonym"), (None, "Ff ff K.", None, "synonym")},  # two targets
        "Gg gg": {("Aa aa", "Gg gg L.", ok, "synonym"), ("Aa aa", "Gg gg K.", ok, "synonym")},
        "Hh hh": {("Bb bb", "Hh hh K.", ok, "synonym")},  # the accepted row of several matches is left out
        "Zz zz": {(None, None, None, ok)},  # no match meets the row without a name
    }
    numeric = taxa.where("scientificName IN ('Aa aa', 'Dd dd')").selectExpr("CAST(taxonID AS INT) AS taxonID", "CAST(nullif(acceptedNameUsageID, '') AS INT) AS acceptedNameUsageID", "taxonomicStatus", "scientificName", "1 AS extra")
    table = match_names(spark, ["Dd dd"], ["Aa aa", "Dd dd"])
    assert [r["resolved_name"] for r in resolve_names(spark, table, numeric).collect()] == ["Aa aa"]
    with pytest.raises(TypeError, match="query must be of class"):
        resolve_names(spark, 1, taxa)
    with pytest.raises(TypeError, match="ref_taxonomy must be of class"):
        resolve_names(spark, ["Aa aa"], 1)


def test_classify(spark):
    rows = spark.createDataFrame([("a", "x", "exact"), ("b", "x", "auto_fuzzy"), ("b", "y", "auto_fuzzy"), ("c", None, "no_match")], "query string, reference string, match_type string")
    assert {(r["query"], r["result_type"]) for r in classify(rows).collect()} == {("a", "single_match"), ("b", "mult_match"), ("c", "no_match")}
    with pytest.raises(TypeError):
        classify([1])


def test_stream(spark, tmp_path):
    from lexiphyte.streaming.match_stream import match_stream, parse_stream

    rows = spark.createDataFrame([("s-1", "Foo bar"), ("s-2", BAD)], "id string, name string")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert parse_stream(source).isStreaming
    ran = match_stream(spark, source, parse_names(spark, ["Foo bar L."]), str(tmp_path / "out"), max_dist=2, simple=True).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    ran.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("query", "reference", "match_type").collect()] == [("Foo bar", "Foo bar L.", "auto_fuzzy")]
