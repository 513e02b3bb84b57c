"""What resolving does with many rows."""

from lexiphyte import resolve_names


def test_matches_meet_the_taxonomy_once_and_nothing_is_broadcast(spark):
    # Spark takes a table for as small as the file that it comes from.
    taxa = spark.range(2_000).selectExpr("cast(id AS string) AS taxonID", "cast(id div 2 * 2 AS string) AS acceptedNameUsageID", "'accepted name' AS taxonomicStatus", "concat('Foo b', id) AS scientificName")
    matches = spark.range(2_000).selectExpr("concat('q', id div 2) AS query", "concat('Foo b', id + 1) AS reference", "'auto_fuzzy' AS match_type")
    found = resolve_names(spark, matches, taxa)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("auto_fuzzy") == 1  # the matches are made once
    # Query k has the references 2k+1, a synonym of 2k, and 2k+2, accepted: the synonym decides.
    assert found.where("query = 'q7'").select("resolved_name", "matched_name").collect() == [("Foo b14", "Foo b15")]


def test_unmatched_rows_and_taxa_of_one_id(spark):
    taxa = spark.createDataFrame([("1", "2", "synonym", "Aa aa"), ("2", None, "ok", "Bb bb"), ("2", None, "ok", "Cc cc"), ("3", "9", "synonym", "Dd dd"), ("3", "8", "synonym", "Dd dd"), ("4", None, "x", None), ("5", None, "y", None)], "taxonID string, acceptedNameUsageID string, taxonomicStatus string, scientificName string")
    matches = spark.createDataFrame([("a", "Aa aa", "exact"), ("b", "Ee ee", "exact"), ("c", None, "no_match"), ("d", "Dd dd", "exact"), (None, "Aa aa", "exact")], "query string, reference string, match_type string")
    got = {}
    for r in resolve_names(spark, matches, taxa).collect():
        got.setdefault(r["query"], []).append((r["resolved_name"], r["matched_name"], r["resolved_status"], r["matched_status"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        "a": [(None, "Aa aa", None, "synonym")],  # two names bear the id; the match is one row all the same
        "b": [("Ee ee", "Ee ee", None, None)],
        "c": [(None, None, None, "x"), (None, None, None, "y")],
        "d": [(None, "Dd dd", None, "synonym")] * 2,
        None: [(None, "Aa aa", None, "synonym")],
    }
