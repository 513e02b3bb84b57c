"""Manual matches to reference names that can't be parsed."""

import pytest
from test_names import BAD, matched


def test_manual_match_to_an_unparsed_reference(spark):
    manual = spark.createDataFrame([("Foo baz", BAD), ("Foo qux", "Foo bar")], "query string, match string")
    queries, reference = ["Foo baz", "Foo qux", "Todea barbara"], ["Foo bar", BAD, "Todea barbara"]
    want = [("Foo qux", "Foo bar", "manual"), ("Todea barbara", "Todea barbara", "exact")]
    assert matched(spark, queries, reference, manual_match=manual) == want
    assert matched(spark, queries, reference, manual_match=manual, collapse_infra=True) == want
    with pytest.raises(ValueError, match="references that are not there"):
        matched(spark, queries, ["Foo bar", "Todea barbara"], manual_match=manual)
