"""Keys are put together from parts that are stripped once."""

from pyspark.sql import functions as F

from lexiphyte.functions.keys import PARTS, bare_columns, with_keys
from lexiphyte.functions.text import depunct

AUTHORS = ["", "(L.) Smith", "(Bl.) K. Iwats. ex Fée in Flora", "Smith  and  Jones", "Æbrad et al.  In Bull", "ex Young", "(L.)", "A in B\nC", "auct.", "( and  ) X", "Ärn. in  in ex  Y"]


def test_keys_are_those_of_the_whole(spark):
    rows = [("×" if k % 2 else None, "Foo-bë", None, "bar", "var." if k % 3 else None, "b_z", a) for k, a in enumerate(AUTHORS)]
    keyed = with_keys(spark.createDataFrame(rows, ", ".join(f"{p} string" for p in PARTS)))
    assert not set(bare_columns()) & set(keyed.columns)
    stem = F.concat(*PARTS[:6])
    cut = lambda pattern: F.regexp_replace("author", pattern, "")
    whole = {"punct": F.concat(stem, "author"), "noauth": stem, "basio": F.concat(stem, cut(r"^\([^)]+\)")), "in": F.concat(stem, cut(" [iI]n .*$")), "exin": F.concat(stem, cut(" (?:[eE]x|[iI]n) .*$"))}
    for kind, text in whole.items():
        assert keyed.where(F.col(f"k_{kind}") != depunct(text)).count() == 0, kind
