"""Upper-case names, letters that have no capital included, against DuckDB's."""

import duckdb
import pandas as pd

from lexiphyte.queries import ORACLE_SQL, QUERIES


def test_capitals_are_single_letters(spark, tmp_path):
    # Parts whose queries are in capitals, with a ligature or any accented letter.
    keys = [k for k in range(1, 400_000) if k % 17 == 10 and (k % 41 == 0 or k % 19 in (17, 18))][:2_000]
    part = pd.DataFrame({"p_partkey": keys, "p_name": "red ring", "p_type": "STANDARD"})
    part.to_parquet(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    theirs = {x for (x,) in con.execute(ORACLE_SQL["parse_rejects"]).fetchall()}
    assert any("ﬂ" in x for x in theirs)
    assert any("ẞ" in x for x in theirs)
    assert {r["name"] for r in QUERIES["parse_rejects"](spark, str(tmp_path)).collect()} == theirs
