"""Every training-text query that SQL can express, against DuckDB on the small tables."""

import duckdb
import pytest

from panelforge.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall(), key=str)
