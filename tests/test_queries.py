"""Every registered query of the library against its oracle in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from panelforge.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAME_KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return repr(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {c[0]: str(c[1]).replace("STRING", "VARCHAR") for c in got.description}
    assert {c: SAME_KIND[k] for c, k in df.dtypes if k in SAME_KIND} == {c: kinds[c] for c, k in df.dtypes if k in SAME_KIND}
    assert table(df.columns, df.collect()) == table(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER).count()
    assert rows > 0 or name == "q306_window_features"  # no complete day at this size; tests/test_sources.py has its features


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["q103_one_to_one_left_join", "q109_containment_join", "q110_interval_overlap", "q113_as_of_join", "q119_nearest_join", "q187_calendar_zscore"])
def test_no_cross_join(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan

def test_import_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 0, len(e.oracle_sql()) > 0)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True True", done.stderr
