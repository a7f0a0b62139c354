"""The subpackage's queries beside their SQL, on the smallest tables; they are skipped where there are no such tables."""

import glob
import os

import duckdb
import pytest

from cifra.llm import queries

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = queries.queries()[name](spark, TABLES)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str) and rows
