"""Every query of the subpackage runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import glob
import os

import duckdb
import pytest

from simloom.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        con = duckdb.connect()
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        cur = con.execute(SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(got) == sorted(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
