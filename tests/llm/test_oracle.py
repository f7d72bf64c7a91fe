"""Operators that SQL can express against DuckDB on the smallest tables."""

import duckdb
import pytest

from loomstone.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    res = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    want = sorted(map(tuple, res.fetchall()))
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want
