"""Every registered query of the evidence store against its SQL oracle, on the smallest tables."""

import math

import duckdb
import pytest

from loomstone.plans import ORACLE, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want


# The beliefs of the test tables are one component, too large for a drawing; draw_selection is tested on fixtures.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"draw_selection"}))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
