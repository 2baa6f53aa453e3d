import os

import duckdb
import pytest

from tidelane.plans.oracle import ORACLE_SQL
from tidelane.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    columns = sorted(names)
    assert sorted(df.columns) == columns
    rows = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, rows))
