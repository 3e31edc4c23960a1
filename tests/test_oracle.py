"""Every registered query with oracle SQL equals DuckDB on the same tables
(row count, column names, order-insensitive values)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools_compare import TABLES, canon

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_oracle_key_is_registered():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, sf, con, key):
    s = QUERIES[key](spark, sf).toPandas()
    d = con.execute(ORACLE[key]).df()
    cs, rs = canon(s)
    cd, rd = canon(d)
    assert cs == cd
    assert len(rs) == len(rd)
    assert rs == rd


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "accident_count" in df.columns
