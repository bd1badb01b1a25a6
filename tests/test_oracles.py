"""Every query against its SQL, value by value, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SF

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert {d[0]: TYPES[str(d[1])] for d in cursor.description} == dict(df.dtypes)
    at = [names.index(c) for c in columns]
    want = ordered(tuple(r[i] for i in at) for r in cursor.fetchall())
    assert got == want
    assert got


def test_every_query_has_sql_or_is_known_not_to():
    from synthmill.plans.catalog import ORACLES, QUERIES
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    assert df.count() == 150
