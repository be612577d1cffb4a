"""Every registered query against its SQL counterpart on the same tables."""

import math
import os

import duckdb
import pytest

from catalog.oracles import oracle_sql
from catalog.queries import queries
from catalog.views import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = queries(), oracle_sql()

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    kinds = dict(zip(names, (str(d[1]) for d in result.description)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == kinds
    theirs = canonical(result.fetchall(), names)
    ours = canonical([tuple(r) for r in df.collect()], df.columns)
    assert len(ours) > 0
    assert ours == theirs
