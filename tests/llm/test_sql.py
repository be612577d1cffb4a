"""The queries that SQL can express, against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from tablegauge.llm.oracles import oracle_sql
from tablegauge.llm.queries import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries()[name](spark, SF_DIR)
    result = con.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    kinds = dict(zip(names, (str(d[1]) for d in result.description)))
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema} == kinds
    ours, theirs = canonical([tuple(r) for r in df.collect()], df.columns), canonical(result.fetchall(), names)
    assert len(ours) > 0
    assert ours == theirs
