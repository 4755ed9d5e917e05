"""Every query with a stated result gives that result, row by row, on whole tables."""

import math
import os

import duckdb
import pytest

from rateframe.oracle.statements import STATEMENTS
from rateframe.plans.catalog import QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for file in sorted(os.listdir(data)):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{data}/{file}'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value + 0.0) if isinstance(value, float) else repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query_matches_sql(spark, data, duck, name):
    result = QUERIES[name](spark, data)
    expected = duck.sql(STATEMENTS[name])
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: KINDS[t] for c, t in result.dtypes} == kinds
    got = table(result.columns, [tuple(r) for r in result.collect()])
    assert got == table(expected.columns, expected.fetchall())
