"""The queries that SQL can express, against DuckDB: columns, types, values."""

import pytest
from conftest import TESTDATA, open_duckdb

from tiffinlake.llm import oracles, queries

FOLDER = f"{TESTDATA}/sf0.01"
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER"}


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_oracle(spark, name):
    result = queries.QUERIES[name](spark, FOLDER)
    expected = open_duckdb(FOLDER).sql(oracles.SQL[name])
    assert {c: TYPES[t] for c, t in result.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    columns = sorted(result.columns)
    got = sorted(repr(tuple(row[c] for c in columns)) for row in result.collect())
    order = [expected.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in order)) for row in expected.fetchall())


def test_a_query_for_each_operator():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
