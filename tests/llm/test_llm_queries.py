"""Each query with SQL against a second engine, and the columns of the others."""

from pathlib import Path

import duckdb
import pytest
from conftest import DATA
from tablemill.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([row[i] for i in order]) for row in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, other, name):
    found = QUERIES[name](spark, DATA)
    wanted = other.execute(SQL[name])
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == canonical([d[0] for d in wanted.description], wanted.fetchall())
