"""Every catalogue query against its SQL on a second engine."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from conftest import DATA

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, other, name):
    found = QUERIES[name](spark, DATA)
    wanted = other.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert canonical(found.columns, found.collect()) == canonical(names, wanted.fetchall())


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*SQL} - {"elbow_curve"}))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    out = entry_points.entry(spark)
    assert out.columns == ["feature_3", "rows", "ratios", "mean_feature_1", "mean_feature_2"]
    assert out.count() == 2
