import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.operators.ordered import (
    exact_quantiles,
    quantiles_of_cumulated,
    row_numbers,
    running_totals,
    value_counts,
)


@pytest.fixture
def apart(spark):
    """Keep range partitions apart, so that totals must be carried between them."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


def test_running_totals_over_everything(spark, apart):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v, v % 7) for v in values], "o int, n bigint").repartition(5)
    out = running_totals(df, ["o"], ["n"], next_of="o")
    total, wanted = 0, []
    for v in range(500):
        total += v % 7
        wanted.append((v, v % 7, total, v + 1 if v < 499 else None))
    assert rows(out) == sorted(wanted, key=repr)


def test_running_totals_per_key_with_a_large_and_a_null_key(spark, apart):
    draw = random.Random(2)
    data = [(draw.choice([None, "a", "a", "a", "a", "b", "c"]), i, draw.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(data, "k string, o int, n bigint").repartition(4)
    out = running_totals(df, ["o"], ["n"], ["k"])
    wanted, seen = [], {}
    for k, o, n in sorted(data, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + n
        wanted.append((k, o, n, seen[k]))
    assert rows(out) == sorted(wanted, key=repr)


def test_row_numbers(spark, apart):
    df = spark.range(300).select(F.hash("id").alias("h"))
    found = [r["rn"] for r in row_numbers(df, ["h"]).orderBy("h").collect()]
    assert found == list(range(1, 301))


def test_exact_quantiles(spark, apart):
    draw = random.Random(3)
    values = [draw.choice([1.5, 2.0, draw.random() * 10]) for _ in range(401)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    counts = value_counts(df, ["x"])
    asked = {"q25": 0.25, "q90": 0.9}
    row = exact_quantiles(counts, asked, ["column"]).first()
    cumulated = running_totals(counts, ["value"], ["n"], ["column"])
    assert quantiles_of_cumulated(cumulated, asked, ["column"], "n").first() == row
    ordered = statistics.quantiles(values, n=20, method="inclusive")
    assert row["n"] == 401 and row["n_distinct"] == len(set(values))
    assert row["q25"] == pytest.approx(ordered[4]) and row["q90"] == pytest.approx(ordered[17])
