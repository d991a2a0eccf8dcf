import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.operators.features import (
    Scaler,
    check_signature,
    engineer_features,
    fill_zero,
    numeric_features,
    signature,
    split_train_test,
    standardize,
    with_split,
    without,
)

RAW = "id string, value_1 double, value_2 double, value_3 double, category string, event_timestamp timestamp"


def test_ratio_log_indicator(spark):
    data = [("a", 10.0, 0.0, -1.0, "A"), ("b", 1.0, 2.0, -2.0, None), ("c", None, 2.0, 5.0, "B")]
    raw = spark.createDataFrame(data, RAW.rsplit(",", 1)[0])
    out = engineer_features(raw, F.lit("2024-01-01").cast("timestamp"))
    found = {r["id"]: r for r in out.collect()}
    assert [found[k]["feature_1"] for k in "abc"] == [None, 0.5, None]
    assert found["a"]["feature_2"] is None and found["b"]["feature_2"] is None
    assert math.isclose(found["c"]["feature_2"], 1.791759, abs_tol=1e-6)
    assert [found[k]["feature_3"] for k in "abc"] == [1, 0, 0]
    assert out.columns == ["id", "feature_1", "feature_2", "feature_3", "feature_updated_timestamp"]


def test_zero_variance_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    found = rows(standardize(df, ["a", "b"]).select(F.round("a", 6), "b"))
    assert found == [(-1.224745, 0.0), (0.0, 0.0), (1.224745, 0.0)]


def test_saved_scaler_is_applied_unchanged(spark):
    scaler = Scaler({"a": 2.0}, {"a": 4.0})
    df = spark.createDataFrame([(6.0,), (None,)], "a double")
    assert rows(scaler.transform(df)) == [(1.0,), (None,)]


def test_numeric_features_are_one_list(spark):
    ddl = (
        "id int, t tinyint, s smallint, i int, b bigint, f float, d double, m decimal(9,2), "
        "o boolean, c string, event_timestamp timestamp"
    )
    df = spark.createDataFrame([], ddl)
    assert numeric_features(df) == ["i", "b", "f", "d"]
    kept = signature(df, ["i", "d"])
    assert kept == [("i", "int"), ("d", "double")]
    check_signature(df, kept)
    with pytest.raises(ValueError):
        check_signature(df.withColumn("i", F.col("i").cast("bigint")), kept)


def test_fill_zero_takes_null_and_nan(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), None)], "x double, n int")
    assert rows(fill_zero(df, ["x", "n"])) == [(0.0, 0), (0.0, 1)]


def test_exclude_unknown_column_fails(spark):
    with pytest.raises(ValueError):
        without(spark.range(1), ["missing"])


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_split_does_not_depend_on_partitioning(spark, kind):
    ids = spark.range(5000).select(F.col("id").cast(kind).alias("id"))
    one = rows(with_split(ids.repartition(7), "id"))
    assert one == rows(with_split(ids.coalesce(1), "id"))
    train, test = split_train_test(ids, "id")
    assert train.count() + test.count() == 5000
    assert 800 < test.count() < 1200


def test_split_of_large_and_negative_ids(spark):
    ids = spark.createDataFrame([(2**62,), (-5,), (4294967296 * 3 + 17,), (17,)], "id bigint")
    wanted = [(i, (i % 2**32 * 2654435761) % 2**32 < int(0.2 * 2**32)) for (i,) in ids.collect()]
    assert rows(with_split(ids, "id")) == sorted(wanted, key=repr)
