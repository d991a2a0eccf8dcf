import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.operators import monitor


def test_profile_counts_nulls_zeros_and_nans(spark):
    data = [(0.0,), (1.0,), (3.0,), (None,), (float("nan"),)]
    row = monitor.profile(spark.createDataFrame(data, "x double")).first()
    assert (row["rows"], row["nulls"], row["zeros"], row["nans"], row["n_distinct"]) == (5, 1, 1, 1, 3)
    assert (row["min"], row["max"], row["q50"]) == (0.0, 3.0, 1.0)
    approx = monitor.profile(spark.createDataFrame(data, "x double"), quantiles="approx").first()
    assert (approx["nulls"], approx["n_distinct"], approx["q50"]) == (1, 3, 1.0)


def test_profile_of_an_empty_column(spark):
    row = monitor.profile(spark.createDataFrame([(None,)], "x double")).first()
    assert row["n_distinct"] == 0 and row["q50"] is None and row["mean"] is None


def test_profile_keeps_rows_without_a_model_name(spark):
    data = [("2024-01-01 05:00:00", 1.0, None), ("2024-01-01 06:00:00", 1.0, None), ("2024-01-02 06:00:00", 2.0, "m")]
    log = spark.createDataFrame(data, "t string, p double, m string").withColumn("t", F.to_timestamp("t"))
    classes = monitor.profile_log(log, "t", "p", "m")
    assert rows(classes.select("m", "p", "n", "share")) == [("m", 2.0, 1, 1.0), (None, 1.0, 2, 1.0)]
    numeric = monitor.profile_log(log, "t", "p", "m", "regression")
    assert rows(numeric.select("m", "rows", "q50")) == [("m", 1, 2.0), (None, 2, 1.0)]
    with pytest.raises(ValueError):
        monitor.profile_log(log, "t", "p", "m", "ranking")


def test_kind_by_table_name():
    assert monitor.monitor_kind("inference_results") == "inference_log"
    assert monitor.monitor_kind("x_features") == monitor.monitor_kind("anything") == "snapshot"


def test_same_data_has_no_drift(spark):
    df = spark.range(200).select((F.col("id") % 50).cast("double").alias("x"))
    row = monitor.numeric_drift(df, df, ["x"]).first()
    assert [round(row[m], 12) for m in ("ks", "wasserstein", "psi", "js")] == [0, 0, 0, 0]


def test_shift_has_known_distances(spark):
    base = spark.createDataFrame([(0.0,), (1.0,)], "x double")
    row = monitor.numeric_drift(base, base.select((F.col("x") + 10).alias("x")), ["x"]).first()
    assert row["ks"] == 1.0 and row["wasserstein"] == pytest.approx(10.0)


def test_binned_drift_equals_the_exact_path_on_the_same_edges(spark):
    base = spark.range(300).select((F.col("id") % 97).cast("double").alias("x"))
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    cur = base.select((F.col("x") * 0.8 + 3).alias("x")).unionByName(odd)
    edges = {"x": [10.0, 20.0, 50.0]}
    one = monitor.binned_drift(base, cur, edges).first()
    other = monitor.numeric_drift(base, cur, ["x"], edges=edges).first()
    assert one["psi"] == pytest.approx(other["psi"]) and one["js"] == pytest.approx(other["js"])
    assert len(monitor.approx_edges(base.unionByName(odd), ["x"], 4)["x"]) == 3


def test_disjoint_categories(spark):
    base = spark.createDataFrame([("a",), ("b",)], "c string")
    cur = spark.createDataFrame([("z",), (None,)], "c string")
    row = monitor.categorical_drift(base, cur, ["c"]).first()
    assert row["unseen"] == 2 and row["total_variation"] == 1.0 and row["js"] == 1.0
    assert row["df"] == 1 and row["chi_square"] == 2.0 and math.isfinite(row["psi"])


def test_consecutive_windows_skip_gaps(spark):
    data = [(1, "a"), (1, "b"), (4, "a"), (4, "a"), (5, "a")]
    out = monitor.consecutive_drift(spark.createDataFrame(data, "w int, c string"), "w", "c")
    assert rows(out.select("w", "total_variation")) == [(4, 0.5), (5, 0.0)]
