import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import rows
from tablemill.operators import quality
from tablemill.streaming.ingest import INGEST_RULES

DDL = "id string, event_timestamp string, v string"


@pytest.fixture
def copies(spark):
    return spark.createDataFrame([("1", None, "a"), ("1", "t", "b"), (None, "t", "c")], DDL)


def test_order_of_dedup_and_validation(copies):
    order = ["v"]
    assert rows(quality.clean(copies, ["id"], INGEST_RULES, "dedup_first", order)) == []
    kept = quality.clean(copies, ["id"], INGEST_RULES, "validate_first", order)
    assert rows(kept) == [("1", "t", "b")]
    with pytest.raises(ValueError):
        quality.clean(copies, ["id"], INGEST_RULES, "other")


def test_null_predicate_is_a_violation(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert rows(quality.expect_or_drop(df, {"positive": "x > 0"})) == [(1,)]
    assert rows(quality.expectation_report(df, {"positive": "x > 0"})) == [("positive", 1, 2)]


def test_counters_come_with_the_same_pass(copies):
    seen = Observation("quality")
    quality.expect_or_drop(copies, INGEST_RULES, seen).collect()
    assert seen.get == {"rows": 3, "failed_valid_id": 1, "failed_valid_timestamp": 1}


def test_dedup_is_independent_of_partitioning(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    assert rows(quality.dedup_by_key(df.repartition(9), ["k"])) == rows(
        quality.dedup_by_key(df.coalesce(1), ["k"])
    )


def test_dedup_limits_copies_before_the_shuffle(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    plan = quality.dedup_by_key(df.withColumn("k", F.col("v") % 3), ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2


def test_duplicate_and_null_keys_are_found(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert rows(quality.duplicate_keys(df, ["k"])) == [(1, 2), (None, 1)]
    with pytest.raises(ValueError):
        quality.require_unique(df, ["k"])
    quality.require_unique(spark.range(3), ["id"])


def test_scored_output_is_checked(spark):
    source = spark.range(3)
    stamped = source.withColumn("inference_timestamp", F.current_timestamp())
    quality.check_scored(source, stamped)
    with pytest.raises(ValueError):
        quality.check_scored(source, stamped.limit(2))
    with pytest.raises(ValueError):
        quality.check_scored(source, source.withColumn("inference_timestamp", F.lit(None)))


def test_schema_rows(spark):
    assert rows(quality.schema_rows(spark.range(1))) == [(0, "id", "bigint", False)]
