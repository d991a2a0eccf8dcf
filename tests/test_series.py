import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.models import series
from tablemill.plans.catalog import day_text

DAY = dt.date(2023, 1, 1)


def daily(spark, days, value, name="s"):
    data = [(name, DAY + dt.timedelta(days=i), value(i)) for i in range(days)]
    return spark.createDataFrame(data, "series string, ds date, y double")


def test_daily_index_ends_on_the_given_day(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "o int")
    out = series.daily_index(df, ["o"], dt.date(2024, 3, 1))
    assert rows(out) == [(1, dt.date(2024, 2, 28)), (2, dt.date(2024, 2, 29)), (3, dt.date(2024, 3, 1))]


def test_daily_index_goes_back_before_the_year_1(spark):
    df = spark.range(0, 800_000, 1, 4).selectExpr("id as o", "'a' as k")
    for keys in ([], ["k"]):
        out = series.daily_index(df, ["o"], dt.date(2024, 12, 31), keys).withColumn("day", day_text("ds"))
        found = {r["o"]: r["day"] for r in out.filter("o in (0, 60748, 60749, 60750, 799999)").drop("ds").collect()}
        sql = "select strftime(DATE '2024-12-31' - (799999 - {}), '%Y-%m-%d')"
        assert found == {o: duckdb.sql(sql.format(o)).fetchall()[0][0] for o in found} and len(found) == 5
        assert out.agg(F.countDistinct("ds"), F.datediff(F.max("ds"), F.min("ds"))).first()[:] == (800_000, 799_999)
    texts = spark.sql("select explode(array(date_add(DATE '9999-12-31', 1), null, DATE '0012-01-02')) as d").select(day_text("d"))
    assert [r[0] for r in texts.collect()] == ["10000-01-01", None, "0012-01-02"]


def test_holdout_needs_a_training_row(spark):
    df = daily(spark, 5, float)
    for keys in ([], ["series"]):
        for horizon in (5, 0):
            with pytest.raises(ValueError):
                series.tail_holdout(df, "ds", horizon, keys)
        train, test = series.tail_holdout(df, "ds", 2, keys)
        assert [r["y"] for r in test.orderBy("ds").collect()] == [3.0, 4.0] and train.count() == 3


def test_short_series_is_named(spark):
    both = daily(spark, 9, float).unionByName(daily(spark, 2, float, "short"))
    with pytest.raises(ValueError, match="short"):
        series.tail_holdout(both, "ds", 3, ["series"])


def test_exact_pattern_is_recovered(spark):
    """A level with a weekday pattern, and a constant series, are forecast without error."""
    week = [1.0, 1.0, 1.0, 1.0, 1.0, 1.5, 0.5]
    both = daily(spark, 7 * 20, lambda i: 100 * week[i % 7]).unionByName(daily(spark, 40, lambda i: 7.0, "flat"))
    train, test = series.tail_holdout(both, "ds", 7, ["series"])
    out = series.predict(test, series.fit(train, ["series"]), ["series"])
    gaps = {r["series"]: r["g"] for r in out.groupBy("series").agg(F.max(F.abs(F.col("y") - F.col("yhat"))).alias("g")).collect()}
    assert gaps["flat"] < 1e-9 and gaps["s"] < 8
    assert out.filter("yhat_lower > yhat OR yhat_upper < yhat").count() == 0


def test_null_series_key_fails_and_unknown_series_is_kept(spark):
    df = daily(spark, 5, float)
    with pytest.raises(Exception, match="series key is null"):
        series.fit(df.withColumn("series", F.lit(None).cast("string")), ["series"])
    out = series.predict(daily(spark, 2, float, "other"), series.fit(df, ["series"]), ["series"])
    assert [r["yhat"] for r in out.collect()] == [None, None]


def test_one_point_series(spark):
    model = series.fit(daily(spark, 1, lambda i: 4.0), ["series"])
    ahead = series.future_frame(daily(spark, 1, float), "ds", 2, ["series"], history=False)
    out = series.predict(ahead, model, ["series"])
    assert [r["yhat"] for r in out.collect()] == [4.0, 4.0]


def test_yearly_index_at_any_length(spark):
    both = daily(spark, 800, lambda i: 1.0 + i % 5).unionByName(daily(spark, 300, lambda i: 1.0 + i % 5, "young"))
    found = {r["series"]: r["yearly"] for r in series.fit(both, ["series"]).collect()}
    assert len(found["s"]) == 12 and len(found["young"]) in (10, 11)
    without = series.fit(both, ["series"], yearly=False).collect()
    assert [r["yearly"] for r in without] == [None, None]


def test_future_frame(spark):
    out = series.future_frame(daily(spark, 2, float), "ds", 2, ["series"])
    assert [r["ds"].day for r in out.orderBy("ds").collect()] == [1, 2, 3, 4]
