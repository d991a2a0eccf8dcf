import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.models import intervals, series, trend
from tablemill.operators import metrics

DAY = dt.date(2020, 1, 1)


def daily(spark, days, value, name="s"):
    data = [(name, DAY + dt.timedelta(days=i), float(value(i))) for i in range(days)]
    return spark.createDataFrame(data, "series string, ds date, y double")


def broken(i):
    """Flat, then steep, with a week and a year in proportion."""
    level = 100 + 0.8 * max(0, i - 500)
    return level * (1 + 0.2 * math.sin(2 * math.pi * i / 7) + 0.1 * math.cos(2 * math.pi * i / 365.25))


def mae(out):
    return metrics.forecast_scores(out).first()["mae"]


def test_a_break_is_followed(spark):
    train, test = series.tail_holdout(daily(spark, 900, broken), "ds", 30, ["series"])
    bent = trend.predict_trend(test, trend.fit_trend(train, ["series"]), ["series"])
    straight = series.predict(test, series.fit(train, ["series"]), ["series"])
    assert mae(bent) < 0.25 * mae(straight)
    assert bent.where("yhat_lower > yhat or yhat_upper < yhat").count() == 0
    changes = trend.change_points(trend.fit_trend(train, ["series"]), ["series"]).orderBy("ds").collect()
    assert len(changes) == 25
    near = sum(r["change"] for r in changes if abs((r["ds"] - DAY).days - 500) < 120)
    assert near == pytest.approx(0.8, rel=0.35)


def test_same_equations_as_numpy(spark):
    """Coefficients of two series at once are those of each series' own least squares."""
    shape = trend.Shape(changes=3, weekly=1, yearly=0)
    both = daily(spark, 60, broken, "a").unionByName(daily(spark, 45, lambda i: 5 - 0.1 * i + (i % 7 == 3), "b"))
    found = {r["series"]: r for r in trend.fit_trend(both, ["series"], shape=shape).collect()}
    for name, n in (("a", 60), ("b", 45)):
        y = np.array([r["y"] for r in both.where(F.col("series") == name).orderBy("ds").collect()])
        day = (DAY - dt.date(1970, 1, 1)).days + np.arange(n)
        slope, intercept = np.polyfit(day - day[0], y, 1)
        scale, t = np.abs(y).max(), np.arange(n) / (n - 1)
        line = (intercept + slope * (day - day[0])) / scale
        angle = 2 * math.pi * day / 7
        x = np.column_stack([np.ones(n), t, *[np.maximum(t - p, 0) for p in shape.points()], line * np.sin(angle), line * np.cos(angle)])
        z = np.concatenate((y / scale, np.zeros(x.shape[1])))
        beta, *_ = np.linalg.lstsq(np.vstack((x, np.diag(np.sqrt(shape.penalties())))), z, rcond=None)
        assert np.allclose(found[name]["beta"], beta, atol=1e-6)
        assert found[name]["sigma"] == pytest.approx(np.std(y - x @ beta * scale, ddof=1), rel=1e-6)
        assert found[name]["n"] == n


def test_short_flat_and_unknown_series(spark):
    train = daily(spark, 1, lambda i: 4.0, "one").unionByName(daily(spark, 10, lambda i: 0.0, "zero"))
    train = train.unionByName(spark.createDataFrame([("none", DAY, None), ("one", None, 3.0)], train.schema))
    model = trend.fit_trend(train, ["series"])
    ahead = spark.createDataFrame([(s, DAY + dt.timedelta(days=20)) for s in ("one", "zero", "none", "new", None)], "series string, ds date")
    found = {r["series"]: r["yhat"] for r in trend.predict_trend(ahead, model, ["series"]).collect()}
    assert found["one"] == pytest.approx(4.0, abs=0.1) and found["zero"] == pytest.approx(0, abs=1e-9)
    assert found["none"] is None and found["new"] is None and found[None] is None
    with pytest.raises(Exception, match="series key is null"):
        trend.fit_trend(daily(spark, 3, float, None), ["series"])
    assert trend.fit_trend(train.where("false"), ["series"]).count() == 0


def test_errors_grow_with_the_horizon(spark):
    """A series that turns at its end: what was said long before is worse than what was said the day before."""
    turning = daily(spark, 400, lambda i: 100 + max(0, i - 300) ** 1.5 + (i % 7))
    errors = intervals.horizon_errors(turning, ["series"], 20, 4).orderBy("step").collect()
    found = [r["variance"] for r in errors]
    assert [r["step"] for r in errors] == list(range(1, 21)) and found == sorted(found) and found[-1] > 1.15 * found[0]


def test_errors_by_hand(spark):
    days = 60
    given = daily(spark, days, lambda i: 10 + i + (i % 7 == 2) * 3).where(F.day("ds") != 20)
    errors = {r["step"]: r["variance"] for r in intervals.horizon_errors(given, ["series"], 5, 2).collect()}
    squares = {}
    for back in (5, 10):
        cut = DAY + dt.timedelta(days=days - 1 - back)
        known = given.where(F.col("ds") <= F.lit(cut))
        after = given.where((F.col("ds") > F.lit(cut)) & (F.col("ds") <= F.lit(cut + dt.timedelta(days=5))))
        for r in series.predict(after, series.fit(known, ["series"]), ["series"]).collect():
            squares.setdefault((r["ds"] - cut).days, []).append((r["y"] - r["yhat"]) ** 2)
    highest = 0
    for step in range(1, 6):
        highest = max(highest, np.mean(squares[step])) if step in squares else highest
        assert errors[step] == pytest.approx(highest)


def test_widened_bounds(spark):
    forecast = spark.createDataFrame([("s", DAY + dt.timedelta(days=d), 10.0, 9.0, 11.0) for d in (-3, 1, 2, 8)] + [("t", DAY, 5.0, 4.0, 6.0), (None, DAY, 1.0, 0.0, 2.0)], "series string, ds date, yhat double, yhat_lower double, yhat_upper double")
    errors = spark.createDataFrame([("s", 1, 1.0), ("s", 2, 4.0)], "series string, step int, variance double")
    last = spark.createDataFrame([("s", DAY), ("t", DAY)], "series string, last_ds date")
    out = intervals.widened(forecast, errors, last, ["series"], z=1.0)
    assert out.columns == forecast.columns
    found = [(r[0], (r[1] - DAY).days, r[3], r[4]) for r in rows(out)]
    wanted = [("s", -3, 9, 11), ("s", 1, 9, 11), ("s", 2, 8, 12), ("s", 8, 6, 14), ("t", 0, 4, 6), (None, 0, 0, 2)]
    assert sorted(found, key=repr) == sorted(((s, d, float(a), float(b)) for s, d, a, b in wanted), key=repr)


def test_no_origin_in_a_short_series(spark):
    assert intervals.horizon_errors(daily(spark, 5, float), ["series"], 10).count() == 0
    with pytest.raises(ValueError):
        intervals.horizon_errors(daily(spark, 5, float), ["series"], 0)
