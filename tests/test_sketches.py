import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tablemill.operators import monitor, sketches
from tablemill.plans import jobs
from tablemill.sources.lake import Lake

T0 = dt.datetime(2024, 1, 1, 9)


def log(spark, days=6, rows=500):
    day = F.col("id") % days
    value = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan")).otherwise((F.hash("id") % 1000).cast("double") + 10 * day)
    return spark.range(days * rows).select("id", (F.lit(T0).cast("timestamp") + F.make_dt_interval(day.cast("int"))).alias("t"), value.alias("x"), (F.col("id") % 3).alias("c"))


def test_windows_add_up(spark):
    given = log(spark)
    daily = sketches.daily_sketches(given, "t", ["x", "c"])
    assert daily.count() == 12
    for low, high in ((0, 5), (1, 3), (4, 4)):
        days = [T0.date() + dt.timedelta(days=d) for d in range(low, high + 1)]
        whole = sketches.sketch_quantiles(sketches.merged(daily.where(F.col("day").isin(days))), monitor.QUARTILES)
        rows = given.where(F.to_date("t").isin(days))
        exact = {r["column"]: r for r in monitor.profile(rows, ["x", "c"]).collect()}
        for r in whole.collect():
            e = exact[r["column"]]
            assert (r["rows"], r["nulls"], r["nans"], r["zeros"], r["low"], r["high"]) == (e["rows"], e["nulls"], e["nans"], e["zeros"], e["min"], e["max"])
            assert r["mean"] == pytest.approx(e["mean"]) and r["sd"] == pytest.approx(e["sd"])
            values = sorted(v[0] for v in rows.select(r["column"]).collect() if v[0] is not None and not math.isnan(v[0]))
            for name, p in monitor.QUARTILES.items():
                under, upto = sum(v < r[name] for v in values) / len(values), sum(v <= r[name] for v in values) / len(values)
                assert under - 0.02 <= p <= upto + 0.02


def test_drift_of_windows(spark):
    given = log(spark).withColumn("x", F.when(F.to_date("t") > F.lit(T0.date() + dt.timedelta(days=2)), F.col("x") + 400).otherwise(F.col("x")))
    daily = sketches.daily_sketches(given, "t", ["x", "c"])
    early = F.col("day") <= F.lit(T0.date() + dt.timedelta(days=2))
    found = {r["column"]: r for r in sketches.sketch_drift(daily.where(early), daily.where(~early)).collect()}
    rows_early = F.to_date("t") <= F.lit(T0.date() + dt.timedelta(days=2))
    exact = {r["column"]: r for r in monitor.numeric_drift(given.where(rows_early), given.where(~rows_early), ["x", "c"]).collect()}
    for column in ("x", "c"):
        assert found[column]["ks"] == pytest.approx(exact[column]["ks"], abs=0.03)
    assert found["x"]["psi"] == pytest.approx(exact["x"]["psi"], rel=0.3) and found["x"]["js"] == pytest.approx(exact["x"]["js"], abs=0.05)


def test_sides_without_values(spark):
    daily = sketches.daily_sketches(log(spark).withColumn("c", F.lit(None).cast("double")), "t", ["x", "c"])
    found = {r["column"]: r for r in sketches.sketch_drift(daily, daily.where("column = 'x' and false")).collect()}
    assert found["x"]["ks"] is None and found["x"]["n_cur"] == 0 and found["c"]["n_base"] == 0
    assert sketches.merged(daily.where("false")).count() == 0


@pytest.fixture
def project(spark, tmp_path):
    made = jobs.Project.at(Lake(spark, str(tmp_path / "lake")))
    rows = log(spark).withColumn("id", F.col("id").cast("string"))
    made.lake.create_if_absent("scores", rows.schema, ["id"], buckets=4)
    made.lake.overwrite("scores", rows)
    return made


def profiles(project):
    rows = project.lake.read(jobs.DAILY).orderBy("day", "column").collect()
    return {(r["day"], r["column"]): (r["rows"], r["n"], round(r["total"], 6), r["as_of"]) for r in rows}


def test_only_touched_days_are_redone(project, spark, monkeypatch):
    assert jobs.monitor_changes(project, "scores", "t") == 6
    first = profiles(project)
    assert len(first) == 12 and {v[3] for v in first.values()} == {1}

    # nothing new: no row of the table is looked at
    read = Lake.read
    with monkeypatch.context() as patch:
        patch.setattr(Lake, "changes", lambda *a, **k: pytest.fail("feed read"))
        patch.setattr(Lake, "read", lambda self, name, *a: pytest.fail("rows read") if name == "scores" else read(self, name, *a))
        assert jobs.monitor_changes(project, "scores", "t") == 0
    assert profiles(project) == first

    # a row that comes late and one that moves from its day to another
    late = project.lake.read("scores").where("id = '7'").withColumn("x", F.lit(5000.0))
    moved = project.lake.read("scores").where("id = '2'").withColumn("t", F.lit(T0).cast("timestamp"))
    project.lake.upsert("scores", late.unionByName(moved))
    assert jobs.monitor_changes(project, "scores", "t") == 3
    now = profiles(project)
    assert {day for (day, _), v in now.items() if v[3] == 2} == {"2024-01-01", "2024-01-02", "2024-01-03"}
    whole = sketches.daily_sketches(project.lake.read("scores"), "t", ["x", "c"]).collect()
    assert {(str(r["day"]), r["column"]): (r["rows"], r["n"], round(r["total"], 6)) for r in whole} == {k: v[:3] for k, v in now.items()}


def test_a_day_that_lost_its_rows_has_none(project):
    jobs.monitor_changes(project, "scores", "t")
    gone = project.lake.read("scores").where(F.to_date("t") == "2024-01-02").withColumn("t", F.lit(None).cast("timestamp"))
    project.lake.upsert("scores", gone)
    assert jobs.monitor_changes(project, "scores", "t") == 2
    now = profiles(project)
    assert now["2024-01-02", "x"][:3] == (0, 0, 0.0) and now["", "x"][0] == 500


def test_a_windows_drift_reads_profiles_only(project):
    jobs.monitor_changes(project, "scores", "t")
    days = [T0.date() + dt.timedelta(days=d) for d in range(6)]
    drift = jobs.window_drift(project, "scores", (days[0], days[2]), (days[3], days[5]))
    files = set(drift.inputFiles())
    assert files and all(f"/{jobs.DAILY}/" in f for f in files)
    assert {r["column"] for r in drift.collect()} == {"x", "c"}
