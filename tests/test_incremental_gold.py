import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.plans import jobs
from tablemill.plans.monitoring import rule_model
from tablemill.sources.lake import Lake

INPUTS = [("x", "double")]


@pytest.fixture
def project(spark, tmp_path):
    made = jobs.Project.at(Lake(spark, str(tmp_path / "lake")))
    made.lake.create_if_absent("f_features", features(spark, 1).schema, ["id"], buckets=4)
    made.lake.upsert("f_features", features(spark, 100))
    rule_model(made, "m", "x > 50", INPUTS)
    return made


def features(spark, n, shift=0.0):
    return spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") + F.lit(shift)).alias("x"))


def run(project, day):
    return jobs.score_changes(project, "f_features", "m", "gold", now=F.lit(f"2024-01-0{day}").cast("timestamp"), buckets=4)


def gold(project):
    return {r["id"]: (r["prediction"], r["inference_timestamp"].day, r["resolved_version"]) for r in project.lake.read("gold").collect()}


def test_as_the_full_recompute(project, spark, monkeypatch):
    assert run(project, 1) == 100
    read = Lake.read
    with monkeypatch.context() as patch:
        patch.setattr(Lake, "read", lambda self, name, *a: pytest.fail("rows read") if name == "f_features" else read(self, name, *a))
        assert run(project, 2) == 0
    # three rows change, one is new; two upserts between runs count as one change
    project.lake.upsert("f_features", features(spark, 3, 500.0))
    project.lake.upsert("f_features", features(spark, 2, 90.0).unionByName(spark.createDataFrame([("new", 7.0)], "id string, x double")))
    assert run(project, 3) == 4
    found = gold(project)
    assert {i for i, v in found.items() if v[1] == 3} == {"0", "1", "2", "new"} and found["0"] == (1.0, 3, 1) and found["new"][0] == 0.0
    jobs.batch_score(project, "f_features", "m", "whole")
    whole = project.lake.read("whole").select("id", "prediction")
    assert rows(whole) == rows(project.lake.read("gold").select("id", "prediction"))


def test_only_changed_buckets_are_read(project, spark, monkeypatch):
    run(project, 1)
    project.lake.upsert("f_features", features(spark, 1, 500.0))
    opened, plain = [], Lake._read_parts

    def read_parts(self, name, meta, parts):
        opened.append(len(parts))
        return plain(self, name, meta, parts)

    monkeypatch.setattr(Lake, "_read_parts", read_parts)
    feed = project.lake.changes("f_features", 1)
    assert opened == [1, 1] and feed.count() == 2
    # folders of other buckets are left out by a filter on the partition column
    assert "PartitionFilters: [isnotnull(__bucket" in feed._jdf.queryExecution().executedPlan().toString()


def test_a_moved_alias_scores_all(project):
    run(project, 1)
    rule_model(project, "m", "x > 10", INPUTS)
    assert run(project, 2) == 100
    assert {v[1:] for v in gold(project).values()} == {(2, 2)} and gold(project)["20"][0] == 1.0


def test_a_full_refresh_drops_rows(project, spark):
    run(project, 1)
    project.lake.overwrite("f_features", features(spark, 40))
    assert run(project, 2) == 40 and len(gold(project)) == 40


def test_no_champion(project):
    with pytest.raises(LookupError):
        jobs.score_changes(project, "f_features", "other")
