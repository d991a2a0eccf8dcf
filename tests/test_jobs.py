"""The whole chain on one small project: features, models, promotion, scoring, monitoring."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import DATA, rows
from tablemill.models import kmeans
from tablemill.operators.quality import check_scored, clean
from tablemill.plans import jobs
from tablemill.plans.catalog import raw_rows
from tablemill.session import materialize
from tablemill.sources.lake import Lake
from tablemill.streaming.ingest import INGEST_RULES

END = dt.date(2024, 12, 31)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    made = jobs.Project.at(Lake(spark, str(tmp_path_factory.mktemp("lake"))))
    jobs.build_features(made, cleaned(spark), "x_features", buckets=2)
    return made


def cleaned(spark):
    return materialize(clean(raw_rows(spark, DATA), ["id"], INGEST_RULES), "cleaned")


@pytest.fixture(scope="module")
def labels(spark):
    return cleaned(spark).select("id", (F.col("value_1") > 50000).cast("int").alias("target"))


def test_ingest_to_features(spark, tmp_path):
    made = jobs.Project.at(Lake(spark, str(tmp_path / "lake")))
    raw = raw_rows(spark, DATA)
    raw.filter("id % 2 = 0").write.option("header", True).csv(str(tmp_path / "in" / "1"))
    for _ in range(2):
        jobs.ingest(made, str(tmp_path / "in" / "*"), raw.schema, sequence="validate_first")
    raw.filter("id % 2 = 1").write.option("header", True).csv(str(tmp_path / "in" / "2"))
    jobs.ingest(made, str(tmp_path / "in" / "*"), raw.schema, sequence="validate_first")
    assert made.lake.read("raw_data").count() == raw.count()
    assert made.lake.meta("cleaned_data")["properties"] == {"quality": "silver"}
    wanted = raw.filter("event_timestamp IS NOT NULL").select("id").distinct().count()
    assert made.lake.read("cleaned_data").count() == wanted
    jobs.build_features(made, made.lake.read("cleaned_data"), "f_features")
    assert made.lake.read("f_features").count() == wanted


def test_features_are_idempotent(project, spark):
    before = project.lake.read("x_features").drop("feature_updated_timestamp")
    jobs.build_features(project, cleaned(spark), "x_features")
    after = project.lake.read("x_features").drop("feature_updated_timestamp")
    assert rows(before) == rows(after)


def test_classification_to_gold(project, labels):
    with pytest.raises(LookupError):
        jobs.batch_score(project, "x_features", "m")
    jobs.train_classification(project, labels, "x_features", "m", num_trees=5, max_depth=4)
    first = jobs.evaluate_classification(project, labels, "x_features", "m")
    assert first.promoted and first.champion is None
    assert all(0 <= v <= 1 for v in first.challenger_metrics.values())
    # a worse challenger: one stump
    jobs.train_classification(project, labels.withColumn("target", 1 - F.col("target")), "x_features", "m", num_trees=5, max_depth=4)
    second = jobs.evaluate_classification(project, labels, "x_features", "m", eval_split="test")
    assert not second.promoted and second.champion == 1 and second.champion_metrics["f1_score"] > 0.5
    assert project.registry.alias_version("m") == 1

    jobs.batch_score(project, "x_features", "m")
    gold = project.lake.read("inference_results")
    check_scored(project.lake.read("x_features"), gold)
    assert gold.columns == ["id", "prediction", "inference_timestamp", "model_version", "resolved_version"]
    assert rows(gold.select("prediction").distinct()) == [(0.0,), (1.0,)]
    assert rows(gold.select("model_version", "resolved_version").distinct()) == [("champion", 1)]


def test_unloadable_champion_is_replaced(project, labels):
    jobs.train_classification(project, labels, "x_features", "broken", num_trees=2, max_depth=2)
    run = project.registry.log_run({"model_type": "external"}, {})
    gone = project.registry.register_version("broken", run, project.models + "/missing")
    project.registry.set_alias("broken", "champion", gone)
    found = jobs.evaluate_classification(project, labels, "x_features", "broken")
    assert found.promoted and found.champion == gone and found.champion_metrics is None
    assert project.registry.alias_version("broken") == 1


def test_corrupt_champion_is_replaced(project, labels):
    jobs.train_classification(project, labels, "x_features", "corrupt", num_trees=2, max_depth=2)
    run = project.registry.log_run({"model_type": "external"}, {})
    path = project.models + "/corrupt_model"
    project.lake.spark.range(1).selectExpr("'no model' AS value").write.text(path + "/metadata")
    project.registry.set_alias("corrupt", "champion", project.registry.register_version("corrupt", run, path))
    found = jobs.evaluate_classification(project, labels, "x_features", "corrupt")
    assert found.promoted and found.champion_metrics is None


def test_champion_on_a_lost_column_is_replaced(project, labels):
    features = project.lake.read("x_features")
    project.lake.create_if_absent("wide_features", features.withColumn("gone", F.lit(1.0)).schema, ["id"])
    project.lake.overwrite("wide_features", features.withColumn("gone", F.rand(1)))
    jobs.train_classification(project, labels, "wide_features", "lost", num_trees=2, max_depth=2)
    assert jobs.evaluate_classification(project, labels, "wide_features", "lost").promoted
    jobs.train_classification(project, labels, "x_features", "lost", num_trees=2, max_depth=2)
    found = jobs.evaluate_classification(project, labels, "x_features", "lost")
    assert found.promoted and found.champion == 1 and found.champion_metrics is None


def test_trouble_while_loading_does_not_promote(project, labels, monkeypatch):
    jobs.train_classification(project, labels, "x_features", "shaky", num_trees=2, max_depth=2)
    jobs.evaluate_classification(project, labels, "x_features", "shaky")
    load = jobs.PipelineModel.load
    loaded = []

    def once(path):
        loaded.append(path)
        if len(loaded) > 1:
            raise PySparkException("executors lost")
        return load(path)

    monkeypatch.setattr(jobs.PipelineModel, "load", once)
    with pytest.raises(PySparkException):
        jobs.evaluate_classification(project, labels, "x_features", "shaky")


def test_clustering(project):
    jobs.train_clustering(project, "x_features", "k", k=3, restarts=2, elbow=[2, 3, 4], silhouette="squared")
    run = project.registry.table("runs").filter("params['model_type'] = 'KMeans'").first()
    assert run["metrics"]["n_clusters"] == 3.0 and -1 <= run["metrics"]["silhouette_score"] <= 1
    curve = [v for _, v in rows(project.registry.table("run_metric_history").select("step", "value"))]
    assert curve == sorted(curve, reverse=True)
    for refit in (False, True):
        found = jobs.evaluate_clustering(project, "x_features", "k", "squared", refit)
        assert found.promoted


def test_clusters_are_in_range(project):
    features = project.lake.read("x_features")
    inputs = ["feature_1", "feature_2", "feature_3"]
    out = kmeans.predict(features, kmeans.fit(features, inputs, k=3, restarts=2))
    assert out.count() == features.count()
    assert {r["cluster"] for r in out.select("cluster").distinct().collect()} <= {0, 1, 2}


def test_series(project, labels):
    for keys, name in (([], "one"), (["part"], "many")):
        rows_in = labels.withColumn("part", F.col("id") % 2)
        jobs.train_series(project, rows_in, name, ["id"], END, keys=keys)
        found = jobs.evaluate_series(project, rows_in, name, ["id"], END, keys=keys)
        assert found.promoted and found.challenger_metrics["mae"] >= 0
        again = jobs.evaluate_series(project, rows_in, name, ["id"], END, keys=keys)
        assert again.promoted and again.champion == 1


def test_monitoring_twice_gives_the_same_tables(project, labels):
    for _ in range(2):
        jobs.monitor_table(project, "x_features", baseline_version=1)
        jobs.monitor_table(project, "inference_results")
    profile, drift = project.lake.read("profile_metrics"), project.lake.read("drift_metrics")
    assert drift.filter("metric = 'psi'").count() == 3
    assert profile.filter("table = 'inference_results' AND metric = 'share'").count() == 2
    keys = ["table", "window", "column", "metric"]
    assert profile.count() == profile.select(*keys).distinct().count()
