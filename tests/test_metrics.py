import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import functions as F

from conftest import DATA, rows
from tablemill.functions.vector import as_vector
from tablemill.models import classifier, kmeans
from tablemill.operators import champion, clusters, fairness, metrics


def test_auc_ties_and_single_class(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert metrics.roc_auc(tied, "y", "s").first()[0] == 0.5
    ranked = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.3), (1, 0.9)], "y int, s double")
    assert metrics.roc_auc(ranked, "y", "s").first()[0] == 1.0
    with pytest.raises(Exception, match="both classes"):
        metrics.roc_auc(tied.filter("y = 1"), "y", "s").collect()


def test_scores_equal_the_evaluators(spark):
    df = spark.range(2000).select(
        (F.hash("id") % 3 == 0).cast("double").alias("label"),
        (F.hash("id", F.lit(1)) % 2 == 0).cast("double").alias("prediction"),
        (F.pmod(F.hash("id", F.lit(2)), F.lit(57))).cast("double").alias("rawPrediction"),
    )
    found = metrics.classification_scores(metrics.confusion_matrix(df, "label", "prediction")).first()
    for name, field in (("f1", "f1_score"), ("accuracy", "accuracy")):
        wanted = MulticlassClassificationEvaluator(metricName=name).evaluate(df)
        assert found[field] == pytest.approx(wanted, abs=1e-12)
    auc = BinaryClassificationEvaluator(numBins=0).evaluate(df)
    assert metrics.roc_auc(df, "label", "rawPrediction").first()[0] == pytest.approx(auc, abs=1e-12)


def test_class_without_support_or_predictions(spark):
    df = spark.createDataFrame([(0, 2), (1, 1)], "y int, p int")
    row = metrics.classification_scores(metrics.confusion_matrix(df, "y", "p")).first()
    assert (row["rows"], row["accuracy"], row["f1_score"]) == (2, 0.5, 0.5)


def test_mape(spark):
    zeros = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, yhat double")
    row = metrics.forecast_scores(zeros).first()
    assert math.isnan(row["mape"]) and row["mae"] == 1.5
    mixed = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, yhat double")
    assert metrics.forecast_scores(mixed).first()["mape"] == 50.0


CASES = [
    (0.5, 0.5, True, True),
    (0.6, 0.5, True, True),
    (0.4, 0.5, True, False),
    (float("nan"), 0.5, True, False),
    (0.5, float("nan"), True, False),
    (0.5, None, True, True),
    (0.4, 0.5, False, True),
]


@pytest.mark.parametrize("new,old,loadable,wanted", CASES)
def test_promotion(spark, new, old, loadable, wanted):
    assert champion.decide(new, old, loadable, True) is wanted
    challengers = spark.createDataFrame([("m", 2, new)], "model string, version bigint, f1 double")
    champions = spark.createDataFrame(
        [] if old is None else [("m", 1, old, loadable)],
        "model string, version bigint, f1 double, loadable boolean",
    )
    row = champion.promotion_decisions(challengers, champions, "f1", True).first()
    assert row["promote"] is wanted


def test_promotion_when_less_is_better():
    assert champion.decide(1.0, 2.0, True, False) and not champion.decide(3.0, 2.0, True, False)
    assert not champion.decide(float("nan"), 2.0, True, False)


# -- clusters -------------------------------------------------------------------------------------


def brute_silhouette(x, c, power):
    out = []
    for i in range(len(x)):
        gaps = np.linalg.norm(x - x[i], axis=1) ** power
        own = (c == c[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = gaps[c == c[i]].sum() / (own - 1)
        b = min(gaps[c == k].mean() for k in set(c) if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(240, 4))
    # one cluster holds most rows, one holds a single row
    c = np.where(np.arange(240) == 0, 9, np.where(np.arange(240) < 190, 1, 2))
    df = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, c)], "v array<double>, c int")
    return x, c, df.repartition(5).cache()


@pytest.mark.parametrize("block_rows", [17, 64, 1000])
def test_silhouette_by_blocks_equals_brute_force(points, block_rows):
    x, c, df = points
    found = clusters.silhouette_exact(df, "v", "c", block_rows).first()[0]
    assert found == pytest.approx(brute_silhouette(x, c, 1), abs=1e-9)


def test_silhouette_tasks_hold_two_tiles(points, monkeypatch):
    """Blocks travel as one value each, and a task gets those of two tiles, whatever the number of blocks."""
    x, c, df = points
    monkeypatch.setattr(clusters, "TILE_BYTES", 2 * 17 * 4 * 8)
    monkeypatch.setattr(clusters, "STRIP_ROWS", 5)
    found = clusters.silhouette_exact(df, "v", "c", 17)
    assert found.first()[0] == pytest.approx(brute_silhouette(x, c, 1), abs=1e-9)
    # 240 rows in 15 blocks are met by at most as many partial sums a row as there are tiles
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "items" not in plan


def test_squared_silhouette_equals_brute_force_and_the_evaluator(points):
    x, c, df = points
    found = clusters.silhouette_squared(df, "v", "c").first()[0]
    assert found == pytest.approx(brute_silhouette(x, c, 2), abs=1e-9)
    frame = df.select(as_vector("v").alias("features"), F.col("c").alias("prediction"))
    assert found == pytest.approx(ClusteringEvaluator().evaluate(frame), abs=1e-9)


def test_one_cluster_fails(points):
    _, _, df = points
    for measure in (clusters.silhouette_exact, clusters.silhouette_squared, clusters.davies_bouldin):
        with pytest.raises(ValueError):
            measure(df.filter("c = 1"), "v", "c")


def test_coincident_centroids_are_passed_over(spark):
    data = [([0.0], 0), ([2.0], 0), ([1.0], 1), ([5.0], 2), ([7.0], 2)]
    df = spark.createDataFrame(data, "v array<double>, c int")
    # centres 1, 1, 6 with spreads 1, 0, 1: worst ratios 2/5, 1/5, 2/5
    assert clusters.davies_bouldin(df, "v", "c").first()[0] == pytest.approx(1 / 3)


def test_nearest_centroid_ties_go_to_the_lower_number(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 0.0],)], "v array<double>")
    out = clusters.assign_clusters(df, "v", [[1.0, 0.0], [-1.0, 0.0], [3.0, 0.0]])
    assert rows(out.select("cluster", "d2")) == [(0, 1.0), (2, 0.0)]
    with pytest.raises(ValueError):
        clusters.assign_clusters(df, "v", [])


# -- fairness -------------------------------------------------------------------------------------


def test_groups_gaps_and_pairs(spark):
    data = [("a", 0, 1), ("a", 0, 0), ("a", 1, 1), ("b", 1, 1), ("b", 1, 0)]
    df = spark.createDataFrame(data, "g string, y int, p int")
    table = fairness.group_metrics(df, "g", "y", "p")
    found = {r["group"]: r for r in table.collect()}
    assert found["a"]["fpr"] == 0.5 and found["a"]["fnr"] == 0.0
    assert found["b"]["fpr"] is None and found["b"]["fnr"] == 0.5
    gaps = {r["metric"]: r for r in fairness.fairness_gaps(table).collect()}
    assert gaps["accuracy"]["acceptable"] == "No" and gaps["fpr"]["acceptable"] == "Yes"
    assert gaps["fnr"]["acceptable"] is None and gaps["fnr"]["highest"] == "b"
    pairs = rows(fairness.group_pairs(table).select("metric", "group_a", "group_b"))
    assert pairs == [("accuracy", "a", "b"), ("fnr", "a", "b")]
    against = fairness.against_reference(table)
    assert rows(against.select("metric", "group", "reference", "acceptable")) == [("accuracy", "b", "a", "No"), ("fnr", "b", "a", None)]
    assert {r["metric"]: r["difference"] for r in against.collect()} == pytest.approx({"accuracy": -1 / 6, "fnr": 0.5})
    named = fairness.against_reference(table, "b")
    assert rows(named.select("metric", "group", "difference")) == [("accuracy", "a", pytest.approx(1 / 6)), ("fnr", "a", -0.5)]
    assert fairness.against_reference(table, "c").count() == 0


def test_reference_is_the_largest_named_group(spark):
    data = [(None, 0, 1)] * 5 + [("b", 0, 1), ("b", 0, 0), ("a", 0, 0), ("a", 0, 1), ("c", 0, 0)]
    table = fairness.group_metrics(spark.createDataFrame(data, "g string, y int, p int"), "g", "y", "p")
    found = fairness.against_reference(table).where("metric = 'fpr'")
    assert rows(found.select("group", "reference", "difference")) == sorted([(None, "a", 0.5), ("b", "a", 0.0), ("c", "a", -0.5)], key=repr)


def test_pairs_of_many_groups(spark):
    table = fairness.group_metrics(spark.range(600).selectExpr("cast(id as string) as g", "0 as y", "0 as p"), "g", "y", "p")
    assert fairness.group_pairs(table).where("metric = 'accuracy'").count() == 600 * 599 // 2


def test_thresholds(spark):
    scores = spark.createDataFrame([(0.7, float("nan"))], "accuracy double, roc_auc double")
    out = fairness.performance_vs_threshold(scores, {"accuracy": 0.7, "roc_auc": 0.5})
    assert [r["met"] for r in out.orderBy("metric").collect()] == [True, False]


def test_squared_silhouette_of_named_clusters(points):
    _, _, df = points
    named = df.withColumn("c", F.concat(F.lit("group "), "c"))
    plain = clusters.silhouette_squared(df, "v", "c").first()[0]
    assert clusters.silhouette_squared(named, "v", "c").first()[0] == pytest.approx(plain, abs=1e-12)


def test_restarts_dropped_early_cost_little(spark):
    frame = spark.read.parquet(f"{DATA}/embeddings.parquet").select(as_vector("embedding").alias("features"))
    with kmeans.held_vectors(frame) as vectors:
        early = kmeans.best_per_k(vectors, [3, 6], restarts=5)
        whole = kmeans.best_per_k(vectors, [3, 6], restarts=5, finalists=5)
    for k in (3, 6):
        assert early[k].summary.trainingCost <= 1.01 * whole[k].summary.trainingCost


def test_forest_is_the_same_however_rows_lie(spark):
    df = spark.range(3000).select("id", F.pmod(F.hash("id"), F.lit(100)).alias("x"), (F.col("id") % 7).alias("y"))
    df = df.withColumn("label", (F.col("x") + F.col("y") > 50).cast("int"))

    def trees(frame, **options):
        return classifier.fit(frame, "label", ["x", "y"], 5, keys=["id"], **options).stages[-1].toDebugString.split("\n", 1)[1]

    assert trees(df.repartition(3)) == trees(df.orderBy(F.desc("x")).coalesce(1))
    assert trees(df.repartition(5), max_rows=500) == trees(df, max_rows=500)
    kept = classifier.fit_rows(df, "label", ["id"], 500).count()
    assert 400 < kept < 600 and classifier.fit_rows(df, "label", ["id"]).count() == 3000
