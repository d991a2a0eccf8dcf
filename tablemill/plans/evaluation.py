"""Queries on classification, cluster and forecast quality, series, and models."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.vector import as_vector, with_nearest
from tablemill.models import classifier, intervals, kmeans, series, trend
from tablemill.operators import clusters, metrics
from tablemill.operators.features import split_train_test
from tablemill.plans.catalog import (
    DAILY_SQL,
    LABELLED_SQL,
    daily_orders,
    day_text,
    labelled_documents,
    query,
    r6,
    table,
)
from tablemill.session import materialize

# -- classification -------------------------------------------------------------------------------


@query(
    "confusion_matrix",
    f"""WITH {LABELLED_SQL}
SELECT CAST(label AS DOUBLE) AS label, CAST(prediction AS DOUBLE) AS prediction, count(*) AS count
FROM labelled GROUP BY 1, 2""",
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(labelled_documents(spark, sf_dir), "label", "prediction")


@query(
    "accuracy",
    f"""WITH {LABELLED_SQL}
SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM labelled""",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.accuracy(labelled_documents(spark, sf_dir), "label", "prediction")
    return out.select(r6("accuracy").alias("accuracy"))


def f1_sql(predictions: str, rows: str = "labelled", by: str = "") -> str:
    """Weighted F1 by class counts; ``by`` is a leading column list that ends in a comma."""
    group = by.rstrip(", ")
    using = f"({by}k)"
    over = f" GROUP BY {group}" if by else ""
    return f"""k AS (SELECT {by}label AS k FROM {rows} UNION SELECT {by}{predictions} FROM {rows}),
sup AS (SELECT {by}label AS k, count(*) AS sup FROM {rows} GROUP BY ALL),
pred AS (SELECT {by}{predictions} AS k, count(*) AS pred FROM {rows} GROUP BY ALL),
tp AS (SELECT {by}label AS k, count(*) AS tp FROM {rows} WHERE label = {predictions} GROUP BY ALL),
cls AS (SELECT {by}k, coalesce(sup, 0) AS sup, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp
  FROM k LEFT JOIN sup USING {using} LEFT JOIN pred USING {using} LEFT JOIN tp USING {using}),
scores AS (SELECT {by}CAST(sum(sup) AS BIGINT) AS rows, sum(tp) / CAST(sum(sup) AS DOUBLE) AS accuracy,
  sum(sup * coalesce(2 * tp / CAST(nullif(sup + pred, 0) AS DOUBLE), 0)) / sum(sup) AS f1_score
  FROM cls{over})"""


@query(
    "f1_weighted",
    f"WITH {LABELLED_SQL}, {f1_sql('prediction')} SELECT round(f1_score, 6) AS f1_score FROM scores",
)
def f1_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.f1_weighted(labelled_documents(spark, sf_dir), "label", "prediction")
    return out.select(r6("f1_score").alias("f1_score"))


@query(
    "roc_auc",
    f"""WITH {LABELLED_SQL}, s AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM labelled GROUP BY score),
c AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below FROM s)
SELECT round(sum(p * (below + n / 2.0::DOUBLE)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS roc_auc FROM c""",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.roc_auc(labelled_documents(spark, sf_dir), "label", "score")
    return out.select(r6("roc_auc").alias("roc_auc"))


@query(
    "roc_auc_many_scores",
    """WITH s AS (SELECT l_extendedprice AS score, count(*) FILTER (l_returnflag = 'A') AS p,
  count(*) FILTER (l_returnflag <> 'A') AS n FROM lineitem GROUP BY 1),
c AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below FROM s)
SELECT round(sum(p * (below + n / 2.0::DOUBLE)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS roc_auc FROM c""",
)
def roc_auc_many_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "A").cast("int").alias("label"),
        F.col("l_extendedprice").alias("score"),
    )
    return metrics.roc_auc(rows, "label", "score").select(r6("roc_auc").alias("roc_auc"))


@query(
    "champion_vs_challenger",
    f"""WITH {LABELLED_SQL}, stacked AS (
  SELECT 'challenger' AS model, label, prediction FROM labelled
  UNION ALL SELECT 'champion', label, prediction_b FROM labelled),
{f1_sql('prediction', 'stacked', 'model, ')}
SELECT model, rows, round(accuracy, 6) AS accuracy, round(f1_score, 6) AS f1_score FROM scores""",
)
def champion_vs_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models scored on the same rows in one pass."""
    models = {"challenger": "prediction", "champion": "prediction_b"}
    out = metrics.compare_classifiers(labelled_documents(spark, sf_dir), "label", models)
    return out.select("model", "rows", r6("accuracy").alias("accuracy"), r6("f1_score").alias("f1_score"))


# -- clusters -------------------------------------------------------------------------------------


def _first_vectors(spark: SparkSession, sf_dir: str, k: int = 5) -> list[list[float]]:
    """Fixed centroids: the vectors numbered below ``k``."""
    rows = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") < k).orderBy("vec_id")
    return [r["embedding"] for r in rows.select("embedding").collect()]


_NEAREST_SQL = """c AS (SELECT CAST(vec_id AS INTEGER) AS ck, embedding::DOUBLE[] AS cv FROM embeddings WHERE vec_id < 5),
d AS (SELECT vec_id, ck, list_sum(list_transform(list_zip(embedding::DOUBLE[], cv),
  lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM embeddings, c),
n AS (SELECT vec_id, arg_min(ck, d2) AS cluster, min(d2) AS d2 FROM d GROUP BY vec_id)"""


@query("assign_clusters", f"WITH {_NEAREST_SQL} SELECT vec_id, cluster, round(d2, 6) AS d2 FROM n")
def assign_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = clusters.assign_clusters(rows, "embedding", _first_vectors(spark, sf_dir))
    return out.select("vec_id", "cluster", r6("d2").alias("d2"))


@query("inertia", f"WITH {_NEAREST_SQL} SELECT round(sum(d2), 4) AS inertia FROM n")
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    out = clusters.inertia(rows, "embedding", _first_vectors(spark, sf_dir))
    return out.select(r6("inertia", 4).alias("inertia"))


def _silhouette_sql(distance: str, name: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS i, label AS c, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT a.i, a.c, b.c AS o, sum({distance}) AS total, count(*) AS n FROM v a, v b GROUP BY ALL),
own AS (SELECT i, total / nullif(n - 1, 0) AS a FROM m WHERE c = o),
oth AS (SELECT i, min(total / n) AS b FROM m WHERE c <> o GROUP BY i)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS {name}
FROM own JOIN oth USING (i)"""


@query("silhouette_exact", _silhouette_sql("list_distance(a.e, b.e)", "silhouette"))
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.silhouette_exact(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.select(r6("silhouette").alias("silhouette"))


@query(
    "silhouette_squared",
    _silhouette_sql("list_distance(a.e, b.e) * list_distance(a.e, b.e)", "silhouette_squared"),
)
def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.silhouette_squared(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.select(r6("silhouette_squared").alias("silhouette_squared"))


@query(
    "davies_bouldin",
    """WITH v AS (SELECT vec_id AS i, label AS c, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT i, c, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
m AS (SELECT c, d, avg(x) AS m FROM x GROUP BY ALL),
k AS (SELECT c, list(m ORDER BY d) AS cv FROM m GROUP BY c),
s AS (SELECT v.c, any_value(k.cv) AS cv, avg(list_distance(v.e, k.cv)) AS s FROM v JOIN k ON v.c = k.c GROUP BY v.c)
SELECT round(avg(worst), 6) AS davies_bouldin FROM (
  SELECT a.c, max((a.s + b.s) / list_distance(a.cv, b.cv)) AS worst
  FROM s a JOIN s b ON a.c <> b.c GROUP BY a.c)""",
)
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clusters.davies_bouldin(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return out.select(r6("davies_bouldin").alias("davies_bouldin"))


# -- fitted models --------------------------------------------------------------------------------


@query("kmeans_fit_score")
def kmeans_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of ten restarts on the vectors, and each row's cluster."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", as_vector("embedding").alias("features"))
    with kmeans.held_vectors(rows) as vectors:
        model = kmeans.best_of(vectors, kmeans.CLUSTERS)
    return model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query("kmeans_table_fit_score")
def kmeans_table_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-fill, scaling and clustering of plain columns as one pipeline."""
    rows = labelled_documents(spark, sf_dir).select("doc_id", "n_chars", "score", "toxic")
    model = kmeans.fit(rows, ["n_chars", "score", "toxic"], k=3, restarts=3)
    return kmeans.predict(rows, model).select("doc_id", "cluster")


@query("elbow_curve")
def elbow_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(as_vector("embedding").alias("features"))
    with kmeans.held_vectors(rows) as vectors:
        return kmeans.elbow_curve(vectors)


@query("forest_fit_score")
def forest_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest fitted on the train side; class and positive-class score of the held-out rows."""
    rows = labelled_documents(spark, sf_dir).select(
        "doc_id", "n_chars", F.col("score").alias("remainder"), "toxic", "label"
    )
    train, test = split_train_test(rows, "doc_id")
    model = classifier.fit(train, "label", ["n_chars", "remainder", "toxic"])
    out = classifier.predict(test, model)
    return out.select("doc_id", "label", "prediction", "score")


@query(
    "forest_facts",
    f"""WITH {LABELLED_SQL} SELECT doc_id, 1 AS known_class, 1 AS share, 1 AS agree
FROM labelled WHERE (doc_id * 2654435761) % 4294967296 < 858993459""",
)
def forest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out rows: a known class, a score from 0 to 1, and the class the score speaks for."""
    rows = labelled_documents(spark, sf_dir).select(
        "doc_id", "n_chars", F.col("score").alias("remainder"), "toxic", "label"
    )
    train, test = split_train_test(rows, "doc_id")
    model = classifier.fit(train, "label", ["n_chars", "remainder", "toxic"], 20, keys=["doc_id"])
    out, agree = classifier.predict(test, model), (F.col("score") - 0.5) * (F.col("prediction") - 0.5) >= 0
    facts = {"known_class": F.col("prediction").isin(0.0, 1.0), "share": F.col("score").between(0, 1), "agree": agree}
    return out.select("doc_id", *[fact.cast("int").alias(name) for name, fact in facts.items()])


@query("kmeans_facts", "SELECT vec_id, 1 AS known_cluster, 1 AS nearest FROM embeddings")
def kmeans_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in one of the clusters, and in the one whose centre is nearest."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", as_vector("embedding").alias("features"), "embedding")
    with kmeans.held_vectors(rows) as vectors:
        model = kmeans.best_of(vectors, kmeans.CLUSTERS, restarts=3)
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    out = with_nearest(model.transform(rows).select("vec_id", "embedding", "prediction"), "embedding", centres)
    return out.select(
        "vec_id",
        F.col("prediction").between(0, kmeans.CLUSTERS - 1).cast("int").alias("known_cluster"),
        (F.col("prediction") == F.col("cluster")).cast("int").alias("nearest"),
    )


# -- series ---------------------------------------------------------------------------------------

HORIZON = 30


@query(
    "daily_index",
    """WITH n AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM labels)
SELECT doc_id, quality AS y, strftime(DATE '2024-12-31' - CAST(n - rn AS INTEGER), '%Y-%m-%d') AS ds FROM n""",
)
def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows in key order as one series of consecutive days."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    out = series.daily_index(rows, ["doc_id"], dt.date(2024, 12, 31))
    return out.withColumn("ds", day_text("ds"))


@query(
    "daily_index_by_series",
    """WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id, strftime(DATE '2024-12-31' - CAST(n - rn AS INTEGER), '%Y-%m-%d') AS ds FROM n""",
)
def daily_index_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    out = series.daily_index(rows, ["event_id"], dt.date(2024, 12, 31), ["event_type"])
    return out.withColumn("ds", day_text("ds"))


@query(
    "tail_holdout",
    f"""WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds DESC) AS rn FROM daily)
SELECT series, strftime(ds, '%Y-%m-%d') AS ds, y, CAST(rn <= {HORIZON} AS INTEGER) AS is_test FROM r""",
)
def tail_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = materialize(daily_orders(spark, sf_dir), "daily")
    marked = series.with_holdout(daily, "ds", HORIZON, ["series"])
    return marked.withColumns({"ds": day_text("ds"), "is_test": F.col("is_test").cast("int")})


@query(
    "future_frame",
    f"""WITH {DAILY_SQL}
SELECT series, strftime(ds, '%Y-%m-%d') AS ds FROM daily
UNION ALL
SELECT series, strftime(unnest(generate_series(max(ds) + INTERVAL 1 DAY, max(ds) + INTERVAL {HORIZON} DAY,
  INTERVAL 1 DAY)), '%Y-%m-%d') FROM daily GROUP BY series""",
)
def future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.future_frame(daily_orders(spark, sf_dir), "ds", HORIZON, ["series"])
    return out.withColumn("ds", day_text("ds"))


_FIT_SQL = f"""{DAILY_SQL},
r AS (SELECT *, date_diff('day', DATE '1970-01-01', ds) AS t,
  row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= {HORIZON} AS is_test FROM daily),
tr AS (SELECT * FROM r WHERE NOT is_test),
lin AS (SELECT series, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM tr GROUP BY series),
wk AS (SELECT series, dayofweek(ds) AS dow, avg(y / (a + b * t)) AS w FROM tr JOIN lin USING (series) GROUP BY ALL),
yr AS (SELECT tr.series AS series, month(ds) AS mon, avg(y / ((a + b * t) * w)) AS m FROM tr JOIN lin USING (series)
  JOIN wk ON wk.series = tr.series AND wk.dow = dayofweek(tr.ds) GROUP BY tr.series, mon),
p AS (SELECT r.series, r.ds, r.y, r.is_test, (a + b * t) * coalesce(w, 1) * coalesce(m, 1) AS yhat
  FROM r JOIN lin ON lin.series = r.series
  LEFT JOIN wk ON wk.series = r.series AND wk.dow = dayofweek(r.ds)
  LEFT JOIN yr ON yr.series = r.series AND yr.mon = month(r.ds)),
sg AS (SELECT series, stddev_samp(y - yhat) AS sigma FROM p WHERE NOT is_test GROUP BY series)"""


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written out: the split and the fit read it several times, the orders should be read once
    daily = materialize(daily_orders(spark, sf_dir), "daily")
    train, test = series.tail_holdout(daily, "ds", HORIZON, ["series"])
    return series.predict(test, series.fit(train, ["series"]), ["series"])


@query(
    "seasonal_forecast",
    f"""WITH {_FIT_SQL} SELECT series, strftime(ds, '%Y-%m-%d') AS ds, y, round(yhat, 2) AS yhat
FROM p WHERE is_test""",
)
def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _forecast(spark, sf_dir)
    return out.select("series", day_text("ds").alias("ds"), "y", r6("yhat", 2).alias("yhat"))


@query(
    "forecast_interval",
    f"""WITH {_FIT_SQL} SELECT series, strftime(ds, '%Y-%m-%d') AS ds,
  round(yhat - 1.2816::DOUBLE * sigma, 2) AS yhat_lower, round(yhat + 1.2816::DOUBLE * sigma, 2) AS yhat_upper
FROM p JOIN sg USING (series) WHERE is_test""",
)
def forecast_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _forecast(spark, sf_dir)
    return out.select(
        "series",
        day_text("ds").alias("ds"),
        r6("yhat_lower", 2).alias("yhat_lower"),
        r6("yhat_upper", 2).alias("yhat_upper"),
    )


@query(
    "mae_rmse_mape",
    f"""WITH {_FIT_SQL} SELECT series, round(avg(abs(y - yhat)), 2) AS mae,
  round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse,
  round(coalesce(avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100, 'nan'::DOUBLE), 4) AS mape
FROM p WHERE is_test GROUP BY series""",
)
def mae_rmse_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.forecast_scores(_forecast(spark, sf_dir), by=["series"])
    return out.select(
        "series", r6("mae", 2).alias("mae"), r6("rmse", 2).alias("rmse"), r6("mape", 4).alias("mape")
    )


# -- bent trends and widening intervals -----------------------------------------------------------

#: Small enough for its normal equations to be written out in SQL: four trend terms and four of the season.
BENT = trend.Shape(changes=2, weekly=1, yearly=1)
_BREAK = dt.date(1997, 1, 1)
_POINTS = BENT.points()

_BENT_SQL = f"""{DAILY_SQL},
broken AS (SELECT series, ds, y * (1 + 0.003::DOUBLE * greatest(0, date_diff('day', DATE '{_BREAK}', ds))) AS y FROM daily),
r AS (SELECT *, date_diff('day', DATE '1970-01-01', ds) AS day,
  row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= {HORIZON} AS is_test FROM broken),
facts AS (SELECT series, min(day) AS d0, max(day) AS d1, max(abs(y)) AS scale, regr_slope(y, day) AS b, regr_intercept(y, day) AS a
  FROM r WHERE NOT is_test GROUP BY series),
places AS (SELECT r.*, scale, a + b * day AS straight, (day - d0) / (d1 - d0)::DOUBLE AS t, (a + b * day) / scale AS line FROM r JOIN facts USING (series)),
terms AS (SELECT *, [1, t, greatest(t - {_POINTS[0]}::DOUBLE, 0), greatest(t - {_POINTS[1]}::DOUBLE, 0),
  line * sin(2 * pi() / 7 * day), line * cos(2 * pi() / 7 * day),
  line * sin(2 * pi() / 365.25::DOUBLE * day), line * cos(2 * pi() / 365.25::DOUBLE * day), y / scale] AS x FROM places),
gram AS (SELECT series, i, j, sum(x[i] * x[j]) + CASE WHEN i = j THEN {BENT.penalties()}[i]::DOUBLE ELSE 0 END AS v
  FROM terms, range(1, 9) a(i), range(1, 10) b(j) WHERE NOT is_test GROUP BY series, i, j),
start AS (SELECT series, list(one ORDER BY i) AS m FROM (SELECT series, i, list(v ORDER BY j) AS one FROM gram GROUP BY series, i) GROUP BY series),
cleared AS (SELECT series, 1 AS k, m FROM start UNION ALL
  SELECT series, k + 1, list_transform(m, lambda one, i: CASE WHEN i = k THEN list_transform(one, lambda v: v / m[k][k])
    ELSE list_transform(one, lambda v, j: v - one[k] * m[k][j] / m[k][k]) END) FROM cleared WHERE k < 9),
found AS (SELECT series, list_transform(m, lambda one: one[9]) AS beta FROM cleared WHERE k = 9),
bent AS (SELECT terms.*, list_inner_product(beta, x[1:8]) * scale AS yhat FROM terms JOIN found USING (series))"""


def _broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily orders that begin to rise steeply on a day in the history, as train and test rows."""
    late = F.greatest(F.lit(0), F.datediff("ds", F.lit(_BREAK)))
    daily = daily_orders(spark, sf_dir).withColumn("y", F.col("y") * (1 + F.lit(0.003) * late))
    return series.tail_holdout(materialize(daily, "daily"), "ds", HORIZON, ["series"])


@query(
    "trend_forecast",
    f"""WITH RECURSIVE {_BENT_SQL} SELECT series, strftime(ds, '%Y-%m-%d') AS ds, round(yhat) AS yhat FROM bent WHERE is_test""",
)
def trend_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _broken(spark, sf_dir)
    out = trend.predict_trend(test, trend.fit_trend(train, ["series"], shape=BENT), ["series"], shape=BENT)
    return out.select("series", day_text("ds").alias("ds"), F.round("yhat").alias("yhat"))


@query(
    "trend_against_line",
    f"""WITH RECURSIVE {_BENT_SQL} SELECT series, round(avg(abs(y - yhat))) AS mae_bent, round(avg(abs(y - straight))) AS mae_straight,
  avg(abs(y - yhat)) < avg(abs(y - straight)) AS better FROM bent WHERE is_test GROUP BY series""",
)
def trend_against_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bent trend gains over the straight line on series that break."""
    train, test = _broken(spark, sf_dir)
    model = trend.fit_trend(train, ["series"], shape=BENT)
    straight = F.col("intercept") + F.col("slope") * series.day_number("ds")
    out = trend.predict_trend(test, model, ["series"], shape=BENT).join(model.select("series", "intercept", "slope"), "series")
    bent, line = F.avg(F.abs(F.col("y") - F.col("yhat"))), F.avg(F.abs(F.col("y") - straight))
    return out.groupBy("series").agg(F.round(bent).alias("mae_bent"), F.round(line).alias("mae_straight"), (bent < line).alias("better"))


ORIGINS = 3

_WIDE_SQL = f"""{DAILY_SQL},
r AS (SELECT *, date_diff('day', DATE '1970-01-01', ds) AS t,
  row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= {HORIZON} AS is_test FROM daily),
whole AS (SELECT series, max(ds) AS last_ds FROM r WHERE NOT is_test GROUP BY series),
fold AS (SELECT series, o, CASE WHEN o = 0 THEN last_ds ELSE CAST(last_ds - to_days((o * {HORIZON})::INTEGER) AS DATE) END AS cut
  FROM whole, range({ORIGINS + 1}) n(o)),
f AS (SELECT r.*, o, cut, ds > cut AS ahead FROM r JOIN fold USING (series)
  WHERE o = 0 OR (NOT is_test AND ds <= cut + to_days({HORIZON}))),
lin AS (SELECT series, o, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM f WHERE NOT ahead GROUP BY ALL),
wk AS (SELECT series, o, dayofweek(ds) AS dow, avg(y / (a + b * t)) AS w FROM f JOIN lin USING (series, o) WHERE NOT ahead GROUP BY ALL),
yr AS (SELECT series, o, month(ds) AS mon, avg(y / ((a + b * t) * w)) AS m FROM f JOIN lin USING (series, o)
  JOIN wk USING (series, o) WHERE NOT ahead AND dow = dayofweek(ds) GROUP BY ALL),
p AS (SELECT f.*, date_diff('day', cut, ds) AS step, (a + b * t) * coalesce(w, 1) * coalesce(m, 1) AS yhat FROM f JOIN lin USING (series, o)
  LEFT JOIN wk ON wk.series = f.series AND wk.o = f.o AND dow = dayofweek(ds)
  LEFT JOIN yr ON yr.series = f.series AND yr.o = f.o AND mon = month(ds) WHERE ahead),
e AS (SELECT series, step, avg((y - yhat) * (y - yhat)) AS e FROM p WHERE o > 0 GROUP BY ALL),
v AS (SELECT s.series, n.step, coalesce(max(e) OVER (PARTITION BY s.series ORDER BY n.step),
  first_value(e IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY n.step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS variance
  FROM (SELECT DISTINCT series FROM e) s CROSS JOIN range(1, {HORIZON + 1}) n(step) LEFT JOIN e ON e.series = s.series AND e.step = n.step)"""


def _widened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test rows with widened bounds, the errors by horizon, and the model."""
    daily = materialize(daily_orders(spark, sf_dir), "daily")
    train, test = series.tail_holdout(daily, "ds", HORIZON, ["series"])
    errors = materialize(intervals.horizon_errors(train, ["series"], HORIZON, ORIGINS), "errors")
    model = series.fit(train, ["series"])
    return intervals.widened(series.predict(test, model, ["series"]), errors, model, ["series"]), errors, model


@query("horizon_errors", f"WITH {_WIDE_SQL} SELECT series, step::INTEGER AS step, round(sqrt(variance)) AS sd FROM v")
def horizon_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, errors, _ = _widened(spark, sf_dir)
    return errors.select("series", "step", F.round(F.sqrt("variance")).alias("sd"))


@query(
    "widening_interval",
    f"""WITH {_WIDE_SQL} SELECT p.series, p.step::INTEGER AS step, strftime(ds, '%Y-%m-%d') AS ds,
  round(2 * 1.2816::DOUBLE * sqrt(variance * greatest(p.step / {HORIZON}::DOUBLE, 1))) AS width
FROM p JOIN v ON v.series = p.series AND v.step = least(p.step, {HORIZON}) WHERE o = 0""",
)
def widening_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, model = _widened(spark, sf_dir)
    ended = model.select(F.col("series").alias("__s"), "last_ds")
    step = F.datediff("ds", "last_ds").alias("step")
    joined = out.join(ended, out["series"] == ended["__s"])
    return joined.select("series", step, day_text("ds").alias("ds"), F.round(F.col("yhat_upper") - F.col("yhat_lower")).alias("width"))
