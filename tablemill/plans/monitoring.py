"""Queries on scoring, profiles, drift, fairness, and the run and model tables."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.models import kmeans
from tablemill.operators import champion, fairness, metrics, monitor, quality, scoring, sketches
from tablemill.plans import jobs
from tablemill.plans.catalog import (
    LABELLED_SQL,
    RAW_SQL,
    day_text,
    labelled_documents,
    new_lake,
    query,
    r6,
    raw_rows,
    table,
)
from tablemill.plans.evaluation import f1_sql
from tablemill.session import materialize
from tablemill.sources import registry
from tablemill.streaming.ingest import INGEST_RULES

# -- scoring --------------------------------------------------------------------------------------

WEIGHTS = {"l_quantity": 0.5, "l_extendedprice": 0.001, "l_discount": -2.0, "l_tax": 1.0}
_LINEAR_SQL = "l_quantity * 0.5::DOUBLE + l_extendedprice * 0.001::DOUBLE + l_discount * (-2.0::DOUBLE) + l_tax"


def _load_linear():
    """A stand-in for loading a foreign model: runs once per partition."""
    weights = np.asarray(list(WEIGHTS.values()))

    def predict(frame: pd.DataFrame) -> np.ndarray:
        return frame[list(WEIGHTS)].to_numpy(dtype="float64") @ weights

    return predict


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *WEIGHTS)
    return scoring.score_python(rows, _load_linear, list(WEIGHTS))


@query(
    "score_linear_udf",
    f"SELECT l_orderkey, l_linenumber, round({_LINEAR_SQL}, 6) AS prediction FROM lineitem",
)
def score_linear_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", r6("prediction").alias("prediction"))


@query(
    "score_batches",
    "SELECT event_id, CAST(value > 50 AS INTEGER) AS high, round(value / 2, 4) AS half FROM events",
)
def score_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python model that returns several columns per batch."""

    def load():
        def predict(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(
                {
                    "event_id": frame["event_id"],
                    "high": (frame["value"] > 50).astype("int32"),
                    "half": frame["value"] / 2,
                }
            )

        return predict

    rows = table(spark, sf_dir, "events").select("event_id", "value")
    out = scoring.score_batches(rows, load, "event_id bigint, high int, half double")
    return out.withColumn("half", r6("half", 4))


@query(
    "gold_projection",
    f"""SELECT l_orderkey AS id, round({_LINEAR_SQL}, 6) AS prediction, '2024-06-01' AS inference_day,
  'champion' AS model_version, CAST(3 AS BIGINT) AS resolved_version FROM lineitem""",
)
def gold_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    scored = _scored(spark, sf_dir).withColumnRenamed("l_orderkey", "id")
    out = scoring.gold(scoring.scoring_input(scored), "champion", 3, now)
    return out.select(
        "id",
        r6("prediction").alias("prediction"),
        day_text("inference_timestamp").alias("inference_day"),
        "model_version",
        "resolved_version",
    )


@query(
    "gold_recompute_changes",
    """WITH a AS (SELECT o_orderkey AS id, CAST(o_totalprice > 100000 AS DOUBLE) AS p FROM orders),
b AS (SELECT o_orderkey AS id, CAST(o_totalprice > 150000 AS DOUBLE) AS p FROM orders)
SELECT a.id, a.p AS prediction, 'update_preimage' AS _change_type FROM a JOIN b USING (id) WHERE a.p <> b.p
UNION ALL SELECT b.id, b.p, 'update_postimage' FROM a JOIN b USING (id) WHERE a.p <> b.p""",
)
def gold_recompute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold table recomputed with another model, and its change feed."""
    lake = new_lake(spark)
    orders = table(spark, sf_dir, "orders")
    lake.create_if_absent("gold", T.StructType.fromDDL("id bigint, prediction double"), ["id"])
    for limit in (100000, 150000):
        prediction = (F.col("o_totalprice") > limit).cast("double")
        lake.overwrite("gold", orders.select(F.col("o_orderkey").alias("id"), prediction.alias("prediction")))
    return lake.changes("gold", 1).drop("_commit_version")


# -- profiles -------------------------------------------------------------------------------------

_PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql(column: str, rows: str, by: str = "") -> str:
    over = f" GROUP BY {by.rstrip(', ')}" if by else ""
    return f"""SELECT {by}'{column}' AS "column", count(*) AS rows, count(*) FILTER ({column} IS NULL) AS nulls,
  count(*) FILTER ({column} = 0) AS zeros, CAST(0 AS BIGINT) AS nans, round(avg({column}), 8) AS mean,
  round(stddev_samp({column}), 4) AS sd, min({column}) AS min, max({column}) AS max,
  count(DISTINCT {column}) AS n_distinct, round(quantile_cont({column}, 0.25), 4) AS q25,
  round(quantile_cont({column}, 0.5), 4) AS q50, round(quantile_cont({column}, 0.75), 4) AS q75
FROM {rows}{over}"""


def _rounded(df: DataFrame) -> DataFrame:
    # eight digits for means: fewer would put means of few cents on a rounding edge
    rounded = {c: r6(c, 4) for c in ("sd", "q25", "q50", "q75")}
    return df.withColumns({"mean": r6("mean", 8), **rounded})


@query("profile_snapshot", " UNION ALL ".join(_profile_sql(c, "lineitem") for c in _PROFILED))
def profile_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(monitor.monitor(table(spark, sf_dir, "lineitem"), "order_features", columns=_PROFILED))


@query("profile_snapshot_approx")
def profile_snapshot_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches in a single pass, for tables where exact quartiles are not worth a shuffle."""
    return monitor.profile(table(spark, sf_dir, "lineitem"), _PROFILED, quantiles="approx")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("inference_timestamp"),
        F.col("value").alias("prediction"),
        F.col("event_type").alias("model_version"),
    )


_LOG_SQL = """log AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, value AS prediction,
  event_type AS model_version FROM events)"""


@query("profile_daily", f"WITH {_LOG_SQL} " + _profile_sql("prediction", "log", "day, model_version, "))
def profile_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.monitor(_log(spark, sf_dir), "inference_results", problem_type="regression")
    return _rounded(out).withColumn("day", day_text("day"))


@query(
    "class_distribution_daily",
    """WITH c AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS model_version,
  CAST(value > 50 AS INTEGER) AS prediction, count(*) AS n FROM events GROUP BY ALL)
SELECT *, round(n / CAST(sum(n) OVER (PARTITION BY day, model_version) AS DOUBLE), 6) AS share FROM c""",
)
def class_distribution_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("prediction", (F.col("prediction") > 50).cast("int"))
    out = monitor.monitor(log, "inference_results")
    return out.withColumns({"day": day_text("day"), "share": r6("share")})


_METRICS = ["rows", "nulls", "mean", "sd"]


@query(
    "monitor_metric_table",
    " UNION ALL ".join(
        f"""SELECT 'lineitem' AS "table", 'all' AS "window", '{c}' AS "column", '{m}' AS metric,
        CAST({e} AS DOUBLE) AS value FROM lineitem"""
        for c in _PROFILED
        for m, e in {
            "rows": "count(*)",
            "nulls": f"count(*) FILTER ({c} IS NULL)",
            "mean": f"round(avg({c}), 4)",
            "sd": f"round(stddev_samp({c}), 4)",
        }.items()
    ),
)
def monitor_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile rows upserted twice into the metric table."""
    lake = new_lake(spark)
    profiled = monitor.profile(table(spark, sf_dir, "lineitem"), _PROFILED, quantiles="none")
    profiled = profiled.withColumns({c: r6(c, 4) for c in ("mean", "sd")})
    rows = monitor.as_metric_rows(profiled, "lineitem", F.lit("all"), _METRICS)
    lake.create_if_absent("profile_metrics", rows.schema, ["table", "window", "column", "metric"])
    for _ in range(2):
        lake.upsert("profile_metrics", rows)
    return lake.read("profile_metrics")


# -- drift ----------------------------------------------------------------------------------------


def _year(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    # a range on the column itself reaches the parquet reader, a function of it does not
    first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
    shipped = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").filter((shipped >= first) & (shipped < after))


_WIDTH = 10500.0
_HIST_SQL = """h AS (SELECT CAST(floor(l_extendedprice / 10500) AS INTEGER) AS bin,
  count(*) FILTER (year(l_shipdate) = 1996) AS base, count(*) FILTER (year(l_shipdate) = 1999) AS cur
  FROM lineitem WHERE year(l_shipdate) IN (1996, 1999) GROUP BY 1)"""
_SHARE_SQL = """s AS (SELECT base, cur, base / CAST(sum(base) OVER () AS DOUBLE) AS p,
  cur / CAST(sum(cur) OVER () AS DOUBLE) AS q, sum(cur) OVER () AS nc FROM h)"""
_PSI_SQL = "sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4)))"
_JS_SQL = """sqrt(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)"""


def _price_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the price range is split at multiples of a fixed width
    edges = monitor.fixed_width_edges(0.0, 210000.0, _WIDTH)
    return monitor.binned_drift(
        _year(spark, sf_dir, 1996), _year(spark, sf_dir, 1999), {"l_extendedprice": edges}
    )


@query(
    "drift_psi",
    f"""WITH {_HIST_SQL}, {_SHARE_SQL} SELECT 'l_extendedprice' AS "column", round({_PSI_SQL}, 6) AS psi FROM s""",
)
def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_drift(spark, sf_dir).select("column", r6("psi").alias("psi"))


@query(
    "drift_js",
    f"""WITH {_HIST_SQL}, {_SHARE_SQL} SELECT 'l_extendedprice' AS "column", round({_JS_SQL}, 6) AS js FROM s""",
)
def drift_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _price_drift(spark, sf_dir).select("column", r6("js").alias("js"))


@query(
    "drift_decile_psi",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH b AS (SELECT {c} AS v, year(l_shipdate) AS y FROM lineitem WHERE year(l_shipdate) IN (1996, 1999)),
e AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM b WHERE y = 1996),
h AS (SELECT len(list_filter(e, lambda x: x <= v)) AS bin, count(*) FILTER (y = 1996) AS base,
  count(*) FILTER (y = 1999) AS cur FROM b, e GROUP BY 1), {_SHARE_SQL}
SELECT '{c}' AS "column", round({_PSI_SQL}, 6) AS psi, round({_JS_SQL}, 6) AS js FROM s)"""
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def drift_decile_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins from the baseline's exact deciles, two columns in one pass."""
    out = monitor.numeric_drift(
        _year(spark, sf_dir, 1996), _year(spark, sf_dir, 1999), ["l_quantity", "l_extendedprice"]
    )
    return out.select("column", r6("psi").alias("psi"), r6("js").alias("js"))


@query("drift_approx_edges")
def drift_approx_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline edges from sketches, then one pass: no values are shuffled."""
    before = _year(spark, sf_dir, 1996)
    edges = monitor.approx_edges(before, ["l_quantity", "l_extendedprice"])
    return monitor.binned_drift(before, _year(spark, sf_dir, 1999), edges)


def _event_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    views, clicks = (events.filter(F.col("event_type") == kind) for kind in ("view", "click"))
    return monitor.distribution_distances(views, clicks, ["value"])


_CDF_SQL = """c AS (SELECT value, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'click') AS k
  FROM events WHERE event_type IN ('view', 'click') GROUP BY value),
f AS (SELECT value, abs(sum(b) OVER w / CAST(sum(b) OVER () AS DOUBLE) - sum(k) OVER w / CAST(sum(k) OVER () AS DOUBLE)) AS gap,
  lead(value) OVER w - value AS step FROM c WINDOW w AS (ORDER BY value))"""


@query("drift_ks", f"""WITH {_CDF_SQL} SELECT 'value' AS "column", round(max(gap), 6) AS ks FROM f""")
def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_sides(spark, sf_dir).select("column", r6("ks").alias("ks"))


@query(
    "drift_wasserstein",
    f"""WITH {_CDF_SQL} SELECT 'value' AS "column", round(sum(gap * coalesce(step, 0)), 6) AS wasserstein FROM f""",
)
def drift_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_sides(spark, sf_dir).select("column", r6("wasserstein").alias("wasserstein"))


_CATEGORY_SQL = f"""round(sum(CASE WHEN base > 0 THEN (cur - p * nc) * (cur - p * nc) / (p * nc) END), 4) AS chi_square,
  count(*) FILTER (base > 0) - 1 AS df, CAST(coalesce(sum(cur) FILTER (base = 0), 0) AS BIGINT) AS unseen,
  round(sum(abs(q - p)) / 2, 6) AS total_variation, round(max(abs(q - p)), 6) AS l_infinity,
  round({_PSI_SQL}, 6) AS psi, round({_JS_SQL}, 6) AS js"""


def _category_rounded(df: DataFrame) -> DataFrame:
    rounded = {c: r6(c) for c in ("total_variation", "l_infinity", "psi", "js")}
    return df.withColumns({"chi_square": r6("chi_square", 4), **rounded})


@query(
    "drift_categorical",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH h AS (SELECT {c}, count(*) FILTER (year(l_shipdate) = 1996) AS base,
  count(*) FILTER (year(l_shipdate) = 1999) AS cur FROM lineitem WHERE year(l_shipdate) IN (1996, 1999) GROUP BY 1),
{_SHARE_SQL} SELECT '{c}' AS "column", {_CATEGORY_SQL} FROM s)"""
        for c in ("l_returnflag", "l_linestatus")
    ),
)
def drift_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = monitor.categorical_drift(
        _year(spark, sf_dir, 1996), _year(spark, sf_dir, 1999), ["l_returnflag", "l_linestatus"]
    )
    return _category_rounded(out)


@query(
    "drift_consecutive",
    f"""WITH n AS (SELECT date_trunc('day', ts) AS day, event_type AS v, count(*) AS n FROM events GROUP BY ALL),
d AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev FROM (SELECT DISTINCT day FROM n)),
h AS (SELECT day, v, sum(base) AS base, sum(cur) AS cur FROM (
    SELECT d.day, n.v, n.n AS base, 0 AS cur FROM d JOIN n ON n.day = d.prev
    UNION ALL SELECT d.day, n.v, 0, n.n FROM d JOIN n ON n.day = d.day WHERE d.prev IS NOT NULL) GROUP BY ALL),
s AS (SELECT day, base, cur, base / CAST(sum(base) OVER w AS DOUBLE) AS p, cur / CAST(sum(cur) OVER w AS DOUBLE) AS q,
  sum(cur) OVER w AS nc FROM h WINDOW w AS (PARTITION BY day))
SELECT strftime(day, '%Y-%m-%d') AS day, {_CATEGORY_SQL} FROM s GROUP BY day""",
)
def drift_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's event mix against the day before."""
    daily = monitor.with_day(table(spark, sf_dir, "events").select("ts", "event_type"), "ts")
    out = monitor.consecutive_drift(daily, "day", "event_type")
    return _category_rounded(out).withColumn("day", day_text("day"))


# -- fairness and documentation -------------------------------------------------------------------

_GROUP_SQL = f"""{LABELLED_SQL}, g AS (SELECT lang AS "group", count(*) AS rows,
  avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
  count(*) FILTER (label = 0 AND prediction = 1) / CAST(nullif(count(*) FILTER (label = 0), 0) AS DOUBLE) AS fpr,
  count(*) FILTER (label = 1 AND prediction = 0) / CAST(nullif(count(*) FILTER (label = 1), 0) AS DOUBLE) AS fnr
  FROM labelled GROUP BY lang),
m AS (SELECT "group", 'accuracy' AS metric, accuracy AS value, 0.05 AS lim FROM g
  UNION ALL SELECT "group", 'fpr', fpr, 0.05 FROM g UNION ALL SELECT "group", 'fnr', fnr, NULL FROM g)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairness.group_metrics(labelled_documents(spark, sf_dir), "lang", "label", "prediction")


@query(
    "group_fairness",
    f"""WITH {_GROUP_SQL} SELECT "group", rows, round(accuracy, 6) AS accuracy, round(fpr, 6) AS fpr,
  round(fnr, 6) AS fnr FROM g""",
)
def group_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).withColumns({c: r6(c) for c in fairness.METRICS})


@query(
    "fairness_gaps",
    f"""WITH {_GROUP_SQL} SELECT metric, list("group" ORDER BY value, "group")[1] AS lowest, list("group" ORDER BY value DESC, "group" DESC)[1] AS highest,
  round(max(value) - min(value), 6) AS difference,
  CASE WHEN max(value) - min(value) <= any_value(lim) THEN 'Yes' WHEN any_value(lim) IS NOT NULL THEN 'No' END AS acceptable
FROM m WHERE value IS NOT NULL GROUP BY metric""",
)
def fairness_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairness.fairness_gaps(_groups(spark, sf_dir)).withColumn("difference", r6("difference"))


@query(
    "fairness_pairs",
    f"""WITH {_GROUP_SQL} SELECT a.metric, a."group" AS group_a, b."group" AS group_b,
  round(a.value, 6) AS value_a, round(b.value, 6) AS value_b, round(abs(a.value - b.value), 6) AS difference,
  CASE WHEN abs(a.value - b.value) <= a.lim THEN 'Yes' WHEN a.lim IS NOT NULL THEN 'No' END AS acceptable
FROM m a JOIN m b ON a.metric = b.metric AND a."group" < b."group"
WHERE a.value IS NOT NULL AND b.value IS NOT NULL""",
)
def fairness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fairness.group_pairs(_groups(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("value_a", "value_b", "difference")})


@query(
    "fairness_reference",
    f"""WITH {_GROUP_SQL}, r AS (SELECT "group" AS reference FROM g WHERE "group" IS NOT NULL ORDER BY rows DESC, "group" LIMIT 1)
SELECT a.metric, a."group", r.reference, round(a.value, 6) AS value, round(b.value, 6) AS reference_value,
  round(a.value - b.value, 6) AS difference,
  CASE WHEN abs(a.value - b.value) <= a.lim THEN 'Yes' WHEN a.lim IS NOT NULL THEN 'No' END AS acceptable
FROM r JOIN m b ON b."group" = r.reference JOIN m a ON a.metric = b.metric AND a."group" IS DISTINCT FROM r.reference
WHERE a.value IS NOT NULL AND b.value IS NOT NULL""",
)
def fairness_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fairness.against_reference(_groups(spark, sf_dir))
    return out.withColumns({c: r6(c) for c in ("value", "reference_value", "difference")})


@query(
    "training_data_summary",
    """SELECT count(*) AS rows, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen,
  strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM lineitem""",
)
def training_data_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fairness.training_data_summary(table(spark, sf_dir, "lineitem"), "l_shipdate")
    return out.withColumns({c: day_text(c) for c in ("first_seen", "last_seen")})


@query(
    "performance_vs_threshold",
    f"""WITH {LABELLED_SQL}, {f1_sql('prediction')},
s AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM labelled GROUP BY score),
c AS (SELECT p, n, sum(n) OVER (ORDER BY score) - n AS below FROM s),
t AS (SELECT 'accuracy' AS metric, accuracy AS value, 0.6::DOUBLE AS threshold FROM scores
  UNION ALL SELECT 'f1_score', f1_score, 0.6::DOUBLE FROM scores
  UNION ALL SELECT 'roc_auc', sum(p * (below + n / 2.0::DOUBLE)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 0.5::DOUBLE FROM c)
SELECT metric, round(value, 6) AS value, threshold, CAST(value >= threshold AS INTEGER) AS met FROM t""",
)
def performance_vs_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_documents(spark, sf_dir)
    scores = metrics.classification_scores(metrics.confusion_matrix(rows, "label", "prediction"))
    # one row beside one row
    scores = scores.withColumn("roc_auc", metrics.roc_auc(rows, "label", "score").select("roc_auc").scalar())
    out = fairness.performance_vs_threshold(scores, {"accuracy": 0.6, "f1_score": 0.6, "roc_auc": 0.5})
    return out.withColumns({"value": r6("value"), "met": F.col("met").cast("int")})


# -- runs, versions, aliases, promotion -----------------------------------------------------------


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run per order, a model per priority; versions of cheap orders have no run."""
    orders = table(spark, sf_dir, "orders")
    kind = (
        F.when(F.col("o_orderstatus") == "F", "RandomForestClassifier")
        .when(F.col("o_orderstatus") == "O", "KMeans")
        .otherwise("external")
    )
    run_id = F.col("o_orderkey").cast("string")
    runs = orders.select(
        run_id.alias("run_id"),
        F.create_map(F.lit("model_type"), kind).alias("params"),
        F.create_map(F.lit("total"), F.col("o_totalprice")).alias("metrics"),
    )
    versions = orders.select(
        F.col("o_orderpriority").alias("model"),
        (F.col("o_orderkey") + 1).cast("string").alias("version"),
        F.when(F.col("o_totalprice") > 50000, run_id).alias("run_id"),
    )
    return runs, versions


@query(
    "challenger_select",
    """SELECT o_orderpriority AS model, CAST(max(o_orderkey + 1) AS VARCHAR) AS version
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 50000 GROUP BY 1""",
)
def challenger_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions held as text still compare as numbers."""
    runs, versions = _runs(spark, sf_dir)
    kind = registry.PIPELINE_MODEL_TYPES["classification"]
    return registry.challenger_versions(versions, runs, kind).select("model", "version")


@query(
    "alias_resolve",
    """SELECT event_type AS model, CASE WHEN value > 50 THEN 'champion' ELSE 'shadow' END AS alias,
  arg_max(event_id, ts) AS version FROM events GROUP BY 1, 2""",
)
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.when(F.col("value") > 50, "champion").otherwise("shadow").alias("alias"),
        F.col("event_id").alias("version"),
        F.col("ts").alias("set_at"),
    )
    return registry.resolve_aliases(aliases)


@query(
    "promotion_decision",
    f"""WITH {LABELLED_SQL}, stacked AS (
  SELECT lang AS model, 'challenger' AS side, label, prediction FROM labelled
  UNION ALL SELECT lang, 'champion', label, prediction_b FROM labelled),
{f1_sql('prediction', 'stacked', 'model, side, ')}
SELECT n.model, CAST(2 AS BIGINT) AS challenger_version, round(n.f1_score, 6) AS challenger_score,
  CASE WHEN o.model IS NOT NULL THEN CAST(1 AS BIGINT) END AS champion_version,
  round(o.f1_score, 6) AS champion_score,
  CAST(CASE WHEN o.model IS NULL OR o.model = 'de' THEN true ELSE n.f1_score >= o.f1_score END AS INTEGER) AS promote
FROM (SELECT * FROM scores WHERE side = 'challenger') n
LEFT JOIN (SELECT * FROM scores WHERE side = 'champion' AND model <> 'fr') o ON n.model = o.model""",
)
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model per language: one without a champion, one whose champion cannot be loaded."""
    rows = labelled_documents(spark, sf_dir)
    stacked = metrics.stack_predictions(
        rows.withColumnRenamed("lang", "name"),
        {"challenger": "prediction", "champion": "prediction_b"},
        ["name", "label"],
    )
    by = ["name", "model"]
    scores = metrics.classification_scores(
        metrics.confusion_matrix(stacked, "label", "prediction", by), by
    ).select(F.col("name"), F.col("model").alias("side"), "f1_score")
    new = scores.filter("side = 'challenger'").select(
        F.col("name").alias("model"), F.lit(2).cast("bigint").alias("version"), "f1_score"
    )
    old = scores.filter("side = 'champion' AND name <> 'fr'").select(
        F.col("name").alias("model"),
        F.lit(1).cast("bigint").alias("version"),
        "f1_score",
        (F.col("name") != "de").alias("loadable"),
    )
    out = champion.promotion_decisions(new, old, *champion.DECIDING["classification"])
    return out.withColumns(
        {
            "challenger_score": r6("challenger_score"),
            "champion_score": r6("champion_score"),
            "promote": F.col("promote").cast("int"),
        }
    )


@query(
    "run_log_roundtrip",
    """SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'RandomForestClassifier'
  WHEN 'O' THEN 'KMeans' ELSE 'external' END AS model_type, o_totalprice AS total, year(o_orderdate) AS step,
  o_totalprice / 2 AS half
FROM orders""",
)
def run_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and a stepped metric recorded in two parts, read back as columns."""
    records = registry.Registry(new_lake(spark))
    runs, _ = _runs(spark, sf_dir)
    steps = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.lit("half").alias("key"),
        F.year("o_orderdate").cast("bigint").alias("step"),
        (F.col("o_totalprice") / 2).alias("value"),
    )
    for early in (True, False):
        records.log_runs(
            runs.filter((F.col("metrics")["total"] < 250000) == early), steps.filter((F.col("step") < 1998) == early)
        )
    flat = registry.flatten_runs(records.table("runs"), ["model_type"], ["total"])
    history = records.table("run_metric_history").select("run_id", "step", F.col("value").alias("half"))
    return flat.join(history, "run_id", "left")


@query(
    "registry_parallel",
    """WITH y AS (SELECT o_orderstatus AS model, year(o_orderdate) AS step, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
t AS (SELECT model, count(*) AS steps, round(sum(total), 2) AS total, max(step) AS last FROM y GROUP BY model)
SELECT model, CAST(3 AS BIGINT) AS versions, CAST(3 AS BIGINT) AS newest, CAST(3 AS BIGINT) AS runs, 3 * steps AS points,
  total, CAST(2 AS BIGINT) AS champion, model || '-model' AS path, CAST(3 AS BIGINT) AS challenger FROM t""",
)
def registry_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three registrations at once of a model per order status: runs, stepped metrics, versions, alias, look-up."""
    records = registry.Registry(new_lake(spark))
    yearly = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("model"), F.year("o_orderdate").alias("step"))
        .agg(F.sum("o_totalprice").alias("total"))
    )
    curves: dict[str, list] = {}
    for row in yearly.orderBy("step").collect():  # statuses x years
        curves.setdefault(row["model"], []).append((row["step"], row["total"]))

    def train(model: str) -> int:
        total = sum(value for _, value in curves[model])
        run = records.log_run({"model_type": "KMeans"}, {"total": total}, {"yearly": curves[model]})
        return records.register_version(model, run, f"{model}-model")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(inheritable_thread_target(spark)(train), [m for m in curves for _ in range(3)]))
    found = []
    for model in curves:
        records.set_alias(model, "champion", 1)
        records.set_alias(model, "champion", 2)
        aliased = records.alias_version(model)
        found.append((model, aliased, records.version(model, aliased).path, records.challenger(model, "KMeans")))
    loaded = spark.createDataFrame(found, "model string, champion bigint, path string, challenger bigint")
    versions = records.table("model_versions").select("model", "version", "run_id")
    points = records.table("run_metric_history").groupBy("run_id").agg(F.count("step").alias("points"))
    runs = registry.flatten_runs(records.table("runs"), [], ["total"])
    counted = versions.join(runs, "run_id").join(points, "run_id").groupBy("model").agg(
        F.count_distinct("version").alias("versions"),
        F.max("version").alias("newest"),
        F.count_distinct("run_id").alias("runs"),
        F.sum("points").alias("points"),
        r6(F.max("total"), 2).alias("total"),
    )
    return counted.join(loaded, "model")


# -- jobs from end to end -------------------------------------------------------------------------

_VALID_IDS_SQL = f"""{RAW_SQL}, valid AS (SELECT DISTINCT id FROM raw WHERE id IS NOT NULL AND event_timestamp IS NOT NULL)"""


def _feature_project(spark: SparkSession, sf_dir: str) -> tuple[jobs.Project, DataFrame]:
    """A project whose ``features`` come from the valid raw rows, and those rows."""
    cleaned = quality.clean(raw_rows(spark, sf_dir), ["id"], INGEST_RULES, sequence="validate_first")
    cleaned = materialize(cleaned, "cleaned")
    project = jobs.Project.at(new_lake(spark))
    jobs.build_features(project, cleaned, "features", buckets=2)
    return project, cleaned


@query(
    "job_scored",
    f"""WITH {_VALID_IDS_SQL} SELECT id, 1 AS known_class, 1 AS stamped, 'champion' AS model_version,
  CAST(1 AS BIGINT) AS resolved_version, 'feature_1:double,feature_2:double,feature_3:int' AS inputs, 1 AS promoted FROM valid""",
)
def job_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, training, promotion and scoring in turn: one stamped prediction per input row."""
    project, cleaned = _feature_project(spark, sf_dir)
    labels = cleaned.select("id", (F.col("value_1") > 30000).cast("int").alias("target"))
    version = jobs.train_classification(project, labels, "features", "large", num_trees=10, max_depth=8)
    promotion = jobs.evaluate_classification(project, labels, "features", "large")
    jobs.batch_score(project, "features", "large")
    scored = project.lake.read("inference_results")
    quality.check_scored(project.lake.read("features"), scored)
    inputs = json.loads(project.registry.version("large", version).signature)
    return scored.select(
        "id",
        F.col("prediction").isin(0.0, 1.0).cast("int").alias("known_class"),
        F.col("inference_timestamp").isNotNull().cast("int").alias("stamped"),
        "model_version",
        "resolved_version",
        F.lit(",".join(f"{name}:{kind}" for name, kind in inputs)).alias("inputs"),
        F.lit(int(promotion.promoted)).alias("promoted"),
    )


@query(
    "job_clusters",
    f"""WITH {_VALID_IDS_SQL} SELECT k, 1 AS falls, n.rows, 3 AS n_clusters, 1 AS silhouette_in_range
FROM (VALUES (2), (3), (4)) AS t(k), (SELECT count(*) AS rows FROM valid) n""",
)
def job_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clustering job: inertia that falls with the clusters, as many clusters as asked for, every row in one."""
    project, _ = _feature_project(spark, sf_dir)
    version = jobs.train_clustering(project, "features", "groups", k=3, restarts=2, elbow=[2, 3, 4])
    stored = project.registry.version("groups", version)
    assigned = kmeans.predict(project.lake.read("features"), PipelineModel.load(stored.path))
    known = assigned.agg(F.count_if(F.col("cluster").between(0, 2)).alias("rows"))
    run = project.registry.table("runs").filter(F.col("run_id") == stored.run_id)
    metric, points = F.col("metrics"), project.registry.table("run_metric_history").filter(F.col("run_id") == stored.run_id)
    facts = run.select(
        metric["n_clusters"].cast("int").alias("n_clusters"),
        metric["silhouette_score"].between(-1, 1).cast("int").alias("silhouette_in_range"),
    )
    # a handful of steps
    before = F.lag("value").over(Window.orderBy("step"))
    falls = F.coalesce(F.col("value") <= before, F.lit(True)).cast("int")
    return points.select(
        F.col("step").cast("int").alias("k"),
        falls.alias("falls"),
        known.scalar().alias("rows"),
        facts.select("n_clusters").scalar().alias("n_clusters"),
        facts.select("silhouette_in_range").scalar().alias("silhouette_in_range"),
    )


_REPORTED = {"l_orderkey": "bigint", "l_linenumber": "int", "l_extendedprice": "double", "l_returnflag": "string", "l_shipdate": "timestamp_ntz"}


@query(
    "schema_report",
    "\nUNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{kind}' AS type, count(*) - count({c}) AS nulls FROM lineitem"
        for i, (c, kind) in enumerate(_REPORTED.items())
    ),
)
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, type and nulls of each column."""
    rows = table(spark, sf_dir, "lineitem").select(*_REPORTED)
    return quality.schema_rows(rows).drop("nullable").join(quality.null_counts(rows), "column")


# -- daily sketches and incremental runs ----------------------------------------------------------

_SKETCHED = ["l_quantity", "l_extendedprice"]
_SHARES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
_RANK_ERROR = 0.02  # of ranks, well above that of the sketches


@query(
    "sketch_windows",
    " UNION ALL ".join(
        f"""SELECT year(l_shipdate)::INTEGER AS year, '{c}' AS "column", count({c}) AS n, min({c}) AS low, max({c}) AS high,
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, {len(_SHARES)}::BIGINT AS within FROM lineitem GROUP BY ALL"""
        for c in _SKETCHED
    ),
)
def sketch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years added up from daily sketches, and how many of their quantiles have the rank they claim among the rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", *_SKETCHED)
    daily = sketches.daily_sketches(rows, "l_shipdate", _SKETCHED)
    whole = sketches.merged(daily.withColumn("year", F.year("day")), ["year", "column"])
    whole = sketches.sketch_quantiles(whole, _SHARES).drop("sketch")
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in _SKETCHED]))
    claimed = whole.select("year", "column", *_SHARES)
    # a row per year and column
    met = rows.select(F.year("l_shipdate").alias("year"), pairs).join(F.broadcast(claimed), ["year", "column"])
    ranks = [f(F.col("value"), F.col(q)).cast("double").alias(f"{n}_{q}") for q in _SHARES for n, f in (("under", lambda v, q: v < q), ("upto", lambda v, q: v <= q))]
    shares = met.groupBy("year", "column").agg(*[F.avg(r).alias(n) for r, n in zip(ranks, [f"{n}_{q}" for q in _SHARES for n in ("under", "upto")], strict=True)])
    holds = [((F.col(f"under_{q}") <= p + _RANK_ERROR) & (F.col(f"upto_{q}") >= p - _RANK_ERROR)).cast("bigint") for q, p in _SHARES.items()]
    checked = shares.select("year", "column", sum(holds, F.lit(0)).cast("bigint").alias("within"))
    return whole.join(checked, ["year", "column"]).select("year", "column", "n", "low", "high", r6("mean", 4).alias("mean"), r6("sd", 4).alias("sd"), "within")


@query(
    "sketch_drift",
    f"""WITH {_CDF_SQL} SELECT 'value' AS "column", count(*) FILTER (false) AS far, round(max(gap), 6) AS ks FROM f""",
)
def sketch_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact KS of two windows, and whether the one from daily sketches is more than four rank errors away."""
    events = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    daily = sketches.daily_sketches(events, "ts", ["value"], by=["event_type"])
    sides = [daily.where(F.col("event_type") == kind) for kind in ("view", "click")]
    near = sketches.sketch_drift(*sides).select("column", F.col("ks").alias("near"))
    exact = _event_sides(spark, sf_dir).select("column", "ks")
    far = (F.abs(F.col("ks") - F.col("near")) > 2 * _RANK_ERROR).cast("bigint")
    return exact.join(near, "column").select("column", F.coalesce(far, F.lit(1)).alias("far"), r6("ks").alias("ks"))


_LATE_SQL = """e AS (SELECT event_id, ts, CASE WHEN event_id = 7 THEN value + 1000 ELSE value END AS value FROM events)"""


@query(
    "monitor_increment",
    f"""WITH {_LATE_SQL}, late AS (SELECT CAST(ts AS DATE) AS day FROM e WHERE event_id = 7)
    SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS rows, count(value) AS n, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high,
      CASE WHEN CAST(ts AS DATE) IN (SELECT day FROM late) THEN 2 ELSE 1 END::BIGINT AS as_of
    FROM e GROUP BY CAST(ts AS DATE)""",
)
def monitor_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily profiles after a first run, a run over unchanged data, and a run after one row came late."""
    project = jobs.Project.at(new_lake(spark))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    project.lake.create_if_absent("log", events.schema, ["event_id"], buckets=8)
    project.lake.overwrite("log", events)
    jobs.monitor_changes(project, "log", "ts", ["value"])
    if jobs.monitor_changes(project, "log", "ts", ["value"]):
        raise AssertionError("a run over unchanged data profiled days")
    project.lake.upsert("log", events.where("event_id = 7").withColumn("value", F.col("value") + 1000))
    jobs.monitor_changes(project, "log", "ts", ["value"])
    return project.lake.read(jobs.DAILY).select("day", "rows", "n", r6("total", 2).alias("total"), "low", "high", "as_of")


def rule_model(project: jobs.Project, name: str, rule: str, inputs: list[tuple[str, str]]) -> int:
    """Register a model that predicts by an SQL expression, as champion; returns its version."""
    path = project.new_model_path(name)
    PipelineModel([SQLTransformer(statement=f"SELECT *, CAST({rule} AS DOUBLE) AS prediction FROM __THIS__")]).save(path)
    run = project.registry.log_run({"model_type": registry.PIPELINE_MODEL_TYPES["classification"]}, {})
    version = project.registry.register_version(name, run, path, inputs)
    project.registry.set_alias(name, "champion", version)
    return version


@query(
    "incremental_gold",
    """WITH f AS (SELECT o_orderkey AS id, o_custkey % 10 = 0 AS late, CASE WHEN o_custkey % 10 = 0 THEN 2 ELSE 1 END * o_totalprice AS v FROM orders)
SELECT id, CAST(v > 150000 AS DOUBLE) AS prediction, CASE WHEN late THEN '2024-06-02' ELSE '2024-06-01' END AS scored_on,
  'champion' AS model_version, 1::BIGINT AS resolved_version FROM f""",
)
def incremental_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold after a first run, a run with nothing new, and one after a tenth of the customers' orders changed."""
    project = jobs.Project.at(new_lake(spark))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("value"))
    project.lake.create_if_absent("o_features", orders.schema, ["id"], buckets=8)
    project.lake.upsert("o_features", orders)
    rule_model(project, "m", "value > 150000", [("value", "double")])

    def run(day: str) -> int:
        return jobs.score_changes(project, "o_features", "m", now=F.lit(f"{day} 12:00:00").cast("timestamp"), buckets=8)

    run("2024-06-01")
    if run("2024-06-02"):
        raise AssertionError("a run over unchanged data scored rows")
    project.lake.upsert("o_features", orders.where("customer % 10 = 0").withColumn("value", 2 * F.col("value")))
    run("2024-06-02")
    gold = project.lake.read("inference_results")
    return gold.select("id", "prediction", day_text("inference_timestamp").alias("scored_on"), "model_version", "resolved_version")
