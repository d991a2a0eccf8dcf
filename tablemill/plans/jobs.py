"""The jobs of a project, end to end: features, training, promotion, scoring, monitoring.

Each job is a function over a :class:`Project`; call them in the order the data flows. Rows stay in
DataFrames throughout: what reaches the driver is one row of metrics per model.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, IllegalArgumentException, PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.vector import as_array
from tablemill.models import classifier, kmeans, series
from tablemill.operators import clusters, metrics, monitor, scoring, sketches
from tablemill.operators.champion import DECIDING, decide
from tablemill.operators.features import (
    NON_FEATURES,
    engineer_features,
    numeric_features,
    signature,
    split_train_test,
    with_split,
)
from tablemill.operators.lookup import Lookup, training_set
from tablemill.session import materialize
from tablemill.sources.files import MISFITS, settled_schema
from tablemill.sources.lake import Lake
from tablemill.sources.registry import PIPELINE_MODEL_TYPES, Registry
from tablemill.streaming.ingest import bronze, silver

FEATURE_KEY = "id"

#: What Spark reports of a saved model that is not there, or not one.
BROKEN_FILES = ("FAILED_READ_FILE.FILE_NOT_EXIST", "FAILED_READ_FILE.CANNOT_READ_FILE_FOOTER")
BROKEN_MODEL = ("FileNotFoundException", "InvalidInputException", "AnalysisException", "ClassNotFoundException", "MappingException", "JsonParseException", "NoSuchElementException")


@dataclass(frozen=True)
class Project:
    """Tables, run and model tables, and the folder that holds saved models."""

    lake: Lake
    registry: Registry
    models: str

    @classmethod
    def at(cls, lake: Lake) -> Project:
        return cls(lake, Registry(lake), f"{lake.root.rstrip('/')}/{lake.catalog}/{lake.schema}/models")

    def new_model_path(self, model: str) -> str:
        return f"{self.models}/{model}/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Promotion:
    """What an evaluation found and did."""

    challenger: int
    champion: int | None
    challenger_metrics: dict[str, float]
    champion_metrics: dict[str, float] | None
    promoted: bool


# -- ingestion and features -----------------------------------------------------------------------


def ingest(
    project: Project,
    source: str,
    schema: T.StructType | None = None,
    raw: str = "raw_data",
    cleaned: str = "cleaned_data",
    max_files_per_trigger: int | None = None,
    **cleaning,
) -> None:
    """Drain new CSV files below ``source`` into the raw table, and that into the cleaned table.

    Without ``schema`` it is inferred on the first call, kept beside the checkpoint and widened by
    columns that later files add on the right. Values that do not fit are kept in the raw table's
    ``_misfits`` column; the cleaned table has none. ``cleaning`` goes to
    :func:`tablemill.streaming.ingest.clean_stream`. A repeated call takes up the files that have
    arrived since.
    """
    lake = project.lake
    if schema is None:
        schema = settled_schema(lake.spark, source, lake.checkpoint_path(raw) + "-schema")
    kept = T.StructType([*schema.fields, T.StructField(MISFITS, T.MapType(T.StringType(), T.StringType()))])
    tidy = T.StructType([*schema.fields, T.StructField("processed_timestamp", T.TimestampType())])
    lake.create_if_absent(raw, kept, comment="rows as they came", properties={"quality": "bronze"}, stream=True)
    lake.create_if_absent(
        cleaned, tidy, comment="valid rows, one per key", properties={"quality": "silver"}, stream=True
    )
    lake.widen(raw, kept)
    lake.widen(cleaned, tidy)
    raw_path = lake.stream_path(raw)
    bronze(
        lake.spark, source, raw_path, lake.checkpoint_path(raw), schema, max_files_per_trigger, keep_misfits=True
    )
    silver(
        lake.spark,
        raw_path,
        lake.stream_path(cleaned),
        lake.checkpoint_path(cleaned),
        schema,
        max_files_per_trigger,
        **cleaning,
    )



def build_features(
    project: Project, cleaned: DataFrame, table: str, now: Column | None = None, buckets: int = 1
) -> int:
    """Engineer features and merge them into the feature table; returns its version."""
    made = engineer_features(cleaned, now)
    project.lake.create_if_absent(
        table, made.schema, [FEATURE_KEY], buckets, comment="engineered features"
    )
    return project.lake.upsert(table, made)


def _frame(project: Project, entities: DataFrame, table: str, label: str | None) -> DataFrame:
    return training_set(entities, [Lookup(project.lake.read(table), FEATURE_KEY)], label)


# -- classification -------------------------------------------------------------------------------


def train_classification(
    project: Project,
    labels: DataFrame,
    table: str,
    model: str,
    target: str = "target",
    num_trees: int = classifier.NUM_TREES,
    max_depth: int = 30,
    max_rows: int = classifier.MAX_ROWS,
) -> int:
    """Fit on 80 % of the labelled rows, measure on the rest, register; returns the version.

    Of more than ``max_rows`` labelled rows about that many are fitted on, chosen by their key.
    """
    frame = _frame(project, labels.select(FEATURE_KEY, target), table, target)
    inputs = numeric_features(frame, [*NON_FEATURES, target])
    train, test = split_train_test(frame.dropna(subset=[target]), FEATURE_KEY)
    fitted = classifier.fit(
        train, target, inputs, num_trees, max_depth=max_depth, keys=[FEATURE_KEY], max_rows=max_rows
    )
    predicted = materialize(
        classifier.predict(test, fitted).select(target, "prediction", "score"), "predicted"
    )
    found = _classification_metrics(predicted, target)
    found["roc_auc"] = metrics.roc_auc(predicted, target, "score").first()["roc_auc"]
    params = {"model_type": PIPELINE_MODEL_TYPES["classification"], "n_estimators": num_trees}
    return _register(project, model, fitted, params, found, signature(frame, inputs))


def _classification_metrics(predicted: DataFrame, target: str) -> dict[str, float]:
    row = metrics.classification_scores(
        metrics.confusion_matrix(predicted, target, "prediction")
    ).first()
    return {"accuracy": row["accuracy"], "f1_score": row["f1_score"]}


def evaluate_classification(
    project: Project,
    labels: DataFrame,
    table: str,
    model: str,
    target: str = "target",
    eval_split: str = "all",
) -> Promotion:
    """Challenger against champion by weighted F1, both scored in one pass.

    ``eval_split="all"`` compares on every labelled row, ``"test"`` on the rows training held out.
    """
    frame = _frame(project, labels.select(FEATURE_KEY, target), table, target)
    frame = frame.dropna(subset=[target])
    if eval_split == "test":
        frame = with_split(frame, FEATURE_KEY).filter("is_test").drop("is_test")

    def compare(candidates: dict[str, PipelineModel]) -> dict[str, dict[str, float]]:
        scored = frame
        for name, fitted in candidates.items():
            out = classifier.predict(scored, fitted).drop("score")
            scored = out.withColumnRenamed("prediction", name)
        rows = metrics.compare_classifiers(scored, target, {n: n for n in candidates}).collect()
        return {r["model"]: {"accuracy": r["accuracy"], "f1_score": r["f1_score"]} for r in rows}

    return _evaluate(project, model, "classification", PipelineModel.load, compare)


# -- clustering -----------------------------------------------------------------------------------


def train_clustering(
    project: Project,
    table: str,
    model: str,
    k: int = kmeans.CLUSTERS,
    restarts: int = kmeans.RESTARTS,
    elbow: Sequence[int] = kmeans.ELBOW,
    silhouette: str = "squared",
) -> int:
    """Elbow curve, best KMeans fit and its quality, registered; returns the version.

    The silhouette takes squared distances, in time linear in the rows; ``silhouette="exact"`` takes plain
    distances and compares all rows with each other.
    """
    frame = project.lake.read(table)
    inputs = numeric_features(frame)
    before = kmeans.preprocess(frame, inputs)
    with kmeans.held_vectors(before.transform(frame)) as vectors:
        fits = kmeans.best_per_k(vectors, sorted({*elbow, k}), restarts)
    fitted = PipelineModel(stages=[*before.stages, fits[k]])
    curve = [(n, fits[n].summary.trainingCost) for n in elbow]
    found = _cluster_metrics(frame, fitted, silhouette)
    found |= {"inertia": fits[k].summary.trainingCost, "n_clusters": k}
    params = {"model_type": PIPELINE_MODEL_TYPES["clustering"], "n_clusters": k}
    inputs_signature = signature(frame, inputs)
    return _register(project, model, fitted, params, found, inputs_signature, {"elbow_inertia": curve})


def _cluster_metrics(
    frame: DataFrame, fitted: PipelineModel, silhouette: str, refit_on: Sequence[str] | None = None
) -> dict[str, float]:
    assigned = kmeans.predict(frame, fitted, refit_on)
    rows = materialize(
        assigned.select("cluster", as_array("features").alias("vector")), "clustered"
    )
    measure = {"exact": clusters.silhouette_exact, "squared": clusters.silhouette_squared}[silhouette]
    return {
        "silhouette_score": measure(rows, "vector", "cluster").first()[0],
        "davies_bouldin_score": clusters.davies_bouldin(rows, "vector", "cluster").first()[0],
    }


def evaluate_clustering(
    project: Project, table: str, model: str, silhouette: str = "squared", refit: bool = False
) -> Promotion:
    """Challenger against champion by silhouette.

    Rows are scaled with each model's saved statistics; ``refit=True`` scales them anew on the
    evaluation rows. Inertia is the value from training.
    """
    frame = project.lake.read(table)
    refit_on = numeric_features(frame) if refit else None

    def compare(candidates: dict[str, PipelineModel]) -> dict[str, dict[str, float]]:
        return {
            name: _cluster_metrics(frame, fitted, silhouette, refit_on)
            for name, fitted in candidates.items()
        }

    return _evaluate(project, model, "clustering", PipelineModel.load, compare)


# -- series ---------------------------------------------------------------------------------------


def _series_rows(
    labels: DataFrame, target: str, order: Sequence[str], end: dt.date, keys: Sequence[str]
) -> tuple[DataFrame, list[str]]:
    """Label rows as daily series that end on ``end``; without ``keys`` they form one series."""
    rows = labels.select(*keys, *order, F.col(target).cast("double").alias("y")).dropna(subset=["y"])
    indexed = series.daily_index(rows, order, end, keys).select(*keys, "ds", "y")
    if not keys:
        keys, indexed = ["series"], indexed.withColumn("series", F.lit("all"))
    return materialize(indexed, "series"), list(keys)


def train_series(
    project: Project,
    labels: DataFrame,
    model: str,
    order: Sequence[str],
    end: dt.date,
    target: str = "target",
    horizon: int = 30,
    keys: Sequence[str] = (),
) -> int:
    """Fit on all but the last ``horizon`` days, measure on those, register; returns the version.

    The target alone makes the series, so no features are looked up: a left lookup on a unique key
    would neither add nor drop rows.
    """
    rows, names = _series_rows(labels, target, order, end, keys)
    train, test = series.tail_holdout(rows, "ds", horizon, names)
    path = project.new_model_path(model)
    series.fit(train, names).write.parquet(path)
    fitted = project.lake.spark.read.parquet(path)
    found = metrics.forecast_scores(series.predict(test, fitted, names)).first().asDict()
    params = {
        "model_type": PIPELINE_MODEL_TYPES["time_series"],
        "horizon": horizon,
        "seasonality_mode": "multiplicative",
    }
    run = project.registry.log_run({**params, "series_keys": json.dumps(names)}, found)
    return project.registry.register_version(model, run, path, [("ds", "date")])


def evaluate_series(
    project: Project,
    labels: DataFrame,
    model: str,
    order: Sequence[str],
    end: dt.date,
    target: str = "target",
    horizon: int = 30,
    keys: Sequence[str] = (),
) -> Promotion:
    """Challenger against champion by MAE on the last ``horizon`` days."""
    rows, names = _series_rows(labels, target, order, end, keys)
    _, test = series.tail_holdout(rows, "ds", horizon, names)
    held_out = materialize(test, "holdout")

    def load(path: str) -> DataFrame:
        return project.lake.spark.read.parquet(path)

    def compare(candidates: dict[str, DataFrame]) -> dict[str, dict[str, float]]:
        return {
            name: metrics.forecast_scores(series.predict(held_out, fitted, names)).first().asDict()
            for name, fitted in candidates.items()
        }

    return _evaluate(project, model, "time_series", load, compare)


# -- registration and promotion -------------------------------------------------------------------


def _register(
    project: Project, model: str, fitted: PipelineModel, params, found, inputs, stepped=None
) -> int:
    path = project.new_model_path(model)
    fitted.save(path)
    run = project.registry.log_run(params, found, stepped)
    return project.registry.register_version(model, run, path, inputs)


def unreadable(error: Exception) -> bool:
    """Whether a failure to load says that the model is missing or broken, not that the cluster had trouble."""
    if isinstance(error, (AnalysisException, IllegalArgumentException, LookupError, ValueError)):
        return True
    if isinstance(error, PySparkException):
        return (error.getCondition() or "") in BROKEN_FILES
    cause = error.java_exception
    while cause is not None:
        if cause.getClass().getSimpleName() in BROKEN_MODEL:
            return True
        cause = cause.getCause()
    return False


def _evaluate(project: Project, model: str, kind: str, load: Callable, compare: Callable) -> Promotion:
    """Score the challenger and, if there is one that can be scored, the champion; move the alias.

    A champion that is missing, unreadable or at odds with the table's columns promotes by default; any
    other failure is raised, and so is one that the challenger meets alone.
    """
    registry = project.registry
    challenger = registry.challenger(model, PIPELINE_MODEL_TYPES[kind])
    candidates = {"challenger": load(registry.version(model, challenger).path)}
    champion = registry.alias_version(model)
    if champion is not None:
        try:
            candidates["champion"] = load(registry.version(model, champion).path)
        except (Py4JJavaError, PySparkException, LookupError, ValueError) as error:
            if not unreadable(error):
                raise
    try:
        found = compare(candidates)
    except (AnalysisException, IllegalArgumentException):
        if candidates.pop("champion", None) is None:
            raise
        found = compare(candidates)
    metric, higher_is_better = DECIDING[kind]
    old = found.get("champion")
    promoted = decide(
        found["challenger"][metric],
        old[metric] if old else None,
        "champion" in candidates,
        higher_is_better,
    )
    if promoted:
        registry.set_alias(model, "champion", challenger)
    registry.log_run({"model_name": model, "challenger_version": challenger}, found["challenger"])
    return Promotion(challenger, champion, found["challenger"], old, promoted)


# -- scoring and monitoring -----------------------------------------------------------------------


SCORED = "scored_state"


def batch_score(
    project: Project,
    table: str,
    model: str,
    gold_table: str = "inference_results",
    alias: str = "champion",
    now: Column | None = None,
) -> int:
    """Score the whole feature table with the aliased version into the gold table; returns its version."""
    lake, (version, stored) = project.lake, _aliased(project, model, alias)
    newest = lake.current_version(table)
    results = _scored(lake.read(table, newest), version, stored, alias, now)
    _create_gold(lake, gold_table, results.schema, 1)
    made = lake.overwrite(gold_table, results)
    _remember(lake, gold_table, table, alias, newest, version)
    return made


def score_changes(
    project: Project,
    table: str,
    model: str,
    gold_table: str = "inference_results",
    alias: str = "champion",
    now: Column | None = None,
    buckets: int = 1,
) -> int:
    """Bring the gold table up to the feature table's newest version; returns how many rows were scored.

    What was scored last, feature version and model version, is kept beside the gold table. Nothing newer: no row is
    read. The alias on another model version, or no earlier run: everything is scored. Else only rows that the
    change feed names as new or changed are scored and merged; rows it names as deleted have no place in
    a feature table that only takes merges, and after a full refresh everything is scored too. The predictions are
    those of :func:`batch_score`; untouched rows keep the time they were scored at. A run cut short before it is
    remembered is made good by the next, as a merge of the same rows changes nothing.
    """
    lake, (version, stored) = project.lake, _aliased(project, model, alias)
    newest = lake.current_version(table)
    seen = _remembered(lake, gold_table, table, alias)
    if seen == (newest, version):
        return 0
    refreshed = lake.history(table).where(F.col("version").between((seen or (0, 0))[0] + 1, newest) & (F.col("operation") == "overwrite"))
    if seen is None or seen[1] != version or not refreshed.isEmpty():
        results = materialize(_scored(lake.read(table, newest), version, stored, alias, now), "scored")
        _create_gold(lake, gold_table, results.schema, buckets)
        lake.overwrite(gold_table, results)
    else:
        feed = lake.changes(table, seen[0], newest).where("_change_type in ('insert', 'update_postimage')")
        changed = feed.select(*lake.read(table, newest).columns)
        results = materialize(_scored(changed, version, stored, alias, now), "scored")
        lake.upsert(gold_table, results)
    _remember(lake, gold_table, table, alias, newest, version)
    return results.count()


def _aliased(project: Project, model: str, alias: str):
    version = project.registry.alias_version(model, alias)
    if version is None:
        raise LookupError(f"{model} has no {alias}")
    return version, project.registry.version(model, version)


def _scored(features: DataFrame, version: int, stored, alias: str, now: Column | None) -> DataFrame:
    inputs = [tuple(pair) for pair in json.loads(stored.signature)]
    rows = scoring.scoring_input(features, FEATURE_KEY)
    return scoring.gold(scoring.score_model(rows, PipelineModel.load(stored.path), inputs), alias, version, now)


def _create_gold(lake: Lake, name: str, schema: T.StructType, buckets: int) -> None:
    lake.create_if_absent(name, schema, [FEATURE_KEY], buckets, properties={"quality": "gold"})


_SCORED_KEY = ["gold", "features", "alias"]


def _remembered(lake: Lake, gold_table: str, table: str, alias: str) -> tuple[int, int] | None:
    """Feature and model version that the gold table was scored from, or None."""
    if not (lake.exists(SCORED) and lake.exists(gold_table)):
        return None
    mine = (F.col("gold") == gold_table) & (F.col("features") == table) & (F.col("alias") == alias)
    found = lake.read(SCORED).where(mine).select("feature_version", "model_version").first()
    return tuple(found) if found else None


def _remember(lake: Lake, gold_table: str, table: str, alias: str, features: int, model: int) -> None:
    names = {"gold": gold_table, "features": table, "alias": alias}
    numbers = {"feature_version": features, "model_version": model}
    row = lake.spark.range(1).select(*[F.lit(v).alias(k) for k, v in names.items()], *[F.lit(v).cast("bigint").alias(k) for k, v in numbers.items()])
    lake.create_if_absent(SCORED, row.schema, _SCORED_KEY)
    lake.upsert(SCORED, row)


def monitor_table(
    project: Project,
    table: str,
    baseline_version: int | None = None,
    problem_type: str = "classification",
    quantiles: str = "exact",
) -> None:
    """Profile the newest version and, given a baseline version, its drift, into metric tables.

    Rows are keyed by (table, window, column, metric): a second run writes the same rows again.
    """
    lake = project.lake
    current = lake.read(table)
    version = lake.current_version(table)
    window = F.lit(f"v{version}")
    columns = numeric_features(current)
    if monitor.monitor_kind(table) == "inference_log":
        columns = ["prediction"]  # the version that scored a row is no measure
        window = F.date_format("day", "yyyy-MM-dd")
        profiled = monitor.profile_log(current, problem_type=problem_type, quantiles=quantiles)
        if problem_type == "classification":
            named = F.concat(F.lit("prediction="), F.coalesce(F.col("prediction").cast("string"), F.lit("null")))
            profiled = profiled.withColumn("column", named)
        profiled = profiled.withColumn("column", F.concat_ws(":", "column", "model_version"))
    else:
        profiled = monitor.profile(current, columns, quantiles=quantiles)
    measured = [
        c
        for c in ("n", "share", "rows", "nulls", "zeros", "nans", "n_distinct", "mean", "sd", "min", "max", *monitor.QUARTILES)
        if c in profiled.columns
    ]
    _metric_upsert(lake, "profile_metrics", monitor.as_metric_rows(profiled, table, window, measured))
    if baseline_version is not None:
        drift = monitor.numeric_drift(lake.read(table, baseline_version), current, columns)
        pair = F.lit(f"v{baseline_version}-v{version}")
        rows = monitor.as_metric_rows(drift, table, pair, ["ks", "wasserstein", "psi", "js"])
        _metric_upsert(lake, "drift_metrics", rows)


def _metric_upsert(lake: Lake, name: str, rows: DataFrame) -> None:
    lake.create_if_absent(name, rows.schema, ["table", "window", "column", "metric"])
    lake.upsert(name, rows)


DAILY = "daily_profiles"
STATE = "monitor_state"


def monitor_changes(
    project: Project, table: str, timestamp: str, columns: Sequence[str] | None = None, k: int = sketches.K
) -> int:
    """Bring the daily profiles of a keyed table up to its newest version; returns how many days were redone.

    The version seen last is kept beside the profiles. Without a newer one no row is read. Else the change feed
    tells the days that lost, gained or changed rows, and only those are read and profiled again. Profiles are
    keyed by (table, day, column) and written before the version, so that a run cut short is made good by the next.
    """
    lake = project.lake
    version = lake.current_version(table)
    lake.create_if_absent(STATE, T._parse_datatype_string("table string, version bigint"), ["table"])
    known = lake.read(STATE).where(F.col("table") == table).select("version").first()
    seen = known[0] if known else 0
    if version == seen:
        return 0
    days = materialize(sketches.touched_days(lake.changes(table, seen, version), timestamp), "days")
    current = lake.read(table, version)
    wanted = list(columns or [c for c in numeric_features(current) if c not in lake.meta(table)["keys"]])
    rows = sketches.refreshed(current, days, timestamp, wanted, k)
    rows = rows.select(F.lit(table).alias("table"), "*", F.lit(version).cast("bigint").alias("as_of"))
    # a null day has a key of its own
    rows = rows.withColumn("day", F.coalesce(F.col("day").cast("string"), F.lit("")))
    lake.create_if_absent(DAILY, rows.schema, ["table", "day", "column"])
    lake.upsert(DAILY, rows)
    lake.upsert(STATE, lake.spark.range(1).select(F.lit(table).alias("table"), F.lit(version).cast("bigint").alias("version")))
    return days.count()


def window_drift(
    project: Project, table: str, baseline: tuple[dt.date, dt.date], current: tuple[dt.date, dt.date]
) -> DataFrame:
    """Drift between two windows of days (both ends included), from daily profiles alone."""
    daily = project.lake.read(DAILY).where(F.col("table") == table)
    base, cur = (daily.where(F.col("day").between(str(a), str(b))) for a, b in (baseline, current))
    return sketches.sketch_drift(base, cur)
