"""Runs, metric history, model versions and aliases as append-only tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.session import one_row
from tablemill.sources.lake import Lake
from tablemill.sources.publish import publish

# The run parameter that tells which pipeline made a version, per kind of model.
PIPELINE_MODEL_TYPES = {
    "classification": "RandomForestClassifier",
    "clustering": "KMeans",
    "time_series": "Prophet",
}

SCHEMAS = {
    "runs": "run_id string, params map<string,string>, metrics map<string,double>, logged_at timestamp",
    "run_metric_history": "run_id string, key string, step bigint, value double",
    "model_versions": (
        "model string, version bigint, run_id string, path string, signature string, "
        "registered_at timestamp"
    ),
    "model_aliases": "model string, alias string, version bigint, set_at timestamp",
}


class Registry:
    """The four tables beside those of a :class:`Lake`, created on first use.

    Each append is a folder of its own, so jobs that run side by side lose nothing of each other's; a
    table is all finished folders. A version's folder is named by its number and made by one job only,
    so jobs that train one model side by side get different numbers.
    """

    def __init__(self, lake: Lake) -> None:
        self.lake = lake
        self.home = f"{lake.root.rstrip('/')}/{lake.catalog}/{lake.schema}/registry"
        for name in SCHEMAS:
            folder = lake.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
            folder.getFileSystem(lake.spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def table(self, name: str) -> DataFrame:
        reader = self.lake.spark.read.schema(SCHEMAS[name]).option("recursiveFileLookup", True)
        return reader.parquet(f"{self.home}/{name}")

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.home}/{name}/{uuid.uuid4().hex}")

    # -- runs ---------------------------------------------------------------------------------

    def log_run(
        self,
        params: Mapping[str, object],
        metrics: Mapping[str, float],
        stepped: Mapping[str, Sequence[tuple[int, float]]] | None = None,
        run_id: str | None = None,
    ) -> str:
        """Record a run; ``stepped`` holds metrics with a step, such as an elbow curve."""
        run_id = run_id or uuid.uuid4().hex
        spark = self.lake.spark
        run = one_row(
            spark,
            run_id=run_id,
            params=_map({k: str(v) for k, v in params.items()}, "string"),
            metrics=_map({k: float(v) for k, v in metrics.items()}, "double"),
        )
        points = [
            F.struct(
                F.lit(key).alias("key"),
                F.lit(int(step)).cast("bigint").alias("step"),
                F.lit(float(value)).alias("value"),
            )
            for key, series in (stepped or {}).items()
            for step, value in series
        ]
        history = None
        if points:
            history = one_row(spark, run_id=run_id, points=F.array(*points)).select("run_id", F.inline("points"))
        self.log_runs(run, history)
        return run_id

    def log_runs(self, runs: DataFrame, history: DataFrame | None = None) -> None:
        """Record many runs at once: ``(run_id, params, metrics)``, and ``(run_id, key, step, value)``."""
        stamped = runs.withColumn("logged_at", F.current_timestamp())
        self._append("runs", stamped.select("run_id", "params", "metrics", "logged_at"))
        if history is not None:
            self._append("run_metric_history", history.select("run_id", "key", "step", "value"))

    # -- versions and aliases -----------------------------------------------------------------

    def register_version(
        self, model: str, run_id: str, path: str, inputs: Sequence[tuple[str, str]] = ()
    ) -> int:
        """Add the next version of ``model``; versions count up from 1, each given once."""
        mine = self.table("model_versions").filter(F.col("model") == model)
        home = f"{self.home}/model_versions/model-{quote(model, safe='')}"
        while True:
            version = (mine.agg(F.max("version")).first()[0] or 0) + 1
            row = one_row(
                self.lake.spark,
                model=model,
                version=F.lit(version).cast("bigint"),
                run_id=run_id,
                path=path,
                signature=json.dumps(list(inputs)),
                registered_at=F.current_timestamp(),
            )
            # another job may have taken the number since
            if publish(row, f"{home}/{version}"):
                return version
            mine = self.table("model_versions").filter(F.col("model") == model)

    def set_alias(self, model: str, alias: str, version: int) -> None:
        row = one_row(
            self.lake.spark,
            model=model,
            alias=alias,
            version=F.lit(version).cast("bigint"),
            set_at=F.current_timestamp(),
        )
        self._append("model_aliases", row)

    def alias_version(self, model: str, alias: str = "champion") -> int | None:
        row = resolve_aliases(
            self.table("model_aliases").filter((F.col("model") == model) & (F.col("alias") == alias))
        ).take(1)
        return row[0]["version"] if row else None

    def challenger(self, model: str, model_type: str) -> int:
        """The newest version that a pipeline run made; an error when there is none."""
        versions = self.table("model_versions").filter(F.col("model") == model)
        if versions.isEmpty():
            raise LookupError(f"{model} has no versions")
        row = challenger_versions(versions, self.table("runs"), model_type).take(1)
        if not row:
            raise LookupError(f"{model} has no version from a {model_type} run")
        return row[0]["version"]

    def version(self, model: str, version: int):
        """The stored row of one version."""
        row = (
            self.table("model_versions")
            .filter((F.col("model") == model) & (F.col("version") == version))
            .take(1)
        )
        if not row:
            raise LookupError(f"{model} has no version {version}")
        return row[0]


def _map(values: Mapping[str, object], kind: str) -> Column:
    if not values:
        return F.create_map().cast(f"map<string,{kind}>")
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])


def pipeline_versions(versions: DataFrame, runs: DataFrame, model_type: str) -> DataFrame:
    """Versions whose run logged ``model_type``; a version without a run falls out of the join."""
    of_type = runs.filter(F.col("params")["model_type"] == model_type).select("run_id")
    return versions.join(of_type, "run_id", "left_semi")


def challenger_versions(versions: DataFrame, runs: DataFrame, model_type: str) -> DataFrame:
    """Per model the pipeline version with the highest number."""
    newest = Window.partitionBy("model").orderBy(F.col("version").cast("bigint").desc())
    ranked = pipeline_versions(versions, runs, model_type).withColumn(
        "__rn", F.row_number().over(newest)
    )
    return ranked.filter("__rn = 1").drop("__rn")


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """The version each (model, alias) points at: the one set last."""
    latest = F.max(F.struct("set_at", "version"))
    return (
        aliases.groupBy("model", "alias")
        .agg(latest.alias("__last"))
        .select("model", "alias", F.col("__last.version").alias("version"))
    )


def flatten_runs(runs: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Run parameters and metrics as columns."""
    wanted: list[Column] = [F.col("params")[p].alias(p) for p in params]
    wanted += [F.col("metrics")[m].alias(m) for m in metrics]
    return runs.select("run_id", *wanted)
