"""Batch scoring and the gold projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.operators.features import check_signature


def scoring_input(features: DataFrame, key: str = "id") -> DataFrame:
    """Feature rows that have a key."""
    return features.filter(F.col(key).isNotNull())


def score_model(df: DataFrame, model: PipelineModel, inputs: Sequence[tuple[str, str]]) -> DataFrame:
    """Score with a Spark model; rows stay in the JVM. ``inputs`` is the saved signature."""
    check_signature(df, inputs)
    return model.transform(df).withColumn("prediction", F.col("prediction").cast("double"))


def score_python(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
    columns: Sequence[str],
    prediction: str = "prediction",
) -> DataFrame:
    """Score with a Python model over numeric columns, giving a double.

    ``load`` runs once per partition and returns the predict function, which then sees one Arrow
    batch at a time.
    """
    names = list(columns)

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            frame = pd.concat(batch, axis=1)
            frame.columns = names
            yield pd.Series(np.asarray(model(frame), dtype="float64"))

    return df.withColumn(prediction, predict(*[F.col(c) for c in names]))


def score_batches(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Score with a Python model that returns several columns or rows per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def gold(
    scored: DataFrame,
    alias: str = "champion",
    version: int | None = None,
    now: Column | None = None,
    key: str = "id",
) -> DataFrame:
    """``(key, prediction, inference_timestamp, model_version, resolved_version)``.

    The alias alone hides a change of version from monitoring, so the number is kept beside it.
    """
    return scored.select(
        key,
        "prediction",
        (F.current_timestamp() if now is None else now).alias("inference_timestamp"),
        F.lit(alias).alias("model_version"),
        F.lit(version).cast("bigint").alias("resolved_version"),
    )
