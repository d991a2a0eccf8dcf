"""Vector columns and distance kernels.

Distances run in Arrow batches: one matrix product per batch, which interpreted array lambdas
cannot match. Centroids are model parameters, so their number is bounded and checked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MODEL_VALUES = 20_000_000


def as_vector(column: Column | str) -> Column:
    """An array of numbers as an ml vector."""
    return array_to_vector(_col(column).cast("array<double>"))


def as_array(column: Column | str) -> Column:
    """An ml vector as an array of doubles."""
    return vector_to_array(_col(column))


def matrix(series: pd.Series) -> np.ndarray:
    """A batch of equal-length arrays as one matrix of doubles."""
    return np.asarray(series.to_list(), dtype=np.float64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Rows of ``x`` against rows of ``centroids``, by differences: exact for equal points."""
    out = np.empty((len(x), len(centroids)))
    for j, c in enumerate(centroids):
        gap = x - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def check_model_size(centroids: Sequence[Sequence[float]]) -> np.ndarray:
    held = np.asarray(centroids, dtype=np.float64)
    if held.ndim != 2 or held.size == 0:
        raise ValueError("centroids must be a non-empty list of equal-length vectors")
    if held.size > MAX_MODEL_VALUES:
        raise ValueError(f"{held.shape[0]} centroids of {held.shape[1]} values are too many to ship")
    return held


def with_nearest(
    df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]
) -> DataFrame:
    """Add ``cluster`` (the nearest centroid; the lowest number on a tie) and ``d2``."""
    shared = df.sparkSession.sparkContext.broadcast(check_model_size(centroids))

    @F.pandas_udf("cluster int, d2 double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        if column.empty:
            return pd.DataFrame({"cluster": [], "d2": []}).astype({"cluster": "int32"})
        gaps = squared_distances(matrix(column), shared.value)
        best = gaps.argmin(axis=1)
        return pd.DataFrame({"cluster": best.astype("int32"), "d2": gaps[np.arange(len(best)), best]})

    found = df.withColumn("__near", nearest(_col(vector).cast("array<double>")))
    return found.select(*df.columns, "__near.cluster", "__near.d2")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
