"""KMeans with restarts, elbow curve, and a pipeline that keeps its scaling."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.operators.features import Scaler, fill_zero

# Clusters, seed, restarts, elbow range, iteration limit and relative tolerance.
CLUSTERS = 5
SEED = 42
RESTARTS = 10
ELBOW = range(2, 11)
MAX_ITERATIONS = 300
TOLERANCE = 1e-4

#: Passes every restart gets, and how many restarts of each k then run to their end.
FIRST_PASSES = 5
FINALISTS = 3


def scaling_stages(scaler: Scaler) -> list:
    """Zero-fill and standardise as saved pipeline stages, so scoring repeats the training scale."""
    filled = {c: f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), 0D), 0D)" for c in scaler.sd}
    exprs = [
        f"({filled[c]} - {scaler.mean[c]!r}D) / {sd!r}D AS `__scaled_{c}`" if sd > 0 else f"0D AS `__scaled_{c}`"
        for c, sd in scaler.sd.items()
    ]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__scaled_{c}" for c in scaler.sd], outputCol="features"),
    ]


def preprocess(df: DataFrame, inputs: Sequence[str]) -> PipelineModel:
    """Fitted zero-fill, scaling and assembly."""
    scaler = Scaler.fit(fill_zero(df.select(*inputs), inputs), inputs)
    return Pipeline(stages=scaling_stages(scaler)).fit(df)


@contextmanager
def held_vectors(df: DataFrame):
    """The vector column kept on the executors while many fits read it."""
    held = df.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def stopping_distance(vectors: DataFrame) -> float:
    """Fits stop once no centre moves further than this: sqrt(1e-4 x mean column variance)."""
    summary = Summarizer.metrics("variance").summary(F.col("features")).getField("variance")
    spread = vectors.select(summary.alias("v")).first()["v"]
    return float(np.sqrt(TOLERANCE * np.mean(spread.toArray()))) if spread is not None else 0.0


def best_of(
    vectors: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED, threads: int = 8, finalists: int = FINALISTS
) -> KMeansModel:
    """The fit with the lowest training cost over consecutive seeds; ties go to the first."""
    return best_per_k(vectors, [k], restarts, seed, threads, finalists)[k]


def best_per_k(
    vectors: DataFrame,
    ks: Iterable[int],
    restarts: int = RESTARTS,
    seed: int = SEED,
    threads: int = 8,
    finalists: int = FINALISTS,
) -> dict[int, KMeansModel]:
    """Best fit for every k. Fits are Spark jobs; a few run side by side to fill the cluster.

    Every restart makes ``FIRST_PASSES`` passes; the ``finalists`` with the lowest cost of each k then run
    until they stop moving. ``finalists=restarts`` runs all of them to the end.
    """
    ks, seeds = list(ks), [seed + i for i in range(restarts)]
    tolerance = stopping_distance(vectors)

    def one(task: tuple[int, int, int]) -> tuple[float, int, KMeansModel]:
        k, s, passes = task
        settings = KMeans(k=k, seed=s, maxIter=passes, tol=tolerance, featuresCol="features")
        model = settings.fit(vectors)
        return model.summary.trainingCost, s, model

    run = inheritable_thread_target(vectors.sparkSession)(one)
    with ThreadPoolExecutor(threads) as pool:
        chosen = {k: seeds for k in ks}
        if finalists < restarts:
            grid = [(k, s, FIRST_PASSES) for k in ks for s in seeds]
            costs = {k: [] for k in ks}
            for (k, _, _), (cost, s, _) in zip(grid, pool.map(run, grid)):
                costs[k].append((cost, s))
            chosen = {k: [s for _, s in sorted(found)[:finalists]] for k, found in costs.items()}
        grid = [(k, s, MAX_ITERATIONS) for k in ks for s in sorted(chosen[k])]
        best: dict[int, tuple[float, int, KMeansModel]] = {}
        for (k, _, _), found in zip(grid, pool.map(run, grid)):
            best[k] = min(best.get(k, found), found, key=lambda f: f[:2])
    return {k: model for k, (_, _, model) in best.items()}


def elbow_curve(
    vectors: DataFrame, ks: Iterable[int] = ELBOW, restarts: int = RESTARTS, threads: int = 8
) -> DataFrame:
    """``(k, inertia)`` of the best fit per k; ``vectors`` should be held (:func:`held_vectors`)."""
    models = best_per_k(vectors, ks, restarts, threads=threads)
    rows = [(k, float(m.summary.trainingCost)) for k, m in sorted(models.items())]
    return vectors.sparkSession.createDataFrame(rows, "k int, inertia double")


def fit(df: DataFrame, inputs: Sequence[str], k: int = CLUSTERS, restarts: int = RESTARTS) -> PipelineModel:
    """Preprocessing and the best KMeans fit as one saveable pipeline."""
    before = preprocess(df, inputs)
    with held_vectors(before.transform(df)) as vectors:
        best = best_of(vectors, k, restarts)
    return PipelineModel(stages=[*before.stages, best])


def predict(df: DataFrame, model: PipelineModel, refit_on: Sequence[str] | None = None) -> DataFrame:
    """Add ``features`` (scaled vector) and ``cluster``.

    ``refit_on`` names the inputs to rescale on ``df`` itself instead of with the saved statistics.
    """
    clusterer = model.stages[-1]
    before = preprocess(df, refit_on) if refit_on else PipelineModel(stages=model.stages[:-1])
    out = clusterer.transform(before.transform(df))
    return out.select(*df.columns, "features", F.col("prediction").alias("cluster"))
