"""Random forest classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import materialize

# Forest size and seed.
NUM_TREES = 100
SEED = 42

#: About how many labelled rows a forest is fitted on at most, and how many a partition of them holds.
MAX_ROWS = 10_000_000
PARTITION_ROWS = 50_000
_SLOTS = 1 << 30


def fit_rows(train: DataFrame, label: str, keys: Sequence[str], max_rows: int = MAX_ROWS, seed: int = SEED) -> DataFrame:
    """The labelled rows a forest is fitted on, in partitions that depend on the rows alone.

    All of them up to ``max_rows``; beyond that the rows whose key falls, by its hash, into the share that
    leaves ``max_rows`` on average. ``keys`` name a row; rows equal in them are ordered by their other values.
    """
    labelled = train.dropna(subset=[label])
    total = labelled.count()
    if total > max_rows:
        slot = F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(_SLOTS))
        labelled = labelled.filter(slot < F.lit(int(_SLOTS * max_rows / total)))
    parts = max(1, -(-min(total, max_rows) // PARTITION_ROWS))
    rest = [c for c in labelled.columns if c not in keys]
    return labelled.repartition(parts, *keys).sortWithinPartitions(*keys, *rest)


def fit(
    train: DataFrame,
    label: str,
    inputs: Sequence[str],
    num_trees: int = NUM_TREES,
    seed: int = SEED,
    max_depth: int = 30,
    min_leaf_rows: int = 1,
    keys: Sequence[str] = (),
    max_rows: int = MAX_ROWS,
) -> PipelineModel:
    """Median imputation (fitted on ``train``), assembly and a random forest.

    Trees grow until pure, up to Spark's depth limit of 30. A larger ``min_leaf_rows`` makes smaller
    trees. With ``keys`` at most about ``max_rows`` rows are fitted on, and the same rows give the same forest
    however they are partitioned (:func:`fit_rows`); without, all rows are, as they lie.
    """
    labelled = train.dropna(subset=[label])
    if keys:
        held = dict.fromkeys([*keys, label, *inputs])
        labelled = materialize(fit_rows(labelled.select(*held), label, keys, max_rows, seed), "labelled")
    filled = [f"__filled_{c}" for c in inputs]
    stages = [
        Imputer(strategy="median", inputCols=list(inputs), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        RandomForestClassifier(
            labelCol=label,
            featuresCol="features",
            numTrees=num_trees,
            seed=seed,
            maxDepth=max_depth,
            minInstancesPerNode=min_leaf_rows,
            # deep trees: rows remember their node instead of walking down from the root
            cacheNodeIds=True,
            maxMemoryInMB=1024,
        ),
    ]
    return Pipeline(stages=stages).fit(labelled)


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``prediction`` and, for two classes, the positive-class ``score``."""
    known = df.columns
    out = model.transform(df)
    probability = vector_to_array("probability")
    return out.select(
        *known,
        F.col("prediction").cast("double").alias("prediction"),
        F.try_element_at(probability, F.lit(2)).alias("score"),
    )
