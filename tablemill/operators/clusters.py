"""Cluster assignment and cluster quality."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.functions.vector import MAX_MODEL_VALUES, as_vector, check_model_size, matrix, with_nearest
from tablemill.operators.joins import null_safe_join
from tablemill.session import materialize, one_row


TILE_BLOCKS = 8
TILE_BYTES = 1 << 24  # of the vectors of a tile, unless one block is larger
STRIP_ROWS = 256


def assign_clusters(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Add the nearest centroid ``cluster`` and the squared distance ``d2``."""
    return with_nearest(df, vector, centroids)


def inertia(df: DataFrame, vector: str, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Sum of squared distances to the nearest centroid."""
    return with_nearest(df, vector, centroids).agg(F.sum("d2").alias("inertia"))


def cluster_centroids(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """``(cluster, n, centroid)``, by a vector aggregate: no row per dimension is made."""
    summary = Summarizer.metrics("mean", "count").summary(F.col("__v"))
    vectors = df.select(F.col(cluster).alias("cluster"), as_vector(vector).alias("__v"))
    return (
        vectors.groupBy("cluster")
        .agg(summary.alias("__s"))
        .select(
            "cluster",
            F.col("__s.count").alias("n"),
            vector_to_array("__s.mean").alias("centroid"),
        )
    )


def cluster_spread(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """``(cluster, n, centroid, spread)``: mean Euclidean distance of the rows to their centroid."""
    centres = _collect_model(cluster_centroids(df, vector, cluster))
    shared = df.sparkSession.sparkContext.broadcast({r["cluster"]: np.asarray(r["centroid"]) for r in centres})

    @F.pandas_udf("double")
    def gap(column: pd.Series, owner: pd.Series) -> pd.Series:
        if column.empty:
            return pd.Series([], dtype="float64")
        own = np.stack([shared.value[c] for c in owner])
        return pd.Series(np.linalg.norm(matrix(column) - own, axis=1))

    measured = df.select(
        F.col(cluster).alias("cluster"),
        gap(F.col(vector).cast("array<double>"), F.col(cluster)).alias("__gap"),
    )
    spread = measured.groupBy("cluster").agg(F.avg("__gap").alias("spread"))
    known = df.sparkSession.createDataFrame(
        [(r["cluster"], r["n"], r["centroid"]) for r in centres],
        f"cluster {dict(measured.dtypes)['cluster']}, n bigint, centroid array<double>",
    )
    return known.join(spread, "cluster")


def davies_bouldin(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean over clusters of the worst ``(spread_i + spread_j) / centroid distance``.

    Coincident centroids are passed over. The rows are aggregated on Spark; the final formula
    runs over one row per cluster (model size, checked).
    """
    rows = cluster_spread(df, vector, cluster).collect()
    if len(rows) < 2:
        raise ValueError("davies_bouldin needs at least two clusters")
    spread = np.asarray([r["spread"] for r in rows])
    centres = np.asarray([r["centroid"] for r in rows])
    worst = np.zeros(len(rows))
    for i in range(len(rows)):
        apart = np.linalg.norm(centres - centres[i], axis=1)
        usable = apart > 0
        if usable.any():
            worst[i] = ((spread[i] + spread[usable]) / apart[usable]).max()
    return df.sparkSession.createDataFrame([(float(worst.mean()),)], "davies_bouldin double")


def silhouette_squared(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Silhouette on squared Euclidean distance, in time linear in the rows.

    This is another number than :func:`silhouette_exact`.
    """
    rows = df.select(as_vector(vector).alias("features"), F.col(cluster).alias("cluster"))
    if rows.select("cluster").distinct().limit(2).count() < 2:
        raise ValueError("silhouette needs at least two clusters")
    number = F.col("cluster").cast("double")
    if not isinstance(rows.schema["cluster"].dataType, T.NumericType):
        rows = StringIndexer(inputCol="cluster", outputCol="number").fit(rows).transform(rows)
        number = F.col("number")
    found = ClusteringEvaluator().evaluate(rows.select("features", number.alias("prediction")))
    return one_row(df.sparkSession, silhouette_squared=found)


def silhouette_exact(
    df: DataFrame, vector: str, cluster: str, block_rows: int = 2048
) -> DataFrame:
    """Mean silhouette on Euclidean distance.

    a = mean distance to the rest of the own cluster, b = least mean distance to another cluster,
    (b - a) / max(a, b), 0 for a lone row. Every row must be measured against every other, so the
    work grows with the square of the rows; :func:`silhouette_squared` is linear. Rows are packed
    into blocks of ``block_rows``, and a task measures the blocks of a tile against those of another, a
    strip of rows against a block at a time. No pair of rows is ever written out: a pair of tiles gives
    one sum per row and cluster.
    """
    spark = df.sparkSession
    counted = materialize(
        df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n")), "sizes"
    )
    n_clusters = counted.count()
    if n_clusters < 2:
        raise ValueError("silhouette needs at least two clusters")
    if n_clusters * block_rows > MAX_MODEL_VALUES:
        raise ValueError(f"{n_clusters} clusters are too many for blocks of {block_rows} rows")
    sizes = [(r["cluster"], i, r["n"]) for i, r in enumerate(counted.collect())]
    blocks = -(-sum(n for _, _, n in sizes) // block_rows)
    kind = dict(counted.dtypes)["cluster"]
    ids = spark.createDataFrame([(c, i) for c, i, _ in sizes], f"cluster {kind}, c int")

    # Dealt out in turn, so blocks are even whatever the clusters are. Written before the blocks
    # are gathered: a task that is run again might deal its rows out anew.
    vectors = df.select(
        F.col(vector).cast("array<double>").alias("v"), F.col(cluster).alias("cluster")
    )
    dealt = materialize(
        null_safe_join(vectors, ids, ["cluster"], small=True).select(
            "v",
            "c",
            F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"),
        ),
        "dealt",
    )
    packed = materialize(dealt.groupBy("block").applyInPandas(_pack, "block int, rows int, data binary, owners binary"), "blocks")
    widest = packed.agg(F.max(F.octet_length("data"))).first()[0]
    # small tiles for few rows, so that all cores have some pairs of tiles
    spread = math.isqrt(4 * spark.sparkContext.defaultParallelism)
    side = max(1, min(TILE_BLOCKS, TILE_BYTES // max(1, widest), blocks // spread))

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        partners = [_unpack(*items) for items in zip(right["rows"], right["data"], right["owners"])]
        for mine, *items in zip(left["block"], left["rows"], left["data"], left["owners"]):
            x, own = _unpack(*items)
            total = np.zeros((len(x), n_clusters))
            for y, owners in partners:
                member = np.zeros((len(y), n_clusters))
                member[np.arange(len(y)), owners] = 1.0
                for at in range(0, len(x), STRIP_ROWS):
                    total[at : at + STRIP_ROWS] += _distances(x[at : at + STRIP_ROWS], y) @ member
            row = np.arange(len(x), dtype="int32")
            found.append(pd.DataFrame({"block": np.int32(mine), "row": row, "own": own.astype("int32"), "total": list(total)}))
        return pd.concat(found) if found else pd.DataFrame({"block": [], "row": [], "own": [], "total": []})

    # every block meets every block: those of a tile and those of another in one task
    tiles = F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // side)))
    tile = F.floor(F.col("block") / side).cast("int")
    lefts = packed.select("*", tile.alias("tile"), tiles.alias("partner"))
    rights = packed.select("*", tile.alias("partner"), tiles.alias("tile"))
    per_block = (
        lefts.groupBy("tile", "partner")
        .cogroup(rights.groupBy("tile", "partner"))
        .applyInPandas(sums, "block int, row int, own int, total array<double>")
    )
    vector_sum = Summarizer.metrics("sum").summary(as_vector("total"))
    totals = per_block.groupBy("block", "row", "own").agg(vector_to_array(vector_sum.getField("sum")).alias("total"))
    shared = spark.sparkContext.broadcast(np.asarray([n for _, _, n in sizes], dtype=np.float64))

    @F.pandas_udf("double")
    def score(total: pd.Series, own: pd.Series) -> pd.Series:
        if total.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(_silhouette(matrix(total), own.to_numpy(), shared.value))

    return totals.select(score("total", "own").alias("s")).agg(F.avg("s").alias("silhouette"))


def _silhouette(total: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per row, from its summed distance to every cluster."""
    at = np.arange(len(own))
    rest = sizes[own] - 1
    a = total[at, own] / np.maximum(rest, 1)
    mean = total / sizes
    mean[at, own] = np.inf
    b = mean.min(axis=1)
    top = np.maximum(a, b)
    return np.where((rest > 0) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


def _pack(items: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block in one row."""
    data, owners = matrix(items["v"]), items["c"].to_numpy(dtype=np.int32)
    return pd.DataFrame({"block": [items["block"].iloc[0]], "rows": [len(items)], "data": [data.tobytes()], "owners": [owners.tobytes()]})


def _unpack(rows: int, data: bytes, owners: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, dtype=np.float64).reshape(rows, -1), np.frombuffer(owners, dtype=np.int32)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(square, 0.0))


def _collect_model(rows: DataFrame) -> list:
    """One row per cluster to the driver, if that is no larger than a model may be."""
    held = rows.persist()
    size = held.agg(F.count(F.lit(1)).alias("k")).first()["k"]
    width = held.select(F.size(held.columns[2]).alias("w")).first()
    if size * (width["w"] if width else 0) > MAX_MODEL_VALUES:
        raise ValueError(f"{size} clusters are too many for one model")
    out = held.collect()
    held.unpersist()
    return out
