"""Shards in random order: an external shuffle in two passes.

The first pass scatters records over buckets by a seeded hash of their place in the input, so that a
bucket fits in memory whatever a key's share of the rows. The second reads a bucket whole, shuffles it by
Fisher and Yates and writes it. Buckets one after the other are a random order of all records, and
dealing that order out in turn gives shards whose row counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm.store import ROW, Workspace, numbered

BUCKET_BYTES = 8 << 20
SEED = 20240
BROADCAST_BUCKETS = 1 << 20


def fisher_yates(n: int, draw: np.random.Generator) -> np.ndarray:
    """A random order of n rows, every order as likely as the others."""
    order = np.arange(n)
    swaps = draw.integers(0, np.arange(n, 0, -1)) if n else order
    for i in range(n):
        j = i + int(swaps[i])
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by(ROW)  # the order of arrival is chance, the result is not
        number = bucket["_op_bucket"][0].as_py()
        order = fisher_yates(bucket.num_rows, np.random.default_rng([seed, number]))
        place = pa.array(np.arange(bucket.num_rows), pa.int64())
        return bucket.take(pa.array(order)).append_column("_op_place", place)

    return run


def size_of(text) -> F.Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 1).cast("long")


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs``, with shard (0 to ``shards`` - 1) and slot (the place in it, from 0).

    Row counts of shards differ by one at most, and every row has a place of its own. The same table and
    seed give the same result. A null text and a null id are rows like any others; rows that repeat are
    scattered one by one, so no key or group of equal texts can fill a bucket. An empty table gives an
    empty one; columns shard and slot are replaced, and names that begin with ``_op_`` are the operator's
    own.
    """
    if shards < 1 or bucket_bytes < 1:
        raise ValueError("shards and bucket_bytes must be positive")
    work = Workspace(docs.sparkSession, "shards")
    same = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(size_of(F.col("text")))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = numbered(docs, work).select(ROW, *same)
    scattered = rows.withColumn("_op_bucket", F.pmod(F.xxhash64(F.lit(seed), ROW), F.lit(buckets)).cast("int"))
    kinds = T.StructType([*scattered.schema.fields, T.StructField("_op_place", T.LongType())])
    mixed = work.write(scattered.groupBy("_op_bucket").applyInArrow(_shuffled(seed), kinds))

    # one row for each bucket: where it begins in the order of all records
    counts = mixed.groupBy("_op_bucket").count()
    before = F.sum("count").over(Window.orderBy("_op_bucket").rowsBetween(Window.unboundedPreceding, -1))
    begins = counts.select("_op_bucket", F.coalesce(before, F.lit(0)).alias("_op_begin"))
    if buckets <= BROADCAST_BUCKETS:  # 16 bytes each
        begins = F.broadcast(begins)
    dealt = mixed.join(begins, "_op_bucket").withColumn("_op_at", F.col("_op_begin") + F.col("_op_place"))
    return dealt.select(*same, F.pmod("_op_at", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_op_at div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shards as folders shard=N of parquet files, each in the order of its slots."""
    placed = shuffled_shards(docs, shards, seed, bucket_bytes)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
