"""File ingestion into bronze and silver tables, and streaming feature upserts.

Every job is triggered: it drains what has arrived and stops. Each has its own checkpoint, so a
restart continues where the last run ended.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablemill.operators.features import engineer_features
from tablemill.operators.quality import Rules, dedup_by_key, expect_or_drop
from tablemill.sources.files import stream_csv, stream_csv_kept, stream_parquet
from tablemill.sources.lake import Lake

# The two expectations on ingested rows.
INGEST_RULES = {"valid_id": "id IS NOT NULL", "valid_timestamp": "event_timestamp IS NOT NULL"}


def drain(query: StreamingQuery) -> StreamingQuery:
    """Wait for a triggered query; its failure is raised here."""
    query.awaitTermination()
    return query


def append_to(df: DataFrame, path: str, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table until nothing is left to read."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(availableNow=True).start(path)


def bronze(
    spark: SparkSession,
    source: str,
    table: str,
    checkpoint: str,
    schema: T.StructType,
    max_files_per_trigger: int | None = None,
    keep_misfits: bool = False,
) -> StreamingQuery:
    """CSV files into an append-only raw table, each file once.

    With ``keep_misfits`` the table has a column of what did not fit the schema, see
    :func:`tablemill.sources.files.typed`.
    """
    read = stream_csv_kept if keep_misfits else stream_csv
    return drain(append_to(read(spark, source, schema, True, max_files_per_trigger), table, checkpoint))


def dedup_stream(
    df: DataFrame,
    keys: Sequence[str],
    watermark: tuple[str, str] | None = None,
    salts: int = 8,
    place: str | None = None,
) -> DataFrame:
    """The first row to arrive per key.

    Without ``watermark`` the keys are remembered for ever; with ``(column, delay)`` only for the
    delay, which is also all the promise covers. Copies of one key are first thinned out over
    ``salts`` tasks, so that a key with very many copies does not pass through one task;
    ``salts=0`` skips that stage and its state. ``place``, a column with the row's file and position
    (:func:`tablemill.sources.files.stream_parquet`), spreads exact copies too and is dropped;
    without it rows are spread by a hash of their values.
    """
    keys = list(keys)
    spread = [place] if place else df.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts or 1)).cast("int")
    df = df.withColumn("__salt", salt).drop(*([place] if place else []))
    salted = [*keys, "__salt"]
    if watermark:
        df = df.withWatermark(*watermark)
        if salts:
            df = df.dropDuplicatesWithinWatermark(salted)
        return df.drop("__salt").dropDuplicatesWithinWatermark(keys)
    if salts:
        df = df.dropDuplicates(salted)
    return df.drop("__salt").dropDuplicates(keys)


def clean_stream(
    df: DataFrame,
    keys: Sequence[str] = ("id",),
    rules: Rules = INGEST_RULES,
    sequence: str = "dedup_first",
    watermark: tuple[str, str] | None = None,
    salts: int = 8,
    observation: str | None = None,
    now: Column | None = None,
    place: str | None = None,
) -> DataFrame:
    """Stamp, de-duplicate and validate a stream; ``sequence`` as in the batch form.

    ``watermark``, ``salts`` and ``place`` go to :func:`dedup_stream`.
    """
    stamp = F.current_timestamp() if now is None else now
    if sequence == "dedup_first":
        # the stamp comes after the hash that spreads copies, so that copies still look alike
        unique = dedup_stream(df, keys, watermark, salts, place).withColumn("processed_timestamp", stamp)
        return expect_or_drop(unique, rules, observation)
    if sequence == "validate_first":
        valid = expect_or_drop(df, rules, observation)
        return dedup_stream(valid, keys, watermark, salts, place).withColumn("processed_timestamp", stamp)
    raise ValueError(f"unknown sequence {sequence!r}")


def silver(
    spark: SparkSession,
    bronze_table: str,
    table: str,
    checkpoint: str,
    schema: T.StructType,
    max_files_per_trigger: int | None = None,
    **cleaning,
) -> StreamingQuery:
    """The raw table, incrementally, into the cleaned table."""
    raw = stream_parquet(spark, bronze_table, schema, max_files_per_trigger, place="__place")
    return drain(append_to(clean_stream(raw, place="__place", **cleaning), table, checkpoint))


def upsert_stream(
    stream: DataFrame,
    lake: Lake,
    table: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = engineer_features,
    newest: Sequence[Column] | None = None,
) -> StreamingQuery:
    """Each micro-batch, transformed, into a keyed table; a replayed batch changes nothing.

    ``newest`` orders the rows of one key inside a batch (first wins); without it a repeated key is
    an error. The writer's name is the checkpoint, whose batch numbers it counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if newest:
            batch = dedup_by_key(batch, lake.meta(table)["keys"], newest)
        lake.upsert(table, transform(batch), writer=checkpoint, batch_id=batch_id)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    return drain(query)
