"""Batch and stream readers over files, and metastore listing."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.session import one_row

MISFITS = "_misfits"
#: Key under which :data:`MISFITS` holds a whole line with more fields than the schema.
LINE = "_line"


def infer_csv_schema(spark: SparkSession, path: str, header: bool = True) -> T.StructType:
    """Infer the column types once; pass the result to every later read, restarts included."""
    return spark.read.option("header", header).option("inferSchema", True).csv(path).schema


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).csv(path)


def stream_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Each file that appears below ``path`` is read once."""
    reader = spark.readStream.schema(schema).option("header", header)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(path)


def _texts(schema: T.StructType) -> T.StructType:
    """The schema as texts, one field beyond its last, and the line of a row that is too long or too short."""
    names = [*schema.fieldNames(), "__beyond", "__line"]
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _text_options(header: bool) -> dict:
    return {"header": header, "columnNameOfCorruptRecord": "__line", "mode": "PERMISSIVE"}


def typed(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Texts cast to ``schema``; what does not fit is kept in the map column :data:`MISFITS`.

    A value that does not parse becomes null and is kept under its column's name. Values beyond the
    last column put the whole line under ``_line``. A row with fewer values has nulls at its end and
    is no misfit, so files from before a column was added may still arrive. Rows without a misfit
    have null there.
    """

    def cast(field: T.StructField) -> Column:
        # a string column takes every value as it is
        text = F.col(f"`{field.name}`")
        return text if field.dataType == T.StringType() else text.try_cast(field.dataType)

    kept = [
        F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("text"), cast(f).isNull().alias("lost"))
        for f in schema.fields
    ]
    beyond = F.struct(
        F.lit(LINE).alias("column"),
        F.coalesce("__line", "__beyond").alias("text"),
        F.col("__beyond").isNotNull().alias("lost"),
    )
    lost = F.filter(F.array(*kept, beyond), lambda v: v["lost"] & v["text"].isNotNull())
    pairs = F.map_from_entries(F.transform(lost, lambda v: F.struct(v["column"], v["text"])))
    columns = [cast(f).alias(f.name) for f in schema.fields]
    # the pairs are only put together for rows that have one: most have none, and a lambda is run row by row
    odd = F.col("__beyond").isNotNull()
    for f in schema.fields:
        if f.dataType != T.StringType():
            odd = odd | (F.col(f"`{f.name}`").isNotNull() & cast(f).isNull())
    return texts.select(*columns, F.when(odd, pairs).alias(MISFITS))


def read_csv_kept(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Batch form of :func:`stream_csv_kept`."""
    return typed(spark.read.schema(_texts(schema)).options(**_text_options(header)).csv(path), schema)


def stream_csv_kept(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    header: bool = True,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Each file once, as :func:`typed` rows with their misfits; columns go by position."""
    reader = spark.readStream.schema(_texts(schema)).options(**_text_options(header))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed(reader.csv(path), schema)


def _stored(spark: SparkSession, home: str) -> dict | None:
    """The newest entry below ``home``."""
    try:
        entries = spark.read.schema("value string").text(home)
        newest = entries.orderBy(F.get_json_object("value", "$.entry").cast("int").desc()).take(1)
    except AnalysisException:
        return None
    return json.loads(newest[0][0]) if newest else None


def settled_schema(spark: SparkSession, path: str, home: str) -> T.StructType:
    """The schema of the CSV files below ``path``: inferred once, kept below ``home``, widened on the right.

    The first call infers it. Later calls look only at files that are as new as the newest one
    seen before: where a header goes on beyond the known columns, those columns are added with the
    types inferred from one such file (what does not fit elsewhere is a misfit). Known columns keep
    their types whatever arrives. A call reads the lines of the new files once.
    Column names hold no comma. One caller at a time.
    """
    known = _stored(spark, home)
    if known is None:
        schema, entry = infer_csv_schema(spark, path), 1
        # contents are not read for this
        files = spark.read.format("binaryFile").load(path)
        seen = files.agg(F.max(F.unix_micros("modificationTime"))).first()[0]
    else:
        schema, entry = T.StructType.fromJson(known["schema"]), known["entry"] + 1
        # the condition on the time stamp prunes files before any is opened
        fresh = spark.read.text(path).filter(
            F.col("_metadata.file_modification_time") >= F.timestamp_micros(F.lit(known["seen"]))
        )
        plain = F.translate("value", '"', "")
        wider = F.when(
            F.startswith(plain, F.lit(",".join(schema.fieldNames()) + ",")),
            F.struct(F.length(plain).alias("length"), F.col("_metadata.file_path").alias("file")),
        )
        found = fresh.agg(
            F.max(F.unix_micros("_metadata.file_modification_time")).alias("seen"), F.max(wider).alias("widest")
        ).first()
        seen = found["seen"]
        if found["widest"]:
            later = infer_csv_schema(spark, found["widest"]["file"]).fields[len(schema) :]
            schema = T.StructType([*schema.fields, *later])
        elif seen in (None, known["seen"]):
            return schema
    note = json.dumps({"entry": entry, "seen": seen, "schema": schema.jsonValue()})
    one_row(spark, value=note).write.mode("append").text(home)
    return schema


def stream_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_files_per_trigger: int | None = None,
    place: str | None = None,
) -> DataFrame:
    """Incremental read of an upstream table; ``place`` names a column for a hash of the row's file and position."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(path)
    if place is None:
        return rows
    return rows.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(place))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of a metastore database."""
    return spark.sql(f"SHOW TABLES IN {database}" if database else "SHOW TABLES")
