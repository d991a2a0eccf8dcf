"""The catalogue of checked queries: a Spark callable each, with SQL for another engine beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.session import scratch_path
from tablemill.sources.lake import Lake

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_lake(spark: SparkSession) -> Lake:
    return Lake(spark, scratch_path(spark, "lake"))


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded, so that another order of summation gives the same value."""
    return F.round(column, digits)


def day_text(column: Column | str) -> Column:
    """As ``strftime('%Y-%m-%d')`` in SQL: years from 0 to 9999 have four digits, others their sign and as many as they need."""
    year = F.year(column)
    rest = [F.lpad(part(column).cast("string"), 2, "0") for part in (F.month, F.dayofmonth)]
    other = F.when(year == 0, "0000").otherwise(year.cast("string"))
    return F.when(year.between(1, 9999), F.date_format(column, "yyyy-MM-dd")).when(year.isNotNull(), F.concat_ws("-", other, *rest))


# -- inputs ---------------------------------------------------------------------------------------


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows with natural duplicates, zero divisors and null timestamps."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_extendedprice").alias("value_1"),
        F.col("l_discount").alias("value_2"),
        F.col("l_tax").alias("value_3"),
        F.col("l_returnflag").alias("category"),
        F.when(F.col("l_tax") != 0, F.col("l_shipdate")).alias("event_timestamp"),
    )


RAW_SQL = """raw AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS value_1, l_discount AS value_2,
         l_tax AS value_3, l_returnflag AS category,
         CASE WHEN l_tax <> 0 THEN l_shipdate END AS event_timestamp
  FROM lineitem)"""
RAW_OUT_SQL = """id, value_1, value_2, value_3, category,
  strftime(event_timestamp, '%Y-%m-%d') AS event_day"""
DEDUP_SQL = """row_number() OVER (PARTITION BY id ORDER BY value_1 NULLS FIRST, value_2 NULLS FIRST,
    value_3 NULLS FIRST, category NULLS FIRST, event_timestamp NULLS FIRST) AS rn"""


def raw_out(df: DataFrame) -> DataFrame:
    return df.withColumn("event_day", day_text("event_timestamp")).drop("event_timestamp")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their document's columns and two fixed threshold models."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return (
        table(spark, sf_dir, "labels")
        .join(documents, "doc_id", "left")
        .select(
            "doc_id",
            "lang",
            "source",
            "n_chars",
            "toxic",
            F.col("quality").alias("label"),
            (F.col("n_chars") > 1500).cast("int").alias("prediction"),
            (F.col("n_chars") > 300).cast("int").alias("prediction_b"),
            (F.col("n_chars") % 17).alias("score"),
        )
    )


LABELLED_SQL = """labelled AS (
  SELECT l.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality AS label,
         CAST(d.n_chars > 1500 AS INTEGER) AS prediction,
         CAST(d.n_chars > 300 AS INTEGER) AS prediction_b, d.n_chars % 17 AS score
  FROM labels l LEFT JOIN documents d USING (doc_id))"""


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One daily series per order priority."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("ds"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    )


DAILY_SQL = """daily AS (
  SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ds,
         round(sum(o_totalprice), 2) AS y
  FROM orders GROUP BY ALL)"""
