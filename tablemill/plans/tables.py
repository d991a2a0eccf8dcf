"""Queries on sources, sinks, quality rules, features and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.functions.scalar import ratio
from tablemill.operators import features as features_ops
from tablemill.operators import quality
from tablemill.operators.features import (
    engineer_features,
    fill_zero,
    numeric_features,
    standardize,
    with_split,
    without,
)
from tablemill.operators.lookup import Lookup, asof_lookup, training_set
from tablemill.plans import jobs
from tablemill.plans.catalog import (
    DEDUP_SQL,
    RAW_OUT_SQL,
    RAW_SQL,
    day_text,
    new_lake,
    query,
    r6,
    raw_out,
    raw_rows,
    table,
)
from tablemill.session import scratch_path
from tablemill.sources.files import MISFITS, stream_parquet
from tablemill.streaming.ingest import INGEST_RULES, append_to, bronze, drain, silver, upsert_stream
from tablemill.streaming.windows import daily_windows

NOW = "2024-06-01 00:00:00"
VALID_SQL = "id IS NOT NULL AND event_timestamp IS NOT NULL"
FEATURES_SQL = """id, round(value_1 / nullif(value_2, 0), 6) AS feature_1,
  round(CASE WHEN value_3 > -1 THEN ln(1 + value_3) END, 6) AS feature_2,
  CASE WHEN category = 'A' THEN 1 ELSE 0 END AS feature_3"""


# -- quality --------------------------------------------------------------------------------------


@query(
    "dedup_by_key",
    f"WITH {RAW_SQL} SELECT {RAW_OUT_SQL} FROM (SELECT *, {DEDUP_SQL} FROM raw) WHERE rn = 1",
)
def dedup_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_out(quality.dedup_by_key(raw_rows(spark, sf_dir), ["id"]))


@query("expect_or_drop", f"WITH {RAW_SQL} SELECT {RAW_OUT_SQL} FROM raw WHERE {VALID_SQL}")
def expect_or_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_out(quality.expect_or_drop(raw_rows(spark, sf_dir), INGEST_RULES))


@query(
    "expectation_report",
    f"""WITH {RAW_SQL}
SELECT 'valid_id' AS rule, count(*) FILTER (id IS NOT NULL) AS passed,
       count(*) FILTER (id IS NULL) AS failed FROM raw
UNION ALL
SELECT 'valid_timestamp', count(*) FILTER (event_timestamp IS NOT NULL),
       count(*) FILTER (event_timestamp IS NULL) FROM raw
UNION ALL
SELECT 'discounted', count(*) FILTER (value_2 > 0.01 AND event_timestamp > TIMESTAMP '1996-01-01'),
       count(*) FILTER ((value_2 > 0.01 AND event_timestamp > TIMESTAMP '1996-01-01') IS NOT TRUE)
FROM raw""",
)
def expectation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        **INGEST_RULES,
        "discounted": "value_2 > 0.01D AND event_timestamp > TIMESTAMP_NTZ '1996-01-01'",
    }
    return quality.expectation_report(raw_rows(spark, sf_dir), rules)


@query(
    "clean_dedup_first",
    f"""WITH {RAW_SQL} SELECT {RAW_OUT_SQL} FROM (SELECT *, {DEDUP_SQL} FROM raw)
WHERE rn = 1 AND {VALID_SQL}""",
)
def clean_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_out(quality.clean(raw_rows(spark, sf_dir), ["id"], INGEST_RULES))


@query(
    "clean_validate_first",
    f"""WITH {RAW_SQL}
SELECT {RAW_OUT_SQL} FROM (SELECT *, {DEDUP_SQL} FROM raw WHERE {VALID_SQL}) WHERE rn = 1""",
)
def clean_validate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_out(quality.clean(raw_rows(spark, sf_dir), ["id"], INGEST_RULES, "validate_first"))


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_count(raw_rows(spark, sf_dir))


@query(
    "key_uniqueness",
    f"WITH {RAW_SQL} SELECT id, count(*) AS count FROM raw GROUP BY id HAVING count(*) > 1",
)
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(raw_rows(spark, sf_dir), ["id"])


_COLUMNS = ["id", "value_1", "value_2", "value_3", "category", "event_timestamp"]


@query(
    "null_counts",
    f"WITH {RAW_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM raw" for c in _COLUMNS
    ),
)
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.null_counts(raw_rows(spark, sf_dir))


@query(
    "describe_long",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min,
        CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    ),
)
def describe_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    out = quality.describe_long(table(spark, sf_dir, "lineitem"), columns)
    return out.withColumns({"mean": r6("mean"), "stddev": r6("stddev")})


@query(
    "target_distribution",
    """SELECT quality, count(*) AS count,
  round(count(*) / CAST((SELECT count(*) FROM labels) AS DOUBLE), 6) AS share
FROM labels GROUP BY quality ORDER BY quality""",
)
def target_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.target_distribution(table(spark, sf_dir, "labels"), "quality")
    return out.withColumn("share", r6("share"))


@query(
    "preview",
    f"""WITH {RAW_SQL} SELECT {RAW_OUT_SQL} FROM raw ORDER BY id, value_1 NULLS FIRST,
  value_2 NULLS FIRST, value_3 NULLS FIRST, category NULLS FIRST, event_timestamp NULLS FIRST
LIMIT 100""",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_out(quality.preview(raw_rows(spark, sf_dir), _COLUMNS))


# -- features -------------------------------------------------------------------------------------


@query("engineer_features", f"WITH {RAW_SQL} SELECT {FEATURES_SQL}, '{NOW}' AS updated FROM raw")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engineer_features(raw_rows(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return out.select(
        "id",
        r6("feature_1").alias("feature_1"),
        r6("feature_2").alias("feature_2"),
        "feature_3",
        F.date_format("feature_updated_timestamp", "yyyy-MM-dd HH:mm:ss").alias("updated"),
    )


@query(
    "feature_summary",
    f"""WITH {RAW_SQL}, f AS (
  SELECT value_1 / nullif(value_2, 0) AS feature_1, ln(1 + value_3) AS feature_2,
    CASE WHEN category = 'A' THEN 1 ELSE 0 END AS feature_3
  FROM (SELECT *, {DEDUP_SQL} FROM raw) WHERE rn = 1 AND {VALID_SQL})
SELECT feature_3, count(*) AS rows, count(feature_1) AS ratios,
  round(avg(feature_1), 3) AS mean_feature_1, round(avg(feature_2), 6) AS mean_feature_2
FROM f GROUP BY feature_3""",
)
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to cleaned rows to features to a summary per category flag."""
    cleaned = quality.clean(raw_rows(spark, sf_dir), ["id"], INGEST_RULES)
    return (
        engineer_features(cleaned)
        .groupBy("feature_3")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("feature_1").alias("ratios"),
            r6(F.avg("feature_1"), 3).alias("mean_feature_1"),
            r6(F.avg("feature_2")).alias("mean_feature_2"),
        )
    )


@query("numeric_features", "SELECT o_custkey, o_totalprice FROM orders")
def numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(*numeric_features(orders, exclude=["o_orderkey"]))


@query(
    "exclude_columns",
    "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def exclude_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderdate"])


@query(
    "fill_zero",
    f"""WITH {RAW_SQL}, f AS (SELECT {FEATURES_SQL} FROM raw)
SELECT id, coalesce(feature_1, 0) AS feature_1, coalesce(feature_2, 0) AS feature_2, feature_3 FROM f""",
)
def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engineer_features(raw_rows(spark, sf_dir)).drop("feature_updated_timestamp")
    out = fill_zero(made, numeric_features(made))
    return out.withColumns({"feature_1": r6("feature_1"), "feature_2": r6("feature_2")})


@query(
    "drop_null_target",
    f"WITH {RAW_SQL} SELECT id, round(value_1 / value_2, 6) AS y FROM raw WHERE value_2 <> 0",
)
def drop_null_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = raw_rows(spark, sf_dir).select("id", ratio("value_1", "value_2").alias("y"))
    return features_ops.drop_null_target(made, "y").withColumn("y", r6("y"))


@query(
    "train_test_split",
    """SELECT event_id, CAST((event_id * 2654435761) % 4294967296 < 858993459 AS INTEGER) AS is_test
FROM events""",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_split(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return out.withColumn("is_test", F.col("is_test").cast("int"))


_SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standardize",
    "WITH s AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) AS {c}" for c in _SCALED)
    + " FROM lineitem, s",
)
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_SCALED)
    return standardize(rows, _SCALED).withColumns({c: r6(c, 4) for c in _SCALED})


# -- lookups --------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document features, which one language lacks."""
    documents = table(spark, sf_dir, "documents").filter(F.col("lang") != "es")
    return documents.select("doc_id", "n_chars", "lang", "source")


@query(
    "feature_lookup",
    """SELECT l.doc_id, l.quality, d.n_chars, d.lang, d.source
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'es') d USING (doc_id)""",
)
def feature_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return training_set(labels, [Lookup(_documents(spark, sf_dir), "doc_id")], label="quality")


@query(
    "multi_lookup",
    """SELECT l.quality, d.n_chars, d.lang, d.source, e.label AS topic
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'es') d USING (doc_id)
LEFT JOIN embeddings e ON e.vec_id = l.doc_id""",
)
def multi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    topics = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").alias("topic")
    )
    lookups = [Lookup(_documents(spark, sf_dir), "doc_id"), Lookup(topics, "doc_id")]
    return training_set(labels, lookups, label="quality", exclude=["doc_id"])


@query(
    "entity_lookup",
    """SELECT e.doc_id, d.n_chars, d.lang FROM (SELECT doc_id FROM documents) e
LEFT JOIN (SELECT * FROM documents WHERE lang <> 'es') d USING (doc_id)""",
)
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "documents").select("doc_id")
    return training_set(entities, [Lookup(_documents(spark, sf_dir), "doc_id", ["n_chars", "lang"])])


def _asof(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("value").alias("view_value")
    )
    found = asof_lookup(purchases, views, ["user_id"], "ts", "view_ts", ["view_value"], **options)
    return found.select("event_id", "user_id", day_text("view_ts").alias("view_day"), "view_value")


_ASOF_SQL = """SELECT p.event_id, p.user_id, strftime(v.ts, '%Y-%m-%d') AS view_day, v.value AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts"""


@query("asof_lookup", _ASOF_SQL)
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir)


@query("asof_lookup_hot_keys", _ASOF_SQL)
def asof_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a threshold that sends the busiest users through the range-split path."""
    return _asof(spark, sf_dir, hot_rows=27)


@query(
    "asof_lookup_max_age",
    """SELECT p.event_id, p.user_id,
  CASE WHEN p.ts - v.ts <= INTERVAL 1 DAY THEN strftime(v.ts, '%Y-%m-%d') END AS view_day,
  CASE WHEN p.ts - v.ts <= INTERVAL 1 DAY THEN v.value END AS view_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, max_lookback_seconds=86400)


# -- keyed tables ---------------------------------------------------------------------------------

_ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    dear = orders.filter("o_totalprice > 250000")
    return orders.filter("o_orderstatus <> 'O'"), dear.withColumn("o_totalprice", F.col("o_totalprice") + 1)


_UPSERT_SQL = """WITH t AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'),
u AS (SELECT o_orderkey, o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_totalprice > 250000)
"""
_MERGED_SQL = (
    _UPSERT_SQL
    + """SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM (
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.o_orderkey = t.o_orderkey)
  UNION ALL SELECT * FROM u)"""
)


def _orders_lake(spark: SparkSession, sf_dir: str, buckets: int):
    before, update = _snapshots(spark, sf_dir)
    lake = new_lake(spark)
    lake.create_if_absent("orders", before.schema, ["o_orderkey"], buckets)
    lake.overwrite("orders", before)
    lake.upsert("orders", update)
    return lake, update


@query("upsert_features", _MERGED_SQL)
def upsert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, _ = _orders_lake(spark, sf_dir, 1)
    return lake.read("orders").withColumn("o_totalprice", r6("o_totalprice", 2))


@query("upsert_idempotent", _MERGED_SQL)
def upsert_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table that takes the same update twice."""
    lake, update = _orders_lake(spark, sf_dir, 4)
    lake.upsert("orders", update)
    return lake.read("orders").withColumn("o_totalprice", r6("o_totalprice", 2))


@query(
    "overwrite_table",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'",
)
def overwrite_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, _ = _orders_lake(spark, sf_dir, 1)
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    lake.overwrite("orders", orders.filter("o_orderstatus <> 'P'"))
    return lake.read("orders")


@query("create_if_absent", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def create_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second creation finds the table and leaves it alone."""
    orders = table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)
    lake = new_lake(spark)
    lake.create_if_absent("orders", orders.schema, ["o_orderkey"])
    lake.upsert("orders", orders)
    lake.create_if_absent("orders", orders.schema, ["o_orderkey"])
    return lake.read("orders")


@query(
    "table_listing",
    """SELECT 'events' AS "table", count(*) AS rows FROM events
UNION ALL SELECT 'orders', count(*) FROM orders""",
)
def table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a schema with their row counts."""
    lake = new_lake(spark)
    counts = None
    for name, key in (("events", "event_id"), ("orders", "o_orderkey")):
        rows = table(spark, sf_dir, name)
        lake.create_if_absent(name, rows.schema, [key])
        lake.overwrite(name, rows)
        one = lake.read(name).agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return lake.tables().select("table").join(counts, "table", "left")


@query(
    "change_feed",
    _UPSERT_SQL
    + """, pairs AS (SELECT t.o_orderkey AS tk, t.o_orderstatus AS ts, t.o_totalprice AS tp,
  u.o_orderkey AS uk, u.o_orderstatus AS us, u.o_totalprice AS up
  FROM t RIGHT JOIN u ON t.o_orderkey = u.o_orderkey)
SELECT uk AS o_orderkey, us AS o_orderstatus, round(up, 2) AS o_totalprice, 'insert' AS _change_type,
  CAST(2 AS BIGINT) AS _commit_version FROM pairs WHERE tk IS NULL
UNION ALL SELECT tk, ts, round(tp, 2), 'update_preimage', 2 FROM pairs WHERE tk IS NOT NULL AND tp IS DISTINCT FROM up
UNION ALL SELECT uk, us, round(up, 2), 'update_postimage', 2 FROM pairs WHERE tk IS NOT NULL AND tp IS DISTINCT FROM up""",
)
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake, _ = _orders_lake(spark, sf_dir, 4)
    return lake.changes("orders", 1).withColumn("o_totalprice", r6("o_totalprice", 2))


# -- streams --------------------------------------------------------------------------------------


def _half_the_files(spark: SparkSession) -> int:
    """Files per micro-batch that give a stream of hash-partitioned files about two batches."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, 1)


def _raw_csv(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    """The raw rows as CSV files in the scratch folder."""
    rows = raw_rows(spark, sf_dir)
    path = scratch_path(spark, "csv")
    rows.repartition("id").write.option("header", True).csv(path)
    return path, rows.schema


def _bronze(spark: SparkSession, sf_dir: str) -> tuple[str, object]:
    source, schema = _raw_csv(spark, sf_dir)
    target = scratch_path(spark, "bronze")
    files = _half_the_files(spark)
    bronze(spark, source, target, scratch_path(spark, "checkpoint"), schema, files)
    return target, schema


@query("stream_bronze", f"WITH {RAW_SQL} SELECT {RAW_OUT_SQL} FROM raw")
def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files drained into the raw table."""
    path, schema = _bronze(spark, sf_dir)
    return raw_out(spark.read.schema(schema).parquet(path))


@query(
    "ingest_misfits",
    f"""WITH {RAW_SQL}, late AS (SELECT *, category = 'R' AS late, category = 'R' AND value_2 >= 0.05 AS odd FROM raw)
SELECT id, value_1, CASE WHEN NOT odd THEN value_2 END AS value_2, category, CASE WHEN late THEN id % 7 END AS lot,
  CASE WHEN odd THEN 'value_2' END AS misfit, CASE WHEN odd THEN 'high' END AS kept
FROM late""",
)
def ingest_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table after two runs of the ingestion job, types inferred by the first.

    The files of the second run add a column and hold values that do not parse.
    """
    rows, odd = raw_rows(spark, sf_dir), F.col("value_2") >= 0.05
    late = F.col("category") == "R"
    source, project = scratch_path(spark, "csv"), jobs.Project.at(new_lake(spark))
    rows.filter(~late).write.option("header", True).csv(f"{source}/1")
    jobs.ingest(project, f"{source}/*")
    wider = rows.filter(late).withColumn("lot", F.col("id") % 7)
    wider = wider.withColumn("value_2", F.when(odd, "high").otherwise(F.col("value_2").cast("string")))
    wider.write.option("header", True).csv(f"{source}/2")
    jobs.ingest(project, f"{source}/*")
    raw = project.lake.read("raw_data").select("id", "value_1", "value_2", "category", "lot", MISFITS)
    return raw.select("*", F.explode_outer(MISFITS).alias("misfit", "kept")).drop(MISFITS)


@query("stream_ingest_clean", f"WITH {RAW_SQL} SELECT DISTINCT id FROM raw WHERE {VALID_SQL}")
def stream_ingest_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to raw to cleaned table; which copy of a key survives depends on arrival, the keys do not."""
    path, schema = _bronze(spark, sf_dir)
    target = scratch_path(spark, "silver")
    silver(
        spark, path, target, scratch_path(spark, "checkpoint"), schema, sequence="validate_first"
    )
    return spark.read.parquet(target).select("id")


@query(
    "stream_upsert",
    f"""WITH {RAW_SQL} SELECT {FEATURES_SQL} FROM (SELECT *, {DEDUP_SQL} FROM raw) WHERE rn = 1""",
)
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of raw rows into the feature table, several micro-batches."""
    rows = raw_rows(spark, sf_dir)
    schema, path = rows.schema, scratch_path(spark, "raw")
    # all copies of a key share a file, so that no later micro-batch replaces the chosen one
    rows.repartition("id").write.parquet(path)
    stream = stream_parquet(spark, path, schema, _half_the_files(spark))
    lake = new_lake(spark)
    stamp = F.lit(NOW).cast("timestamp")
    made = engineer_features(spark.createDataFrame([], schema), stamp)
    lake.create_if_absent("features", made.schema, ["id"], buckets=2)
    checkpoint = scratch_path(spark, "checkpoint")
    newest = [F.col(c) for c in _COLUMNS[1:]]
    upsert_stream(stream, lake, "features", checkpoint, lambda b: engineer_features(b, stamp), newest)
    out = lake.read("features").drop("feature_updated_timestamp")
    return out.withColumns({"feature_1": r6("feature_1"), "feature_2": r6("feature_2")})


@query(
    "stream_daily_windows",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS rows,
  round(avg(value), 8) AS mean, min(value) AS min, max(value) AS max
FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY 1, 2""",
)
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events as a stream; the days that the watermark has closed."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    source = scratch_path(spark, "events")
    events.write.parquet(source)
    windows = daily_windows(stream_parquet(spark, source, events.schema), "ts", "value", "event_type")
    target = scratch_path(spark, "windows")
    drain(append_to(windows, target, scratch_path(spark, "checkpoint")))
    out = spark.read.schema(windows.schema).parquet(target)
    return out.withColumns({"day": day_text("day"), "mean": r6("mean", 8)})
