import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.operators.features import engineer_features
from tablemill.plans import jobs
from tablemill.sources.files import LINE, MISFITS, infer_csv_schema, read_csv, read_csv_kept, settled_schema, stream_parquet, typed
from tablemill.sources.lake import Lake
from tablemill.streaming.ingest import append_to, bronze, clean_stream, dedup_stream, drain, silver, upsert_stream
from tablemill.streaming.windows import daily_windows

HEADER = "id,value_1,value_2,value_3,category,event_timestamp\n"


class Source:
    """A growing folder of CSV files and the paths of the jobs that read it."""

    def __init__(self, spark, root):
        self.spark, self.root, self.count = spark, root, 0
        (root / "in").mkdir()

    def add(self, *lines):
        self.count += 1
        (self.root / "in" / f"{self.count}.csv").write_text(HEADER + "".join(f"{l}\n" for l in lines))

    def path(self, name):
        return str(self.root / name)

    def run(self, **cleaning):
        schema = infer_csv_schema(self.spark, self.path("in")) if self.count == 1 else self.schema
        self.schema = schema
        bronze(self.spark, self.path("in"), self.path("bronze"), self.path("c1"), schema)
        silver(self.spark, self.path("bronze"), self.path("silver"), self.path("c2"), schema, **cleaning)
        return self.spark.read.parquet(self.path("silver"))


@pytest.fixture
def source(spark, tmp_path):
    return Source(spark, tmp_path)


def test_each_file_is_read_once_across_restarts(source):
    source.add("1,10,2,5,A,2024-01-01 00:00:00", "2,20,4,8,B,2024-01-01 00:00:00")
    assert source.run().count() == 2
    assert source.run().count() == 2
    source.add("2,99,9,9,C,2024-01-02 00:00:00", "3,15,3,6,A,2024-01-02 00:00:00", ",1,1,1,A,2024-01-02 00:00:00")
    out = source.run()
    assert rows(out.select("id", "value_1")) == [(1, 10), (2, 20), (3, 15)]
    assert out.filter("processed_timestamp IS NULL").count() == 0
    assert source.spark.read.parquet(source.path("bronze")).count() == 5
    assert read_csv(source.spark, source.path("in"), source.schema).count() == 5


@pytest.mark.parametrize("salts", [0, 8])
def test_survivor_without_timestamp_loses_the_key(source, salts):
    source.add("1,10,2,5,A,", "7,10,2,5,A,2024-01-01 00:00:00")
    source.run(salts=salts)
    source.add("1,10,2,5,A,2024-01-01 00:00:00")
    assert rows(source.run(salts=salts).select("id")) == [(7,)]


def test_validate_first_keeps_the_valid_copy(source):
    source.add("1,10,2,5,A,", "7,10,2,5,A,2024-01-01 00:00:00")
    source.run(sequence="validate_first")
    source.add("1,10,2,5,A,2024-01-01 00:00:00")
    assert rows(source.run(sequence="validate_first").select("id")) == [(1,), (7,)]


def test_key_with_very_many_copies(spark, tmp_path):
    df = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("id"),
        F.col("id").alias("n"),
        F.lit(dt.datetime(2024, 1, 1)).alias("event_timestamp"),
    )
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = stream_parquet(spark, str(tmp_path / "in"), df.schema, max_files_per_trigger=1)
    drain(append_to(clean_stream(stream), str(tmp_path / "out"), str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.select("id").distinct().count()


def test_watermark_bounds_the_state(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1))], "id int, event_timestamp timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(
        stream_parquet(spark, str(tmp_path / "in"), df.schema), watermark=("event_timestamp", "1 hour")
    )
    drain(append_to(stream, str(tmp_path / "out"), str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_rule_counters_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1))], "id int, event_timestamp timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(stream_parquet(spark, str(tmp_path / "in"), df.schema), observation="rules")
    query = drain(append_to(stream, str(tmp_path / "out"), str(tmp_path / "c")))
    seen = [p.observedMetrics["rules"] for p in query.recentProgress if p.observedMetrics.get("rules")]
    assert sum(s["failed_valid_timestamp"] for s in seen) == 1
    assert sum(s["failed_valid_id"] for s in seen) == 0


def test_streamed_upsert_equals_the_batch(spark, lake, tmp_path):
    ddl = "id int, value_1 double, value_2 double, value_3 double, category string"
    stamp = F.lit("2024-01-01").cast("timestamp")
    first = spark.createDataFrame([(1, 1.0, 2.0, 3.0, "A"), (2, 2.0, 0.0, 3.0, "B")], ddl)
    second = spark.createDataFrame([(2, 8.0, 2.0, 3.0, "A"), (3, 1.0, 1.0, 1.0, "C")], ddl)
    made = engineer_features(first, stamp)
    lake.create_if_absent("features", made.schema, ["id"])

    def run():
        stream = stream_parquet(spark, str(tmp_path / "in"), first.schema)
        upsert_stream(stream, lake, "features", str(tmp_path / "c"), lambda b: engineer_features(b, stamp))

    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    run()
    wanted = engineer_features(first.filter("id = 1").unionByName(second), stamp)
    assert rows(lake.read("features")) == rows(wanted)
    assert lake.current_version("features") == 2


def test_closed_days_only(spark, tmp_path):
    moments = ["2024-01-01 05:00:00", "2024-01-01 06:00:00", "2024-01-02 03:00:00"]
    df = spark.createDataFrame([(m, 1.0, "m") for m in moments], "t string, p double, m string")
    df = df.withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    windows = daily_windows(stream_parquet(spark, str(tmp_path / "in"), df.schema), "t", "p", "m")
    drain(append_to(windows, str(tmp_path / "out"), str(tmp_path / "c")))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("m", "rows")) == [("m", 2)]
    assert daily_windows(df, "t", "p", "m").count() == 2


def test_values_that_do_not_fit_are_kept(spark, tmp_path):
    lines = ["1,2.5,2024-01-01 00:00:00,x", "1.5,two,yesterday,", ",,,", "4", "5,1.0,2024-01-02 00:00:00,y,more,still", "6,1.0,,z,"]
    (tmp_path / "a.csv").write_text("id,v,at,s\n" + "\n".join(lines) + "\n")
    out = read_csv_kept(spark, str(tmp_path), spark.createDataFrame([], "id int, v double, at timestamp, s string").schema)
    found = {r["id"]: (r["v"], r["s"], r[MISFITS]) for r in out.filter("id IS NOT NULL").collect()}
    assert found == {
        1: (2.5, "x", None),
        4: (None, None, None),
        5: (1.0, "y", {LINE: lines[4]}),
        6: (1.0, "z", None),
    }
    odd = [r[MISFITS] for r in out.filter("id IS NULL").collect()]
    assert {"id": "1.5", "v": "two", "at": "yesterday"} in odd and None in odd and len(odd) == 2


def test_schema_is_inferred_once_and_widened(spark, tmp_path):
    made = jobs.Project.at(Lake(spark, str(tmp_path / "lake")))
    files = tmp_path / "in"
    files.mkdir()

    def run(name, *lines):
        (files / name).write_text("\n".join(lines) + "\n")
        jobs.ingest(made, str(files))
        return {r["id"]: r for r in made.lake.read("raw_data").collect()}

    stamp = "2024-01-01 00:00:00"
    assert run("1.csv", "id,event_timestamp,n", f"1,{stamp},7")[1]["n"] == 7
    # a type that would be inferred otherwise today, and no new column
    found = run("2.csv", "id,event_timestamp,n", f"2,{stamp},many")
    assert found[2]["n"] is None and found[2][MISFITS] == {"n": "many"} and found[1][MISFITS] is None
    found = run("3.csv", '"id","event_timestamp","n","share"', f"3,{stamp},1,0.5")
    assert found[3]["share"] == 0.5 and found[1]["share"] is None and found[3][MISFITS] is None
    # a late file of the old form, and nothing new
    found = run("4.csv", "id,event_timestamp,n", f"4,{stamp},4", f"3,{stamp},9")
    assert found[4]["n"] == 4 and found[4][MISFITS] is None
    jobs.ingest(made, str(files))
    assert made.lake.read("raw_data").count() == 5
    cleaned = made.lake.read("cleaned_data")
    assert rows(cleaned.select("id", "share")) == [(1, None), (2, None), (3, 0.5), (4, None)]
    home = made.lake.checkpoint_path("raw_data") + "-schema"
    assert settled_schema(spark, str(files), home).simpleString() == "struct<id:int,event_timestamp:timestamp,n:int,share:double>"


@pytest.mark.parametrize("watermark", [None, ("t", "1 hour")])
def test_exact_copies_are_spread_by_their_place(spark, tmp_path, watermark):
    df = spark.range(3000).select(F.lit(1).alias("id"), F.lit(dt.datetime(2024, 1, 1)).alias("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_parquet(spark, str(tmp_path / "in"), df.schema, place="p")
    salt = F.pmod(F.xxhash64("p"), F.lit(8))
    batch = spark.read.parquet(str(tmp_path / "in")).select(F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("p"))
    assert batch.select(salt).distinct().count() == 8
    once = dedup_stream(stream, ["id"], watermark, place="p")
    assert once.columns == df.columns
    drain(append_to(once, str(tmp_path / "out"), str(tmp_path / "c")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_misfits_are_gathered_only_for_rows_that_have_one(spark):
    schema = spark.createDataFrame([], "id int, s string").schema
    texts = spark.createDataFrame(
        [("1", "a", None, None), ("x", None, None, None), (None, "b", None, None), ("2", "c", "d", "2,c,d"), ("y", "c", "d", None)],
        "id string, s string, __beyond string, __line string",
    )
    out = typed(texts, schema)
    found = [(r["id"], r["s"], r[MISFITS]) for r in out.collect()]
    odd = [(None, None, {"id": "x"}), (2, "c", {LINE: "2,c,d"}), (None, "c", {"id": "y", LINE: "d"})]
    assert found == [(1, "a", None), odd[0], (None, "b", None), *odd[1:]]
    # whether a row has one is told without a lambda, which is run row by row
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "lambda" not in plan[plan.index("CASE WHEN") : plan.index(" THEN ")]
