from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tablemill.operators.changes import change_feed
from tablemill.sources.files import list_tables
from tablemill.sources.lake import Conflict
from tablemill.sources.registry import Registry

DDL = "id int, v double"
BEFORE = [(1, 1.0), (2, 2.0), (3, None)]
UPDATE = [(2, 5.0), (4, 9.0), (3, None)]
AFTER = [(1, 1.0), (2, 5.0), (3, None), (4, 9.0)]


@pytest.fixture(params=[1, 3])
def keyed(lake, spark, request):
    schema = spark.createDataFrame([], DDL).schema
    assert lake.create_if_absent("t", schema, ["id"], buckets=request.param)
    assert not lake.create_if_absent("t", schema, ["id"], buckets=request.param)
    assert rows(lake.read("t")) == [] and lake.current_version("t") == 0
    lake.upsert("t", spark.createDataFrame(BEFORE, DDL))
    return lake


def test_upsert_and_change_feed(keyed, spark):
    keyed.upsert("t", spark.createDataFrame(UPDATE, DDL))
    assert rows(keyed.read("t")) == AFTER
    assert rows(keyed.read("t", 1)) == sorted(BEFORE, key=repr)
    assert rows(keyed.changes("t", 1)) == [
        (2, 2.0, "update_preimage", 2),
        (2, 5.0, "update_postimage", 2),
        (4, 9.0, "insert", 2),
    ]
    assert rows(keyed.changes("t", 0, 1).select("id", "_change_type")) == [
        (1, "insert"), (2, "insert"), (3, "insert"),
    ]


def test_same_update_twice_changes_nothing(keyed, spark):
    for _ in range(2):
        keyed.upsert("t", spark.createDataFrame(UPDATE, DDL))
    assert rows(keyed.read("t")) == AFTER
    assert rows(keyed.changes("t", 2)) == []


def test_bad_keys_leave_the_table_alone(keyed, spark):
    for bad in ([(2, 5.0), (2, 6.0)], [(None, 1.0)]):
        with pytest.raises(ValueError):
            keyed.upsert("t", spark.createDataFrame(bad, DDL))
        with pytest.raises(ValueError):
            keyed.overwrite("t", spark.createDataFrame(bad, DDL))
    with pytest.raises(ValueError):
        keyed.upsert("t", spark.createDataFrame([(1,)], "id int"))
    assert rows(keyed.read("t")) == sorted(BEFORE, key=repr) and keyed.current_version("t") == 1


def test_overwrite_and_deletes(keyed, spark):
    keyed.overwrite("t", spark.createDataFrame([(2, 2.0), (7, 1.0)], DDL))
    assert rows(keyed.read("t")) == [(2, 2.0), (7, 1.0)]
    assert rows(keyed.changes("t", 1).select("id", "_change_type")) == [
        (1, "delete"), (3, "delete"), (7, "insert"),
    ]


def test_replayed_batch_is_skipped(keyed, spark):
    first = spark.createDataFrame([(9, 9.0)], DDL)
    keyed.upsert("t", first, writer="w", batch_id=5)
    keyed.upsert("t", spark.createDataFrame([(9, 0.0)], DDL), writer="w", batch_id=5)
    keyed.upsert("t", spark.createDataFrame([(8, 8.0)], DDL), writer="other", batch_id=5)
    assert rows(keyed.read("t").filter("id > 7")) == [(8, 8.0), (9, 9.0)]


def test_bucketed_upsert_leaves_other_buckets_alone(lake, spark):
    schema = spark.createDataFrame([], DDL).schema
    lake.create_if_absent("t", schema, ["id"], buckets=8)
    everything = spark.range(200).select(F.col("id").cast("int").alias("id"), F.lit(0.0).alias("v"))
    lake.overwrite("t", everything)
    before = lake._commit("t", None).parts
    lake.upsert("t", spark.createDataFrame([(3, 1.0)], DDL))
    after = lake._commit("t", None).parts
    assert sum(before[b] != after[b] for b in before) == 1
    assert lake.read("t").count() == 200


def test_partitioned_table(lake, spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    lake.create_if_absent("p", df.schema, ["id"], buckets=2, partition_by=["day"], properties={"quality": "gold"})
    lake.overwrite("p", df)
    lake.upsert("p", spark.createDataFrame([(2, "c")], "id int, day string"))
    assert rows(lake.read("p")) == [(1, "a"), (2, "c")]
    assert lake.meta("p")["properties"] == {"quality": "gold"}


def test_change_feed_compares_null_safely(spark):
    old = spark.createDataFrame([(1, None), (2, 1.0)], DDL)
    new = spark.createDataFrame([(1, None), (2, None)], DDL)
    assert rows(change_feed(old, new, ["id"])) == [(2, 1.0, "update_preimage"), (2, None, "update_postimage")]


def test_listing_and_views(keyed, spark):
    assert rows(keyed.tables().select("table")) == [("t",)]
    keyed.register_view("t", "lake_view_t")
    assert spark.table("lake_view_t").count() == 3
    assert "lake_view_t" in [r["tableName"] for r in list_tables(spark).collect()]


def test_registry(lake):
    registry = Registry(lake)
    with pytest.raises(LookupError):
        registry.challenger("m", "KMeans")
    other = registry.log_run({"model_type": "external"}, {"a": 1.0})
    registry.register_version("m", other, "p1")
    with pytest.raises(LookupError):
        registry.challenger("m", "KMeans")
    mine = registry.log_run({"model_type": "KMeans", "k": 3}, {}, {"elbow": [(2, 5.0), (3, 4.0)]})
    for _ in range(9):
        registry.register_version("m", mine, "p2")
    registry.register_version("m", other, "p3")
    assert registry.challenger("m", "KMeans") == 10
    assert registry.alias_version("m") is None
    registry.set_alias("m", "champion", 10)
    registry.set_alias("m", "champion", 2)
    assert registry.alias_version("m") == 2
    assert registry.version("m", 1).path == "p1"
    assert rows(registry.table("run_metric_history").select("step", "value")) == [(2, 5.0), (3, 4.0)]


def test_runs_of_parallel_jobs_are_all_kept(lake):
    registry = Registry(lake)
    with ThreadPoolExecutor(3) as pool:
        logged = list(pool.map(lambda i: registry.log_run({"i": i}, {"v": i}), range(30)))
    assert sorted(r["run_id"] for r in registry.table("runs").collect()) == sorted(logged)


def test_parallel_registrations_get_different_numbers(lake):
    registry = Registry(lake)
    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(lambda i: registry.register_version("a b/%", f"r{i}", f"p{i}"), range(30)))
    assert sorted(made) == list(range(1, 31))
    stored = {r["version"]: r["path"] for r in registry.table("model_versions").collect()}
    assert stored == {version: f"p{i}" for i, version in enumerate(made)}


def test_parallel_appends_are_all_kept(lake, spark):
    lake.create_if_absent("log", spark.range(1).schema)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: lake.append("log", spark.range(i, i + 1), f"w{i}", 0), range(12)))
    assert sorted(r["id"] for r in lake.read("log").collect()) == list(range(12))
    assert lake.current_version("log") == 12
    lake.append("log", spark.range(1), "w3", 0)
    assert lake.current_version("log") == 12


def test_second_writer_of_a_keyed_table_is_refused(keyed, spark, monkeypatch):
    stale, before = keyed._commit("t", None), rows(keyed.read("t"))
    update = keyed.read("t").limit(1)
    keyed.upsert("t", update)
    monkeypatch.setattr(type(keyed), "_commit", lambda self, name, version: stale)
    with pytest.raises(Conflict):
        keyed.upsert("t", update)
    monkeypatch.undo()
    assert rows(keyed.read("t")) == before
