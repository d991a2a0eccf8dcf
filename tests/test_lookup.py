import datetime as dt
import random

import pytest

from conftest import rows
from tablemill.operators.lookup import Lookup, asof_lookup, training_set


def test_missing_feature_row_gives_nulls(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id int, target int")
    features = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, f double")
    out = training_set(labels, [Lookup(features, "id")], label="target")
    assert rows(out) == [(1, 0, 1.0), (2, 1, 2.0), (3, 1, None)]


def test_colliding_names_and_unknown_label_fail(spark):
    labels = spark.createDataFrame([(1, 0)], "id int, target int")
    features = spark.createDataFrame([(1, 1)], "id int, target int")
    with pytest.raises(ValueError):
        training_set(labels, [Lookup(features, "id")])
    with pytest.raises(ValueError):
        training_set(labels, [], label="y")


def stamp(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_asof_edges(spark, hot_rows):
    left = spark.createDataFrame(
        [(1, stamp(10), "tie"), (2, stamp(5), "none earlier"), (3, stamp(30), "two earlier"), (None, stamp(1), "no key")],
        "k int, ts timestamp, what string",
    )
    right = spark.createDataFrame(
        [(1, stamp(10), 1.0), (2, stamp(6), 2.0), (3, stamp(10), 3.0), (3, stamp(20), 4.0), (None, stamp(0), 9.0)],
        "k int, rts timestamp, v double",
    )
    out = asof_lookup(left, right, ["k"], "ts", "rts", ["v"], hot_rows=hot_rows)
    found = {r["what"]: r["v"] for r in out.collect()}
    assert found == {"tie": 1.0, "none earlier": None, "two earlier": 4.0, "no key": None}
    recent = asof_lookup(left, right, ["k"], "ts", "rts", ["v"], max_lookback_seconds=300, hot_rows=hot_rows)
    found = {r["what"]: r["v"] for r in recent.collect()}
    assert found == {"tie": 1.0, "none earlier": None, "two earlier": None, "no key": None}


def test_asof_with_one_key_holding_most_rows(spark):
    """Brute force against both paths, with many rows at one instant."""
    draw = random.Random(7)
    keys = [0] * 6 + [1, 2, 3]
    left = [(draw.choice(keys), stamp(draw.randrange(60)), i) for i in range(900)]
    right = [(draw.choice(keys), stamp(draw.choice([3, 3, 3, draw.randrange(60)])), float(i)) for i in range(600)]
    wanted = []
    for k, ts, i in left:
        fitting = [(rts, v) for rk, rts, v in right if rk == k and rts <= ts]
        best = max(fitting) if fitting else (None, None)
        wanted.append((k, ts, i, *best))
    l = spark.createDataFrame(left, "k int, ts timestamp, i int").repartition(6)
    r = spark.createDataFrame(right, "k int, rts timestamp, v double").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        # keep the range partitions apart, so that keys and instants span several of them
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for hot_rows in (None, 200):
            out = asof_lookup(l, r, ["k"], "ts", "rts", ["v"], hot_rows=hot_rows)
            assert rows(out) == sorted(wanted, key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
