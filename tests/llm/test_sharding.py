from collections import Counter

import numpy as np
import pytest
from tablemill.llm import sharding

SCHEMA = "doc_id long, text string, shard string, place string"


@pytest.mark.parametrize(("shards", "bucket_bytes"), [(16, 8 << 20), (5, 300), (1, 1)])
def test_every_row_has_a_place(spark, shards, bucket_bytes):
    rows = [(i, f"text {i}", "a", "b") for i in range(100)] + [(7, "same", "a", "b")] * 40 + [(None, None, None, None)] * 3
    out = sharding.shuffled_shards(spark.createDataFrame(rows, SCHEMA), shards, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, t) for i, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert out.columns == ["doc_id", "text", "place", "shard", "slot"]


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i, "a", "b") for i in range(50)], SCHEMA)
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(50))
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_orders_are_equally_likely():
    seen = Counter(tuple(sharding.fisher_yates(4, np.random.default_rng([1, i])).tolist()) for i in range(4800))
    assert len(seen) == 24 and min(seen.values()) > 130 and max(seen.values()) < 275


def test_empty(spark):
    assert sharding.shuffled_shards(spark.createDataFrame([], SCHEMA)).count() == 0
