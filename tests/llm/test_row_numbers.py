"""Row numbers do not depend on how many cores read a table, so joins by them hold when executors come or go."""

import pytest
from pyspark.sql import functions as F
from tablemill.llm import jaccard_join, language, packing, personal_data, sharding, store, suffix_dedup

CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "many files %20")
    line = "call +1 (555) 010-4477 or mail to someone@example.org about the garden and the house "
    text = F.concat(F.lit("text "), F.xxhash64("id").cast("string"), F.lit(" "), F.repeat(F.lit(line), 6))
    alone = F.concat_ws(" ", *[F.concat(F.lit("w"), F.hash("id", F.lit(i)).cast("string")) for i in range(40)])
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(alone).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    rows.repartition(40).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def changing_cores(spark, monkeypatch):
    """Each table an operator writes is followed by reads with another number of cores."""
    plain, turn = store.Workspace.write, [4, 32, 1, 16]

    def write(self, df):
        out = plain(self, df)
        turn.append(turn.pop(0))
        self.spark.conf.set(CORES, turn[0])
        return out

    monkeypatch.setattr(store.Workspace, "write", write)
    spark.conf.set(CORES, 4)
    yield
    spark.conf.unset(CORES)


def test_numbers(spark, docs):
    found = []
    for cores in (4, 32):
        spark.conf.set(CORES, cores)
        found.append(sorted(tuple(r) for r in store.numbered(docs, store.Workspace(spark, "t")).select("doc_id", store.ROW).collect()))
    spark.conf.unset(CORES)
    assert found[0] == found[1] and len({row for _, row in found[0]}) == 400
    # what is no table of files, or has several rows of one place, is written first
    twice = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))
    both = docs.select("doc_id").unionByName(docs.select("doc_id"))
    for odd in (twice, both, spark.range(800)):
        assert store.numbered(odd, store.Workspace(spark, "t")).select(store.ROW).distinct().count() == 800


OPERATORS = {
    "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d, with_text=False),
    "jaccard_join": lambda d: jaccard_join.near_duplicates(d.select("doc_id", "text")),
    "one_of_each": lambda d: jaccard_join.one_of_each(d),
    "sharding": lambda d: sharding.shuffled_shards(d, 4, bucket_bytes=20_000),
    "personal_data": lambda d: personal_data.find(d.select("doc_id", "text")),
    "redact": lambda d: personal_data.redact(d),
    "packing": lambda d: packing.pack(d, 256, with_ids=False),
    "language": lambda d: language.identify(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_same_rows_whatever_the_cores(spark, docs, name, request):
    def rows():
        return sorted((tuple(r) for r in OPERATORS[name](docs).collect()), key=repr)

    steady = rows()
    request.getfixturevalue("changing_cores")
    assert rows() == steady and steady
