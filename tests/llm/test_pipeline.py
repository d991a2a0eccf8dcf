"""Stages of the pipeline on the smallest tables, each held against what the operator's tests hold by hand."""

import corpus_pipeline
import numpy as np
from conftest import DATA
from test_jaccard_join import by_hand as groups_by_hand
from test_personal_data import by_hand as personal_by_hand
from test_suffix_dedup import by_hand as repeats_by_hand


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], DATA).write.parquet(str(tmp_path / str(number)))
        tables.append(spark.read.parquet(str(tmp_path / str(number))))
    raw, spoken, single, cut, clean, packed = ({r["doc_id"]: r["text"] for r in t.collect()} if "text" in t.columns else t.collect() for t in tables)
    assert all(t.columns == columns for t in tables[:-1])
    assert set(spoken) == {d for d, t in raw.items() if any(c.isalpha() for c in t)}

    stays = {component for _, _, component in groups_by_hand(list(spoken.items()))}
    assert set(single) == stays

    ids = sorted(single)
    sizes = repeats_by_hand([single[d] for d in ids], corpus_pipeline.PASSAGE_BYTES)
    assert set(cut) == {d for d, (n, gone, *_) in zip(ids, sizes, strict=True) if gone == 0 or gone < n}
    assert all(cut[d] == single[d] for d, (_, gone, *_) in zip(ids, sizes, strict=True) if gone == 0)

    assert set(clean) == set(cut)
    assert all(not personal_by_hand(t) for t in clean.values())
    assert all(clean[d] == t for d, t in cut.items() if not any(c.isdigit() or c == "@" for c in t))
    assert {r["doc_id"] for r in packed} == set(clean)
    used = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= 1.02 * np.ceil(sum(used.values()) / 2048) + 1
    assert all(r["n_chars"] == len(r["text"]) for r in tables[-2].collect())


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
    assert docs.count() == 0


def test_unlabelled_language_stays(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = docs.limit(1).selectExpr("-1L as doc_id", "'Широкая электрификация южных губерний даст мощный толчок' as text", "cast(null as string) as lang", "source", "n_chars")
    docs.unionByName(more).write.parquet(str(tmp_path / "t"))
    kept = corpus_pipeline.identify_language(spark, spark.read.parquet(str(tmp_path / "t")), DATA)
    assert kept.where("doc_id = -1").count() == 1


def test_language_found_decides_what_is_packed_together(spark, tmp_path):
    words = {"en": "the house and the garden are here with them", "de": "das Haus und der Garten sind hier mit ihnen"}
    # every second row has no label
    rows = [(100 * i + j, f"{words[name]} {'abcdefghij'[j]}", [name, None][j % 2], "s", 1) for i, name in enumerate(words) for j in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "t"))
    found = corpus_pipeline.identify_language(spark, spark.read.parquet(str(tmp_path / "t")), DATA)
    found.write.parquet(str(tmp_path / "found"))
    spoken = spark.read.parquet(str(tmp_path / "found"))
    assert {r["doc_id"]: r["lang"] for r in spoken.collect()} == {100 * i + j: name for i, name in enumerate(words) for j in range(10)}
    packed = corpus_pipeline.pack_sequences(spark, spoken, DATA).collect()
    tongues = {}
    for r in packed:
        tongues.setdefault(r["sequence_id"], set()).add(r["doc_id"] // 100)
    assert len(packed) == 20 and sorted(map(tuple, tongues.values())) == [(0,), (1,)]
