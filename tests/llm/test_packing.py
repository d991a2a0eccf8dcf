import zlib

import numpy as np
import public_tokenizers
import pytest
from tablemill.llm import packing
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, length string, ids string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  ", "one", " one two  three\n\n four\tfive \n", "it's don't 12 3456 x", "é ü 漢字 🙂 a b", "a <|endoftext|> b", "trailing ", "\n", "word " * 5000, "x" * 3000]


@pytest.mark.parametrize("ranks", [None, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_ids_are_the_tokenizers(spark, ranks, monkeypatch):
    plain = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS] + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    encoder = packing.Encoder(PATH, ranks)
    for _ in range(2):  # again with the words known
        assert [f.tolist() for f in encoder.ids(texts)] == wanted
    assert [f.tolist() for t in texts for f in encoder.ids([t])] == wanted
    monkeypatch.setattr(packing, "WORDS", 3)
    assert [f.tolist() for f in encoder.ids(texts)] == wanted and encoder.ids([]) == []


@pytest.mark.parametrize("capacity", [2048, 7, 1])
def test_pack(spark, capacity):
    rows = [(i, t, "a", "b") for i, t in enumerate(TEXTS * 3)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity).collect()
    plain = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for i, text, *_ in rows:
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for r in pieces for x in r["ids"]] == ids
        assert [r["start"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert all(r["length"] == capacity for r in pieces[1:])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_and_little_more(seed):
    draw = np.random.default_rng(seed)
    capacity = 2048
    kinds = [draw.lognormal(5, 1.2, 30_000), draw.integers(1, 2049, 5_000), np.full(50, 1025), draw.integers(700, 1400, 20_000), [3, 2048], []][seed]
    histogram = np.bincount(np.clip(np.asarray(kinds, dtype=np.int64), 1, capacity), minlength=capacity + 1)
    planned = packing.plan(histogram, capacity)
    used = np.zeros_like(histogram)
    for pattern, times in planned:
        assert times > 0 and sum(pattern) <= capacity
        used += times * np.bincount(pattern, minlength=capacity + 1)
    assert (used == histogram).all()
    total = sum(t for _, t in planned)
    simple = sum(t for _, t in packing.best_fit(histogram, capacity))
    floor = max(-(-int((histogram * np.arange(capacity + 1)).sum()) // capacity), int(histogram[capacity // 2 + 1 :].sum()))
    print(seed, total, simple, floor)
    assert total <= max(simple * 1.005 + 1, floor * 1.01)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
