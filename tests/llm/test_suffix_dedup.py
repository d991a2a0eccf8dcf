import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from tablemill.llm.suffix_dedup import equal_neighbours, remove_repeats
from tablemill.session import scratch_home

SCHEMA = "doc_id long, text string, kept string, n_spans string"


def by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(gone & ~np.concatenate(([False], gone[:-1])))) if len(d) else 0
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 8))) for _ in range(60)]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    base = prose(120)
    texts = [None, "", "short", base, base, base[:-1], "é" * 700, "ab" * 300, prose(400)]
    for _ in range(25):
        at = draw.randrange(len(base))
        texts.append(base[:at] + draw.choice("xyz") + base[at + 1 :])
    for _ in range(15):
        at = draw.randrange(200)
        texts.append(prose(draw.randint(5, 60)) + base[at : at + draw.randint(30, 400)] + prose(draw.randint(5, 60)))
    return texts


@pytest.mark.parametrize(("length", "spread", "crowd"), [(100, 40, 4096), (100, 76, 3), (60, 30, 1)])
def test_as_by_hand(spark, tmp_path, length, spread, crowd):
    texts = corpus(length)
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d"))
    out = remove_repeats(spark.read.parquet(str(tmp_path / "d")), length, spread, crowd)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = {r["doc_id"]: r for r in out.collect()}
    for i, wanted in enumerate(by_hand(texts, length)):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == wanted, i
        if wanted[1] == 0:
            assert r["text"] == texts[i]


def test_only_the_lists_of_spans_stay(spark, tmp_path):
    spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(corpus(1))], SCHEMA).write.parquet(str(tmp_path / "d"))
    home = Path(re.sub("^file:/+", "/", scratch_home(spark)))
    before = set(home.glob("*/*"))
    out = remove_repeats(spark.read.parquet(str(tmp_path / "d")), 100, 40, 3)
    left = set(home.glob("*/*")) - before
    assert [spark.read.parquet(str(f)).columns for f in left] == [["_op_row", "spans"]]
    assert out.where("n_removed > 0").count() > 10


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    assert remove_repeats(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_multikey_sort():
    draw = np.random.default_rng(1)
    labels, tokens = draw.integers(0, 3, 500), [draw.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    keys = list(zip(labels, *tokens, strict=True))
    count = Counter(keys)
    assert equal_neighbours(labels, tokens).tolist() == [count[k] > 1 for k in keys]


def test_parameters():
    with pytest.raises(ValueError):
        remove_repeats(None, 100, 90)
