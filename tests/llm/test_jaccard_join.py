import random
import re

import pytest
from tablemill.llm import jaccard_join
from tablemill.llm.components import components
from tablemill.llm.store import Workspace

SCHEMA = "doc_id long, text string, n_shingles string, shingle string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def by_hand(docs):
    found = [sets(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(docs):
        mine = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((doc, len(found[i]), min(mine) if mine else None))
    return sorted(out, key=repr)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]

    def prose(n):
        return [draw.choice(vocabulary) for _ in range(n)]

    texts = [None, "", " \t", "One", "one", "two words", "Two\x0bWORDS", "É é\x1cx", "a b c d e"]
    for _ in range(12):
        base = prose(draw.randint(20, 160))
        for _ in range(draw.randint(1, 12)):
            words = list(base)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append(" ".join(words[: draw.randint(int(len(words) * 0.8), len(words))]))
    passage = prose(60)
    texts += [" ".join(prose(draw.randint(0, 60)) + passage + prose(draw.randint(0, 60))) for _ in range(60)]
    texts += [texts[40]] * 5
    draw.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[50]), (None, "nobody else says this at all today")]


@pytest.mark.parametrize(("seed", "crowd"), [(1, 64), (2, 64), (3, 3), (4, 3), (5, 1), (6, 0)])
def test_as_by_hand(spark, tmp_path, seed, crowd):
    docs = corpus(seed)
    spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    found = jaccard_join.near_duplicates(table, crowd=crowd)
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()]
    assert sorted(rows, key=repr) == by_hand(docs)


def test_one_of_each(spark, tmp_path):
    docs = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None), (8, ""), (None, "x y z"), (5, "x y z")]
    spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA).write.parquet(str(tmp_path / "d"))
    kept = jaccard_join.one_of_each(spark.read.parquet(str(tmp_path / "d")))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a b c d e f"), (5, "x y z"), (8, ""), (9, None)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    assert jaccard_join.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = "Ab cde\tf " * 300
    whole = jaccard_join.word_hashes(text).tolist()
    monkeypatch.setattr(jaccard_join, "PIECE", 50)
    assert jaccard_join.word_hashes(text).tolist() == whole


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 40), (40, 70)]
    found = components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "t"))
    assert sorted(tuple(r) for r in found.collect()) == [(i, 0) for i in range(21)] + [(40, 40), (70, 40), (100, 40)]
