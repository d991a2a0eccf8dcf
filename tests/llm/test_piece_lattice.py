import itertools

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tablemill.llm import piece_lattice
from tablemill.llm.queries import op8_piece_lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = piece_lattice.Pieces(PATH)
TEXTS = ["", "a", "hello there", "  two  spaces ", "tab\tand\nline", "漢字 and 🙂🙂", "é ü ñ", "x" * 70, " ", "\x00 \x7f"]


def all_ways(text, MODEL=MODEL):
    """Every segmentation of a text by trying all."""
    text = piece_lattice.normalised(text)
    ends = [[] for _ in range(len(text) + 1)]
    ends[0] = [(0.0, ())]
    for end in range(1, len(text) + 1):
        for start in range(end):
            if text[start:end] in MODEL.ids:
                i = MODEL.ids[text[start:end]]
                ends[end] += [(s + MODEL.scores[i], p + (i,)) for s, p in ends[start]]
            elif end == start + 1:
                spelt = tuple(MODEL.bytes[b] for b in text[start].encode())
                ends[end] += [(s + sum(MODEL.scores[i] for i in spelt), p + spelt) for s, p in ends[start]]
    return sorted(ends[-1], key=lambda p: (-p[0], p[1]))


@pytest.mark.parametrize("text", ["", "ab", "a b", "the cat", "is it", "añb c", "é漢", "a  b"])
def test_n_best_are_the_best(text):
    wanted = all_ways(text)
    found = MODEL.n_best(text, 6)
    assert [s for s, _ in found] == [s for s, _ in wanted[:6]]
    assert len({p for _, p in found}) == len(found)
    assert {p for _, p in found} <= {p for _, p in wanted}


@pytest.mark.parametrize("text", ["ab", "aaaaaaaa", "abababab", "thethe", "é漢"])
def test_ties_in_order_of_ids(text):
    assert MODEL.search(piece_lattice.normalised(text), 12) == all_ways(text)[:12]


def test_long_word():
    found = MODEL.search("ab" * 5000, 4)
    assert len(set(found)) == 4 and found == sorted(found, key=lambda p: (-p[0], p[1]))


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for _, ids in MODEL.n_best(text, 4):
        assert MODEL.decode(ids) == text == library.decode(list(ids))


@pytest.mark.parametrize("text", TEXTS + ["x\n\ny. Z,w", "trailing  ", "\u2581a\u2581 b", "a.b).c 1.2,x ...\n\n,é."])
def test_units_make_up_the_text_and_no_piece_is_cut(text):
    whole = piece_lattice.normalised(text)
    found = MODEL.unit.findall(whole)
    assert "".join(found) == whole and all(found)
    cuts = {sum(map(len, found[:i])) for i in range(1, len(found))}
    for start in range(len(whole)):
        for end in range(start + 1, min(len(whole), start + MODEL.longest) + 1):
            assert whole[start:end] not in MODEL.ids or not cuts & set(range(start + 1, end))


def test_units_are_cut_at_signs():
    assert MODEL.unit.findall("▁ends.\nThe▁x,y") == ["▁ends", ".\n", "The", "▁x", ",", "y"]


def test_by_log_probabilities():
    draw = np.random.default_rng(4)
    own = piece_lattice.Pieces(PATH, (np.rint(draw.uniform(-12, -3, len(MODEL.texts)) * 2**20) / 2**20).tolist())
    for text in ["the cat", "aaaaaaaa", "abab is", "é漢 x", "unbelieva"]:
        wanted = all_ways(text, own)
        found = own.n_best(text, 5)
        assert [s for s, _ in found] == [s for s, _ in wanted[:5]]
        assert set(found) <= set(wanted) and len(set(found)) == len(found)


def test_words_are_remembered_in_two_generations(monkeypatch):
    monkeypatch.setattr(piece_lattice, "CACHE", 3)
    made = []
    kept = piece_lattice.Remembered(lambda words: made.extend(words) or [w.upper() for w in words])
    for _ in range(4):
        assert kept.all(["a", "b", "a", "c"]) == ["A", "B", "A", "C"]
    assert made == ["a", "b", "c"]
    assert kept.all(["d", "e", "f", "a"]) == ["D", "E", "F", "A"] and kept.all(["g"]) == ["G"] and made == list("abcdefg")


def test_probabilities_count_all_rows(spark):
    texts = ["the cat the", None, "", "the dog 漢", "the cat the"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    seen = np.ones(len(MODEL.texts))
    for t in texts:
        for i in library.encode(t or ""):
            seen[i] += 1
    assert np.abs(piece_lattice.log_probabilities(df) - np.log(seen / seen.sum())).max() < 1e-6
    assert np.abs(np.exp(piece_lattice.log_probabilities(df)).sum() - 1) < 1e-3


def test_own_encoding_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = op8_piece_lattice(spark, "/root/testdata/sf0.01").select("doc_id", "own_ids", "round_trip", "scores").toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id")["text"]
    probability = piece_lattice.log_probabilities(docs)
    assert rows["round_trip"].all() and len(rows) == len(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "")
        assert rows["own_ids"][doc_id] == ids
        assert rows["scores"][doc_id][0] >= probability[ids].sum() - 1e-6


def test_tables(spark):
    rows = [(1, t, "x") for t in TEXTS] + [(2, None, None), (1, TEXTS[2], "x")]
    out = piece_lattice.encode(spark.createDataFrame(rows, "conv_id long, text string, scores string"), 3)
    assert out.columns == ["conv_id", "n_best", "scores", "ids_crc32", "round_trip", "own_ids"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    assert all(a >= b for r in got for a, b in itertools.pairwise(r["scores"]))
    back = piece_lattice.decode(out.selectExpr("conv_id", "n_best[0] as ids")).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, _ in rows)
    assert piece_lattice.encode(spark.createDataFrame([], "conv_id long, text string")).count() == 0


def test_query_encodes_documents(spark, tmp_path):
    spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in op8_piece_lattice(spark, str(tmp_path)).collect()}
    own = piece_lattice.Pieces(PATH, piece_lattice.log_probabilities(spark.read.parquet(str(tmp_path / "documents.parquet"))).tolist())
    assert [tuple(p) for p in found[1]["n_best"]] == [p for _, p in own.n_best("hello there", 4)] and found[1]["round_trip"]
    nulls = spark.createDataFrame([([5, 6],), (None,)], "ids array<int>")
    assert [r["text"] is None for r in piece_lattice.decode(nulls).collect()] == [False, True]
    assert found[2]["scores"] == [0.0]


def test_long_texts_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(piece_lattice, "HELD", 5)
    texts = ["hello there you all", None, "a", "a b c d e f", ""]
    given = list(piece_lattice._encoded(PATH, 4)([pd.DataFrame({"doc_id": range(5), "text": texts})]))
    assert len(given) > 2 and [i for part in given for i in part["doc_id"]] == list(range(5))
    assert [tuple(p[0]) for part in given for p in part["_op_ids"]] == [MODEL.n_best(t or "", 4)[0][1] for t in texts]


@pytest.mark.parametrize("n", [1, 3, 4, 6])
def test_units_abreast_as_one_by_one(n):
    draw = np.random.default_rng(7)
    scores = (np.rint(draw.uniform(-12, -3, len(MODEL.texts)) * 2) / 2).tolist()  # with many ties
    words = ["aaaaaaaa", "a", "é漢🙂", "▁the", "\n", "thethe", "▁▁", "x\0y", "ab" * 32, "漢a漢"]
    own = piece_lattice.Pieces(PATH, scores)
    wanted = [own.search(w, n) for w in words]
    own.search = None
    found = own.abreast(words, n)
    for w, (_, score, best, _, m), unit in zip(wanted, found, found, strict=True):
        paths = piece_lattice._paths(unit) if m > 1 else [(score, np.frombuffer(best, dtype="<i4"))]
        assert [(s, tuple(ids.tolist())) for s, ids in paths] == w


def test_no_short_unit_is_searched_for_itself(monkeypatch):
    scores = np.rint(np.log(np.full(len(MODEL.texts), 1 / 32000)) * 2**20) / 2**20
    texts = ["the cat, the dog", "a" * 70, None, "é.\nThe"]
    asked = []
    plain = piece_lattice.Pieces.search
    monkeypatch.setattr(piece_lattice.Pieces, "search", lambda self, word, n: asked.append(word) or plain(self, word, n))
    for part in piece_lattice._encoded(PATH, 4, scores.tobytes())([pd.DataFrame({"doc_id": range(4), "text": texts})]):
        assert part["_op_same"].all()
    assert asked == ["▁" + "a" * 70]


@pytest.mark.parametrize("text", TEXTS + ["x\n\ny. Z,w", "trailing  ", "\u2581a\u2581 b"])
def test_own_ids_by_words(text):
    words = MODEL.word.findall(piece_lattice.normalised(text))
    assert b"".join(MODEL.own_of_words(words)) == MODEL.own(text).tobytes()
    assert (MODEL.own_counts([text, None, text]) == 2 * np.bincount(MODEL.own(text), minlength=32000)).all()


def test_all_ways_only_of_units_to_depart_in(monkeypatch):
    scores = np.rint(np.log(np.full(len(MODEL.texts), 1 / 32000)) * 2**20) / 2**20
    texts = ["the cat sat on that very mat, and the dog did not see any of it", None, "", "one two three four five six"]
    own = piece_lattice.Pieces(PATH, scores.tolist())
    wanted = [own.n_best(t or "", 4) for t in texts]
    asked = []
    plain = piece_lattice.Pieces.abreast
    monkeypatch.setattr(piece_lattice.Pieces, "abreast", lambda self, words, n: asked.extend(words) or plain(self, words, n))
    part = pd.concat(piece_lattice._encoded(PATH, 4, (scores - 1).tobytes())([pd.DataFrame({"text": texts})]))
    assert len(asked) <= 3 * 2 and [len(p) for p in part["_op_ids"]] == [4, 1, 1, 4] == [len(w) for w in wanted]


def test_words_asked_for_most_are_remembered(monkeypatch):
    monkeypatch.setattr(piece_lattice, "CACHE", 3)
    asked = []

    def make(words):
        asked.extend(words)
        values, sizes = np.frombuffer("".join(words).encode(), dtype=np.uint8), np.array([len(w) for w in words], dtype=np.int64)
        return [w.upper() for w in words], (values, sizes)

    kept = piece_lattice.Words(make)
    for words in (["ab", "c", "ab", "def"], ["g", "ab", "def", "h"], ["c", "ab", "i", "j"], ["ab", "def", "c", "k"], [], ["i"]):
        found = kept.all(words)
        assert [kept.cut[i] for i in found] == [w.upper() for w in words]
        assert b"".join(r.tobytes() for r in kept.of(0, found, np.arange(len(found) + 1))).decode() == "".join(words)
        assert len(kept.cut) == len(kept.hits) == len(kept.number)
    assert asked == ["ab", "c", "def", "g", "h", "i", "j", "k", "i"]


def test_words_that_could_not_be_made_are_made_again():
    def make(words):
        if "bad" in words:
            raise ValueError("bad")
        return list(words), (np.zeros(len(words)), np.ones(len(words), dtype=np.int64))

    kept = piece_lattice.Words(make)
    kept.all(["a"])
    with pytest.raises(ValueError):
        kept.all(["b", "bad"])
    assert kept.all(["b", "a", "c"]).tolist() == [1, 0, 2] and kept.cut == ["a", "b", "c"]


@pytest.mark.parametrize("text", TEXTS + ["trailing  ", "a ", " a", "a  b", "\u2581a\u2581 b", "\u2581\u2581"])
def test_bare_words(text):
    assert ["\u2581" + w for w in MODEL.bare(text)] == MODEL.word.findall(piece_lattice.normalised(text))


def test_texts_without_words():
    own = piece_lattice.Pieces(PATH, [-1.0] * len(MODEL.texts))
    assert own.segments([], 4) == [] and own.n_best("", 4) == [(0, ())]


def test_a_unit_of_several_words_is_searched_once(monkeypatch):
    scores = np.rint(np.log(np.full(len(MODEL.texts), 1 / 32000)) * 2**20) / 2**20
    own = piece_lattice.Pieces(PATH, scores.tolist())
    asked = []
    plain = piece_lattice.Pieces.ways
    monkeypatch.setattr(piece_lattice.Pieces, "ways", lambda self, words, n, written: asked.extend(words if written == 1 else ()) or plain(self, words, n, written))
    for texts in (["the cat, the dog"], ["cat. dog, (the", "dog cat"], ["the; dog.\nthe"]):
        own.segments(texts, 4)
    assert len(asked) == len(set(asked)) and {"▁cat", "▁dog", "▁the", "the", "."} <= set(asked)


@pytest.mark.parametrize("cache", [1, 3, 1000])
def test_chains_and_units_are_forgotten_together(monkeypatch, cache):
    scores = np.rint(np.log(np.full(len(MODEL.texts), 1 / 32000)) * 2**20) / 2**20
    texts = ["the cat, the dog", "", "a.b).c 1.2,x ...\n\n,é.", "  two  spaces ", "dog cat " + "x" * 70, "漢字 and 🙂🙂", "the. cat\n", "▁a▁ b"] * 2
    own = piece_lattice.Pieces(PATH, scores.tolist())
    wanted = [own.segments([t], 4)[0] for t in texts]
    monkeypatch.setattr(piece_lattice, "CACHE", cache)
    other = piece_lattice.Pieces(PATH, scores.tolist())
    for i in range(0, len(texts), 3):
        for text, (best, own_ids), (paths, ids) in zip(texts[i : i + 3], wanted[i : i + 3], other.segments(texts[i : i + 3], 4), strict=True):
            assert own_ids.tolist() == ids.tolist() == MODEL.own(text).tolist()
            assert [(s, p.tolist()) for s, p in best] == [(s, p.tolist()) for s, p in paths] == [(s, list(p)) for s, p in own.n_best(text)]
    words, units, _ = other.kept(4)
    assert len(units.cut) == len(units.number) == len(units.hits) == len(units.runs[2][0])
    assert [units.cut[u] for u in words.runs[0][0]] == [u for w in words.cut for u in MODEL.unit.findall("▁" + w)]


def test_written_as_decoded():
    draw = np.random.default_rng(3)
    space = [MODEL.bytes[b] for b in "▁".encode()]
    for ids in [[], space, [MODEL.bytes[0xE2], *space], [*space[:2], 400], [MODEL.bytes[0xF0], *space, 500], *draw.integers(3, 600, (20, 30)).tolist()]:
        assert MODEL.written(np.array(ids, dtype="<i4")) == MODEL.decode(ids)


def test_different_words_of_texts_in_order():
    texts = ["a b a", "", " a", "b  c", "c", "x▁y a", "a "]
    words, times, number, sizes = MODEL.different(texts)
    assert [words[i] for i in number] == [w for t in texts for w in MODEL.bare(t)] and sizes.tolist() == [len(MODEL.bare(t)) for t in texts]
    assert times.tolist() == np.bincount(number, minlength=len(words)).tolist()
