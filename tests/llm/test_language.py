import numpy as np
import pytest
from conftest import DATA
from tablemill.llm import language
from tablemill.llm.queries import op10_language

PAGES = "doc_id long, text string, lang string, source string, language string, url string"


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.identify(docs).collect()
    assert len(found) == docs.count()
    right = [r["language"] == r["lang"] for r in found]
    assert np.mean(right) > 0.98
    assert np.mean([r["accepted"] for r in found]) > 0.98


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "if(doc_id % 2 = 0, lang, null) as known")
    found = language.identify(docs, label="known", declared="known").where("doc_id % 2 = 1").collect()
    assert np.mean([r["language"] == r["lang"] for r in found]) > 0.95


def test_evidence_beside_the_text(spark):
    rows = [(i, "the house and the garden are here with them", "en", None, None, f"http://a{i % 3}.site.co/{i}") for i in range(40)]
    rows += [(100 + i, "das Haus und der Garten sind hier mit ihnen", "de", None, None, f"http://b{i % 3}.seite.de/{i}") for i in range(40)]
    rows += [(200, "xy", None, None, None, "http://b1.seite.de/x"), (201, "xy", None, None, None, "http://neu.seite.de/x"), (202, "ok", "en", None, None, None)]
    rows += [(300, None, "en", None, None, None), (301, "", None, None, None, None), (302, "12 345 --", "de", None, None, "http://b1.seite.de/")]
    rows += [(303, "ЖЦЩ ЪЫЭ ЮЯЖ ЦЩЪ", None, None, None, None), (None, "the garden", "en", None, "own", "no address")] * 2
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, PAGES), host=None, address="url").collect()}
    assert (out[200]["language"], out[201]["language"], out[202]["language"]) == ("de", "de", "en")
    assert out[0]["language"] == "en" and out[100]["language"] == "de" and out[0]["confidence"] > 0.9
    assert not any(out[i]["accepted"] for i in (300, 301, 302, 303))
    assert out[300]["text_language"] is None and out[None]["language"] == "en"
    wanted = language.accepted(spark.createDataFrame(rows, PAGES), host=None, address="url", wanted=["de"])
    assert wanted.where("doc_id < 100 or doc_id is null").count() == 0 and wanted.where("doc_id between 100 and 139").count() == 40


def test_addresses(spark):
    row = spark.range(1).select(
        language.host_of(language.F.lit("https://u@Www.Example.co.uk:80/a?b")).alias("h"), language.markup_language(language.F.lit("<!doctype html><HTML class=x lang='pt-BR'>")).alias("m")
    )
    assert tuple(row.first()) == ("www.example.co.uk", "pt")
    far = f"<html data-x='{'y' * 5000}' lang=sv><p>"
    declared = spark.createDataFrame([(far,), ("<html" * 3000,), ("<html><p lang=de>",), (None,)], "h string").select(language.markup_language(language.F.col("h")))
    assert [r[0] for r in declared.collect()] == ["sv", None, None, None]


def test_empty_and_unlabelled(spark):
    assert language.identify(spark.createDataFrame([], PAGES)).count() == 0
    out = language.identify(spark.createDataFrame([(1, "some text", None, None, None, None)], PAGES)).collect()
    assert out[0]["language"] is None and not out[0]["accepted"]


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_trigrams_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(language, "CHUNK", chunk)
    assert len(language.trigrams("one two three")) >= 13
    assert len(language.trigrams("12 34")) == 0


def test_any_number_of_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 40)
    words = {f"l{i:03d}": " ".join(chr(0x4E00 + 30 * i + j) * 3 for j in range(10)) for i in range(100)}
    rows = [(10 * i + j, text, [name, f" {name.upper()} "][j % 2], None, None, None) for i, (name, text) in enumerate(words.items()) for j in range(4)]
    out = language.identify(spark.createDataFrame(rows, PAGES), declared=None, host=None).collect()
    assert all(r["language"] == r["text_language"] == r["lang"].strip().lower() for r in out) and len(out) == 400


def test_rare_values_count(spark):
    text = {"en": "the house and the garden are here with them", "de": "das Haus und der Garten sind hier mit ihnen"}
    suffixes = [a + b for a in "abcdefghijklmnopqr" for b in "abcdefghijklmnopqr"]
    rows = [(i, text["en"], "en", None, None, f"http://h{i}.{s}/{j}") for i, s in enumerate(suffixes) for j in range(3)]
    rows += [(1000 + i, text["de"], "de", None, None, f"http://g{i}.zz/") for i in range(2)]
    rows += [(2000, "xy", None, None, None, "http://new.zz/")]
    out = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, PAGES), declared=None, host=None, address="url", strength=1e6).collect()}
    plain = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, PAGES), declared=None, host=None, strength=1e6).collect()}
    share = [(r[2000]["confidence"] if r[2000]["language"] == "de" else 1 - r[2000]["confidence"]) for r in (plain, out)]
    assert share[1] > 2 * share[0]


def test_sample_is_of_smallest_hashes_without_sorting_a_language(spark, tmp_path):
    spark.range(0, 20_000, 1, 4).selectExpr("if(id % 50 = 0, 'de', 'en') as lang", "concat('w', translate(cast(id as string), '0123456789', 'abcdefghij')) as text").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    model = language.fit(docs, "lang", 3_000)
    found = {r["label"]: r["n"] for r in model.counts.groupBy("label").agg(language.F.sum("n").alias("n")).collect()}
    rows = language.numbered(docs, language.Workspace(spark, "t")).withColumn("rank", language.F.xxhash64(language.ROW)).toPandas().sort_values("rank")
    for name in ("de", "en"):
        assert found[name] == sum(len(language.trigrams(t)) for t in rows[rows["lang"] == name]["text"][:3_000])
    assert model.ranked.count() <= 2 * 20_000 / 1_000


@pytest.mark.parametrize("copies", [40, 4_000])
def test_unlabelled_languages_stay(spark, tmp_path, copies):
    rows = [(i, "the house and the garden are here with them", "en", None, None, None) for i in range(copies)]
    rows += [(-1, "Широкая электрификация южных губерний даст мощный толчок", None, None, None, None), (-2, "12 345 --", None, None, None, None), (-3, "a house, a garden, the hare", None, None, None, None)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    out = {r["doc_id"]: r for r in language.identify(docs, declared=None, host=None, unknown="unknown").where("doc_id < 0").collect()}
    assert (out[-1]["language"], out[-1]["text_language"], out[-1]["confidence"]) == ("unknown", "unknown", None)
    assert out[-3]["language"] == "en" and [out[i]["accepted"] for i in (-1, -2, -3)] == [True, False, True]
    assert language.accepted(docs, host=None, unknown="unknown", wanted=["en"]).where("doc_id < 0").count() == 1
    none = docs.drop("lang").selectExpr("*", "cast(null as string) as lang").where("doc_id < 0")
    assert sorted(r["doc_id"] for r in language.accepted(none, unknown="unknown").collect()) == [-3, -1]


def test_query_uses_markup_and_address(spark, tmp_path):
    text = {"en": "the house and the garden are here with them", "de": "das Haus und der Garten sind hier mit ihnen"}
    docs = [(i, text[k], k, "src0") for i, k in enumerate(("en", "de") * 30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    page = '<html lang="{}"><body><nav>the menu and the rest</nav><article><p>{}</p></article></body></html>'
    pages = [(i, f"http://h{i}.{'co' if k == 'en' else 'de'}/", page.format(f"{k}-XX", text[k])) for i, k in enumerate(("en", "de") * 30)]
    pages += [(100, "http://new.site.xx/", page.format("de", "xy")), (101, "http://new.site.xx/", page.format("en", "xy"))]
    pages += [(102, "http://other.de/", page.format("", "gar")), (103, "http://other.co/", page.format("", "gar")), (104, "http://h1.de/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    out = op10_language(spark, str(tmp_path)).collect()
    of_pages = {r["page_id"]: r for r in out if r["doc_id"] is None}
    assert len(of_pages) == 65 and sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == list(range(60))
    assert [of_pages[i]["language"] for i in (0, 1, 102, 103)] == ["en", "de", "de", "en"]
    assert of_pages[102]["text_language"] == of_pages[103]["text_language"]
    assert not of_pages[104]["accepted"] and of_pages[1]["text_language"] == "de"
