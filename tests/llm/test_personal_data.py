import re

import pytest
from tablemill.llm import personal_data

SCHEMA = "doc_id long, text string, spans string, kind string"
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    worth = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(w - 9 if w > 9 else w for w in worth) % 10 == 0


def by_hand(text):
    out = []
    for order, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, m.end(), kind))
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


TEXTS = [
    None, "", "plain words", "a@b.c", "x.y+z@mail.example.com. Next a@b.c.@d.e and a@b.c_x@d.e", "@a@b..c a@b a@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 999.1.2.3.4", "𝔘é 10.0.0.1 ü", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 5",
    "+1 (017) 555-7713 rest +49 30 123456 (0) +1+1+1 (555) 123-4567 +12345678901234567", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "a" * 50_000, "7" * 50_000, "1.1.1.1." * 800, "+1 " + "(" * 3000, "a@b" + ".c" * 9_000, "9 " * 9_000,
]


def test_base_as_by_hand(spark):
    rows = [(i, t, "a", "b") for i, t in enumerate(TEXTS)]
    found = {r["doc_id"]: r for r in personal_data.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, text in enumerate(TEXTS):
        wanted = by_hand(text)
        assert found[i]["base"] == ",".join(wanted), i
        assert found[i]["spans"] == found[i]["base"]
        for kind in FORMS:
            assert found[i][f"n_{kind}"] == sum(w.startswith(kind) for w in wanted)


def test_long_words_are_context_too(spark):
    words = "c" * 70 + " " + "d" * 90
    texts = [f"well then {words} +1 (017) 555-77{i:02d} it" for i in range(12)] + [f"now {words} 555-0199-882 it", f"now e{words} 555-0199-883 it"]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    start = len(f"now {words} ")
    assert found[12] == f"phone:{start}:{start + 12}" and found[13] == ""


@pytest.mark.parametrize("extra", ["555-0199-882", "(5550199882)"])
def test_context_gives_away(spark, extra):
    said = [f"well then, call me on +1 (017) 555-77{i:02d} or leave it" for i in range(12)]
    texts = [*said, f"you may call me on {extra}, they said", "we saw number 123456789 on it", "call me on time"]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["spans"] for r in personal_data.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    start = texts[12].index(extra.strip("()"))
    assert found[12] == f"phone:{start}:{start + len(extra.strip('()'))}"
    assert found[13] == found[14] == ""
    clean = {r["doc_id"]: r["text"] for r in personal_data.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean[12] == texts[12].replace(extra.strip("()"), "[phone]")
    assert clean[0] == "well then, call me on [phone] or leave it"
    assert clean[14] == texts[14]


def test_redacts_overlaps(spark):
    text = "x 10.0.0.1@b.c y 4111111111111111"
    out = personal_data.redact(spark.createDataFrame([(1, text, None, None), (2, None, None, None)], SCHEMA)).collect()
    assert out[0]["text"] == "x [ip] y [card]"
    assert out[1]["text"] is None


def test_empty(spark):
    assert personal_data.find(spark.createDataFrame([], SCHEMA)).count() == 0
    assert personal_data.redact(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_decide(spark):
    texts = [f"well then, call me on +1 (017) 555-77{i:02d} or leave it" for i in range(60)]
    texts += [f"well then, call me on 0175-55{i:03d} or leave it" for i in range(40)]  # 60 % of the pattern's instances
    texts += [f"you can dial home 0175-55{i:03d} at night" for i in range(8)]  # known by the pattern before alone
    texts += ["you can dial home 0999-12345 at night", "we saw number 123456789 on it"]
    texts += [f"the bill number +1 (018) 555-77{i:02d} is" for i in range(4)] + [f"the bill number 20240{i:04d} is" for i in range(40)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], SCHEMA)
    once, often = ({r["doc_id"] for r in personal_data.find(docs, rounds=n).where("spans <> ''").collect()} for n in (1, 3))
    told = {*range(60), *range(110, 114)}
    assert once == told
    assert often == told | set(range(60, 109))
