import base64
import hashlib
import io
import struct

import pytest
import zstandard
from conftest import rows
from tablemill.llm import warc_archive as warc

SCHEMA = "page_id long, url string, html string, archive string, first long"


def pages():
    texts = [f"<html><body><p>Page {i} about {'water ' * (i % 7)}</p></body></html>" for i in range(60)]
    out = [(i, f"http://a.example/{i}", t, "x", 1) for i, t in enumerate(texts)]
    out += [(100 + i, "http://b.example/", texts[5], "x", 1) for i in range(40)]
    out += [(200, "u", "twice", "x", 1)] * 3 + [(None, "u", "lost", "x", 1)] * 2 + [(None, None, texts[6], None, None)]
    out += [(300, "http://c.example/\r\nWARC-Type: x", None, "x", 1), (301, "", "", "x", 1), (-5, "é", "naïve  ", "x", 1)]
    return out + [(400, "long", "ab" * 300_000, "x", 1)]


def by_hand(given, least):
    groups = {}
    for page, _, html, *_ in given:
        groups.setdefault(html or "", []).append(page)
    out = []
    for text, ids in groups.items():
        data = text.encode()
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        for place, page in enumerate(ids):
            again = place and len(data) >= least
            sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out.append((page, len(data), sha, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "archive_bytes", "fit_bytes"), [(0, 1 << 28, 1 << 21), (5, 4_000, 2_000)])
def test_round_trip(spark, least, archive_bytes, fit_bytes):
    given = pages()
    made = warc.write(spark.createDataFrame(given, SCHEMA).repartition(3), least, archive_bytes, fit_bytes)
    found = warc.read(made)
    assert rows(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == by_hand(given, least)
    texts = {(r["page_id"], bytes(r["payload"]).decode()) for r in found.where("record_type = 'response'").collect()}
    assert texts <= {(p, h or "") for p, _, h, *_ in given}
    assert made.agg({"records": "sum"}).first()[0] == len(given)
    if archive_bytes < 1 << 20:
        assert made.count() > 3
    urls = {r["target_uri"] for r in found.collect()}
    assert "http://c.example/%0D%0AWARC-Type: x" in urls and None in urls
    folder = made.first()["archive"].rsplit("/", 1)[0]
    assert warc.archives(spark, folder).count() == made.count()
    assert warc.read(warc.archives(spark, folder), payloads=False).count() == len(given)


def test_empty(spark):
    made = warc.write(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0 and warc.read(made).count() == 0


RECORD = warc.record(1, 7, "http://a.example", b"hello", False, None, None)


def archive(*records, dictionary=None, plain=False):
    out = b""
    if dictionary:
        out = warc.leading_frame(dictionary)
        if plain:
            out = warc.SKIPPABLE + struct.pack("<I", len(dictionary.as_bytes())) + dictionary.as_bytes()
    return out + b"".join(zstandard.ZstdCompressor(dict_data=dictionary).compress(r) for r in records)


def test_dictionary_frames():
    many = [warc.record(i, i, f"http://a.example/{i}", f"<p>{i * 977} some words of page {i}</p>".encode() * 9, False, None, None) for i in range(300)]
    dictionary = warc.fitted(many)
    assert dictionary
    for plain in (False, True):
        data = archive(*many, dictionary=dictionary, plain=plain)
        found = list(warc.records(io.BytesIO(data)))
        assert [r for _, r, _ in found] == many
        # a reader may start at any frame's place; without the dictionary nothing can be decoded
        assert next(warc.records(io.BytesIO(data[found[0][0] :])))[2]
    assert [r for _, r, _ in warc.records(io.BytesIO(archive(RECORD, RECORD)))] == [RECORD] * 2
    other = b"\x53\x2a\x4d\x18" + struct.pack("<I", 3) + b"abc"
    assert [r for _, r, _ in warc.records(io.BytesIO(archive(RECORD) + other + archive(RECORD)))] == [RECORD] * 2


@pytest.mark.parametrize(
    "data",
    [archive(RECORD)[:-3], b"abcdefgh", warc.SKIPPABLE + b"\x09\x00\x00\x00ab", warc.SKIPPABLE + b"\x02\x00\x00\x00abxxxx", b"\x28\xb5"],
)
def test_broken_archives(data):
    *_, (_, record, error) = warc.records(io.BytesIO(data))
    assert record is None and error


@pytest.mark.parametrize(
    ("old", "new"),
    [
        (b"WARC/1.1", b"HTTP/1.1"),
        (b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""),
        (b"hello", b"hell"),
        (b"hello", b"jello"),
        (b"hello\r\n\r\n", b"hello"),
        (b"Content-Length: 5", b"Content-Length: 6"),
        (b"Page-ID: 7", b"Page-ID 7"),
        (b"Page-ID: 7", b"Page-ID: x"),
        (b"WARC-Type: response", b"WARC-Type: revisit"),
        (b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
    ],
)
def test_broken_records(old, new):
    assert warc.parse(RECORD)["page_id"] == 7
    with pytest.raises(warc.BadRecord):
        warc.parse(RECORD.replace(old, new, 1))


def test_bad_record_is_a_row_or_an_error(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(archive(RECORD, RECORD.replace(b"hello", b"jello"), RECORD))
    listed = warc.archives(spark, str(tmp_path))
    found = warc.read(listed, strict=False).orderBy("at").collect()
    assert [bool(r["error"]) for r in found] == [False, True, False]
    with pytest.raises(Exception, match="digest differs"):
        warc.read(listed).collect()
