"""WARC archives compressed with Zstandard, one frame a record, behind a dictionary.

An archive begins with a skippable frame that holds the dictionary, itself compressed or not. Every record
is a frame of its own, so a reader can start at any of them. Tasks write archives of bounded size under
names of their own and return what they wrote; only archives in that list, which Spark commits as a table,
count, so a task that is run again leaves nothing behind that would be read twice.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemill.llm.store import ROW, Workspace, numbered

FRAME = b"\x28\xb5\x2f\xfd"
SKIPPABLE = b"\x5d\x2a\x4d\x18"
DICTIONARY = b"\x37\xa4\x30\xec"
FIT_BYTES = 1 << 21  # of an archive's first payloads, what its dictionary is fitted on
DICTIONARY_BYTES = 1 << 16
ARCHIVE_BYTES = 1 << 28  # of records before compression; an archive ends with the record that reaches it
CHUNK = 1 << 20
LEVEL = 3
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"  # pages carry no time

MADE = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ = "archive string, at long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


class BadRecord(ValueError):
    """A record whose headers or lengths contradict the format."""


# -- records --------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    """A header value: control characters, which would end the line, are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record(number: int, page_id: int | None, url: str | None, payload: bytes, revisit: bool, first: int | None, first_page: int | None) -> bytes:
    """One record. A revisit has the response's head, with the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:row:{number}>"), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        headers.append(("Page-ID", page_id))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:row:{first}>")]
        if first_page is not None:
            headers.append(("Refers-To-Page-ID", first_page))
    headers += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "\r\n".join([VERSION, *(f"{k}: {v}" for k, v in headers)])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip() or name != name.strip():
            raise BadRecord(f"no header: {line[:40]!r}")
        key = name.decode("ascii", "replace").lower()
        if key in out and key in ("content-length", *NEEDED):
            raise BadRecord(f"repeated header {key}")
        try:
            out[key] = value.strip().decode()
        except UnicodeDecodeError as wrong:
            raise BadRecord(f"header {key} is not UTF-8") from wrong
    return out


def _number(fields: dict[str, str], name: str, signed: bool = False) -> int | None:
    value = fields.get(name)
    if value is None:
        return None
    if not (value.isascii() and value.removeprefix("-" if signed else "").isdigit()):
        raise BadRecord(f"{name} is no number")
    return int(value)


def _check(named: str | None, data: bytes, what: str) -> None:
    if named and named.startswith("sha1:") and named[5:] != digest(data):
        raise BadRecord(f"{what} digest differs")


def parse(data: bytes) -> dict:
    """Fields of a record, checked: version, needed headers, lengths of record and payload, digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        raise BadRecord("no version line")
    fields = _fields(lines)
    for name in NEEDED:
        if not fields.get(name):
            raise BadRecord(f"no {name}")
    length = _number(fields, "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise BadRecord(f"block of {len(rest) - 4} bytes, {length} announced")
    block, kind = rest[:length], fields["warc-type"]
    _check(fields.get("warc-block-digest"), block, "block")
    payload, size = block, length
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise BadRecord("no end of the HTTP head")
        announced = _number(_fields(http.split(b"\r\n")[1:]), "content-length")
        size = len(payload) if announced is None else announced
        if kind != "revisit" and size != len(payload):
            raise BadRecord(f"payload of {len(payload)} bytes, {size} announced")
    named = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        if not fields.get("warc-profile") or not named.startswith("sha1:"):
            raise BadRecord("revisit without profile or digest")
        if payload:
            raise BadRecord("revisit with a payload")
    else:
        _check(named, payload, "payload")
    return {
        "record_type": kind,
        "record_id": fields["warc-record-id"].strip("<>"),
        "target_uri": fields.get("warc-target-uri"),
        "page_id": _number(fields, "page-id", True),
        "refers_to": _number(fields, "refers-to-page-id", True),
        "payload_bytes": size,
        "payload_digest": named[5:] if kind == "revisit" else digest(payload),
        "payload": None if kind == "revisit" else payload,
    }


# -- archives -------------------------------------------------------------------------------------


def fitted(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for texts like these, or None where there is too little to fit one on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s], level=LEVEL)
    except (zstandard.ZstdError, ValueError):
        return None


def leading_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    data = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    return SKIPPABLE + struct.pack("<I", len(data)) + data


class _Bytes:
    """A stream with what has been read too far put back."""

    def __init__(self, stream):
        self.stream, self.held, self.at = stream, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            more = self.stream.read(max(CHUNK, n - len(self.held)))
            if not more:
                break
            self.held += more
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.held, self.at = data + self.held, self.at - len(data)


def records(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, record, error) of each frame; reading ends at a frame that cannot be decoded."""
    source = _Bytes(stream)
    dictionary, first = None, True
    while True:
        place = source.at
        magic = source.take(4)
        if not magic:
            return
        if len(magic) == 4 and magic[1:] == SKIPPABLE[1:3] + b"\x18" and 0x50 <= magic[0] <= 0x5F:
            size = source.take(4)
            data = source.take(struct.unpack("<I", size)[0]) if len(size) == 4 else b""
            if len(size) < 4 or len(data) < struct.unpack("<I", size)[0]:
                yield place, None, "skippable frame cut off"
                return
            if first and magic == SKIPPABLE:
                try:
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data) if data[:4] == FRAME else data
                    if raw[:4] != DICTIONARY:
                        raise zstandard.ZstdError("no dictionary")
                    dictionary = zstandard.ZstdCompressionDict(raw)
                except zstandard.ZstdError as wrong:
                    yield place, None, f"leading frame: {wrong}"
                    return
            first = False
            continue
        first = False
        if magic != FRAME:
            yield place, None, "no frame"
            return
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts, piece = [], magic
        try:
            while True:
                parts.append(decoder.decompress(piece))
                if decoder.eof:
                    break
                piece = source.take(CHUNK)
                if not piece:
                    raise zstandard.ZstdError("frame cut off")
        except zstandard.ZstdError as wrong:
            yield place, None, f"frame: {wrong}"
            return
        source.back(decoder.unused_data)
        yield place, b"".join(parts), None


def _opened(uri: str):
    where, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
    return where, path


def _writer(folder: str, archive_bytes: int, fit_bytes: int):
    def run(batches):
        where, path = _opened(folder)

        def made():
            held, size = [], 0  # the first records, on whose payloads the dictionary is fitted
            out = name = compressor = None
            written = 0
            count = 0

            def start():
                nonlocal out, name, compressor, held, written
                dictionary = fitted([payload for _, payload in held])
                compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = where.open_output_stream(f"{path}/{name}", compression=None)
                written = 0
                if dictionary:
                    written += out.write(leading_frame(dictionary)) or 0
                for data, _ in held:
                    out.write(compressor.compress(data))
                held = []

            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    for number, page, url, html, revisit, first, first_page in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                        payload = (html or "").encode()
                        data = record(number, page, url, payload, revisit, first, first_page)
                        size += len(data)
                        count += 1
                        if out is None:
                            held.append((data, payload[:CHUNK]))
                            if size >= fit_bytes:
                                start()
                        else:
                            out.write(compressor.compress(data))
                        if size >= archive_bytes:
                            if out is None:
                                start()
                            out.close()
                            yield f"{folder}/{name}", count, size
                            out, size, count = None, 0, 0
            if count:
                if out is None:
                    start()
                out.close()
                yield f"{folder}/{name}", count, size

        for row in made():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, MADE.types, strict=True)], schema=MADE)

    return run


def write(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE_BYTES, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns (archive, records, bytes).

    The payload is html in UTF-8; null counts as empty. Of records with equal payloads of ``least`` bytes or
    more, the one with the largest page_id is a response and the others are revisits of it; of several rows
    with that id, one. Null ids come last. Other records are responses. A null url or id has no header;
    control characters in a url are percent-encoded. Other columns are not looked at; an empty table gives
    no archive.

    Payloads are compared by SHA-1. They are not shuffled: what is grouped is digests, with partial sums,
    and only those that occur more than once are joined back, split where one of them is in many rows.
    A task holds the records its archive's dictionary is fitted on (``fit_bytes``) and one more.
    """
    work = Workspace(pages.sparkSession, "warc")
    rows = numbered(pages, work)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = rows.select(ROW, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    payload = F.col("html").cast("binary")
    own = own.withColumn("_op_sha", F.when(F.octet_length("html") >= least, F.sha1(payload)))
    best = F.max(F.struct("page_id", (-F.col(ROW)).alias("back")))  # nulls are the least
    again = own.where("_op_sha is not null").groupBy("_op_sha").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    again = work.write(again.select("_op_sha", "best.page_id", (-F.col("best.back")).alias("first")))
    joined = own.join(again.select("_op_sha", F.col("page_id").alias("first_page"), "first"), "_op_sha", "left")
    revisit = F.coalesce(F.col("first") != F.col(ROW), F.lit(False))
    put = joined.select(ROW, "page_id", "url", "html", revisit.alias("revisit"), "first", "first_page")
    folder = f"{work.home}/archives"
    work.folder(folder)
    return work.write(put.mapInArrow(_writer(folder, archive_bytes, fit_bytes), "archive string, records long, bytes long"))


def archives(spark: SparkSession, *paths: str) -> DataFrame:
    """(archive) of the archives under ``paths``; their content is not read here."""
    return spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("archive"))


def read(listed: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """The records of the archives in column ``archive``, in a stream, each checked.

    Payloads are null for revisits, and for all records with ``payloads`` False, when their length and digest are
    taken all the same. With ``strict`` a bad record is an error; else it is a row with ``error``, and reading
    goes on behind it, unless the frame itself cannot be decoded.
    """
    columns = [c.split() for c in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in columns])

    def run(batches):
        def found():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    where, path = _opened(uri)
                    with where.open_input_stream(path, compression=None) as stream:
                        for at, data, error in records(stream):
                            row = {"archive": uri, "at": at}
                            try:
                                row |= parse(data) if error is None else {"error": error}
                            except BadRecord as wrong:
                                row["error"] = str(wrong)
                            if strict and row.get("error"):
                                raise BadRecord(f"{uri} at {at}: {row['error']}")
                            yield row if payloads else row | {"payload": None}

        held, size = [], 0
        for row in found():
            held.append(row)
            size += len(row.get("payload") or b"")
            if len(held) >= 2_000 or size >= 1 << 23:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return listed.select("archive").repartition(listed.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, READ)
