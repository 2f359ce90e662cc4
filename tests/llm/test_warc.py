"""Archives: round trip, the dictionary frame, and what a reader must refuse."""

import base64
import hashlib
import io
import struct
import uuid

import pytest
import zstandard

from headwater.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a.example/x?y=%20&z=é", "<p>one</p>"), (2, None, "<p>one</p>"), (9, "", "<p>one</p>"), (3, " http://b.example/\r\nX: y", None),
    (4, "u", ""), (5, "u", "é\r\n\r\nHTTP/1.1 200 OK\r\n"), (None, "v", "<p>one</p>"), (None, "v", "alone"), (None, "w", "alone"), (7, "t", "tie"), (7, "t", "tie"), (6, "t", "tie"),
    (8, "long", "0123456789é" * 300_000),
]


def wanted(rows, least=0):
    held = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            held[html or ""] = max(held.get(html or "", page), page)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        response = held.get(html or "")
        revisit = response is not None and page != response
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", response if revisit else None, url))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
@pytest.mark.parametrize("file_bytes", [1, warc.FILE_BYTES])
def test_round_trip(spark, least, file_bytes):
    pages = spark.createDataFrame([(*p, 1, 2) for p in PAGES], SCHEMA + ", _payload long, record_type long").repartition(3)
    assert sorted((tuple(r) for r in warc.round_trip(pages, least, file_bytes).collect()), key=str) == wanted(PAGES, least)


def test_given_pages_come_back_whole(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    files = warc.write(pages, folder)
    found = warc.read(files, folder).select("page_id", "url", "payload", "record_type").collect()
    rows = {r["page_id"]: r for r in pages.collect()}
    assert len(found) == len(rows)
    for r in found:
        assert r["url"] == rows[r["page_id"]]["url"]
        assert r["record_type"] == "revisit" or r["payload"].decode() == rows[r["page_id"]]["html"]
    with open(f"{folder}/{files.first()['file']}", "rb") as file:
        head = file.read(8)
        size = struct.unpack("<I", head[4:])[0]
        learned = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(file.read(size), max_output_size=1 << 20))
        one = zstandard.ZstdDecompressor(dict_data=learned).decompressobj().decompress(file.read())
    assert struct.unpack("<I", head[:4])[0] == 0x184D2A5D and one.startswith(b"WARC/1.1\r\n")


def test_hot_payload_spreads(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else f"page {i}") for i in range(3000)]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted((tuple(r) for r in found.collect()), key=str) == wanted(rows)


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_plain_dictionary_and_other_records_are_read():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    learned = zstandard.ZstdCompressionDict(b"<html><body>some raw content</body></html>" * 9)
    packer = zstandard.ZstdCompressor(dict_data=learned)
    whole = warc.record(3, "u", b"<html><body>some raw content</body></html>")
    data = struct.pack("<II", 0x184D2A5D, len(learned.as_bytes())) + learned.as_bytes() + packer.compress(info) + packer.compress(whole)
    records = [warc.parse(f) for f in warc.frames(io.BytesIO(data))]
    assert [r["record_type"] for r in records] == ["warcinfo", "response"] and records[0]["payload"] == b"abc" and records[1]["page"] == "3"


GOOD = warc.record(1, "u", b"payload")


@pytest.mark.parametrize("bad", [
    GOOD[:-1], GOOD + b"x", GOOD.replace(b"payload\r\n", b"paylord\r\n"), GOOD.replace(b"WARC/1.1", b"WARC/2.0"), GOOD.replace(b"WARC-Date", b"X-Date"),
    GOOD.replace(b"Content-Length: 7", b"Content-Length: 8"), GOOD.replace(b"WARC-Type: response", b"WARC-Type: revisit"), GOOD + GOOD,
    GOOD.replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"), GOOD.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"),
    GOOD.replace(b"\r\nWARC-Date", b"\r\nno colon\r\nWARC-Date"), b"",
])
def test_bad_records_are_refused(bad):
    assert warc.parse(GOOD)["payload"] == b"payload"
    with pytest.raises(warc.BadArchive):
        warc.parse(bad)


def test_bad_frames_are_refused():
    frame = zstandard.ZstdCompressor().compress(GOOD)
    assert len(list(warc.frames(io.BytesIO(frame + frame)))) == 2
    for data in (frame[:-3], frame + b"junk", struct.pack("<II", 0x184D2A5D, 99) + b"short", b"no frame at all"):
        with pytest.raises(warc.BadArchive):
            list(warc.frames(io.BytesIO(data)))


def test_a_lost_record_is_noticed(spark, tmp_path):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    files = warc.write(spark.createDataFrame(PAGES[:3], SCHEMA).coalesce(1), folder)
    more = files.withColumn("records", files["records"] + 1)
    with pytest.raises(Exception, match="listed"):
        warc.read(more, folder).collect()
