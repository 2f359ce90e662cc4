"""WARC archives in Zstandard: a dictionary in a leading skippable frame, a frame per record.

Written by tasks into a shared folder, and read back frame by frame with every length
and digest checked. Equal payloads are stored once; the other records revisit that one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.session import materialise, work_folder

# Fixed values of the formats.
VERSIONS = b"WARC/1.1", b"WARC/1.0"  # written; read as well
SKIPPABLE = 0x184D2A5D  # magic of the skippable frame that holds an archive's dictionary
ZSTD_FRAME = 0xFD2FB528  # the dictionary may itself be a compressed frame
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

ESCAPED = "X-Target-URI-Escaped"
SCHEME = "urn:headwater:page:"  # of record ids: a page's id, percent-encoded; none for a page without
LEVEL = 3
DICTIONARY = 1 << 16  # bytes of a file's dictionary
ROWS = 512  # pages that a task holds as Python values at once
TRAINING_PAGES = 256  # of a file's first ROWS, chosen by hash, that its dictionary learns from
TRAINING_BYTES = 1 << 22
FILE_BYTES = 1 << 26  # compressed, of a file at least, before the next begins
CHUNK = 1 << 14  # bytes read at a time
SALTS = 32  # places that copies of one payload are dealt out to
DATE = "1970-01-01T00:00:00Z"  # pages have no capture time


class BadArchive(ValueError):
    """A frame, header, length or digest that is not as it must be."""


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without the label."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id) -> str:
    return f"<{SCHEME}{'' if page_id is None else '=' + urllib.parse.quote(str(page_id), safe='')}>"


def page_of(uri: str) -> str | None:
    """The page id, as text, that a record id stands for."""
    if not (uri.startswith(f"<{SCHEME}") and uri.endswith(">")):
        raise BadArchive(f"not a record id of a page: {uri[:80]}")
    name = uri[len(SCHEME) + 1 : -1]
    return urllib.parse.unquote(name[1:]) if name else None


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record: its headers and block. A revisit keeps the HTTP headers and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_uri(page_id)), ("WARC-Date", DATE),
             ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
             ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        # A header holds no control characters or outer spaces: such addresses are escaped, and marked so.
        fits = url.isprintable() and url == url.strip()
        named.append(("WARC-Target-URI", url if fits else urllib.parse.quote(url, safe="")))
        if not fits:
            named.append((ESCAPED, "percent"))
    if revisit:
        named += [("WARC-Refers-To", record_uri(refers_to)), ("WARC-Profile", REVISIT)]
    named.append(("Content-Length", str(len(block))))
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in named)
    return b"%s\r\n%s\r\n%s\r\n\r\n" % (VERSIONS[0], head, block)


def _headers(lines: bytes, once: bool = True) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadArchive(f"not a header: {line[:80]!r}")
        if once and name.lower() != b"warc-concurrent-to" and name.decode().lower() in found:
            raise BadArchive(f"a header twice: {name.decode()}")
        found[name.decode().lower()] = value.strip().decode()
    return found


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise BadArchive(f"no length: {value[:40]!r}")
    return int(value)


def parse(data: bytes) -> dict:
    """One decoded frame as a record, or BadArchive where it is not exactly one whole record."""
    first, _, rest = data.partition(b"\r\n")
    if first not in VERSIONS:
        raise BadArchive(f"not a record: {first[:40]!r}")
    head, gap, rest = rest.partition(b"\r\n\r\n")
    if not gap:
        raise BadArchive("headers without an end")
    headers = _headers(head)
    for name in REQUIRED:
        if name not in headers:
            raise BadArchive(f"no {name}")
    length = _length(headers)
    if rest[length:] != b"\r\n\r\n":
        raise BadArchive(f"a block of {length} bytes does not end where its record does")
    block, kind = rest[:length], headers["warc-type"]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{digest(block)}":
        raise BadArchive("a block differs from its digest")
    url = headers.get("warc-target-uri")
    url = urllib.parse.unquote(url) if url and headers.get(ESCAPED.lower()) == "percent" else url
    found = {"record_type": kind, "headers": headers, "url": url, "page": None, "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind not in ("response", "revisit"):
        return found | {"payload": block, "payload_bytes": length}
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadArchive("a response without HTTP headers")
    web = _headers(http.partition(b"\r\n")[2], once=False)
    size = _length(web) if "content-length" in web or kind == "revisit" else len(payload)
    label, _, wanted = headers.get("warc-payload-digest", "").partition(":")
    if label != "sha1" or not wanted:
        raise BadArchive("no payload digest")
    found |= {"page": page_of(headers["warc-record-id"]), "payload_bytes": size, "payload_digest": wanted}
    if kind == "revisit":
        if payload or "warc-refers-to" not in headers or headers.get("warc-profile") != REVISIT:
            raise BadArchive("a revisit with a payload, or of nothing")
        return found | {"refers_to": page_of(headers["warc-refers-to"])}
    if size != len(payload) or wanted != digest(payload):
        raise BadArchive("a payload differs from its length or digest")
    return found | {"payload": payload}


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """The skippable frame of a dictionary learned from `samples`, and the dictionary; nothing if they are too few."""
    if len(samples) < 8:
        return b"", None
    try:
        learned = zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL)
    except zstandard.ZstdError:  # samples that are too short or too alike to learn from
        return b"", None
    content = zstandard.ZstdCompressor(level=LEVEL).compress(learned.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(content)) + content, learned


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive. The dictionary comes from its leading skippable
    frame, plain or compressed; only a part of the file and one record are held."""
    head = stream.read(8)
    learned, rest = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", head[4:])[0]
        content = stream.read(size)
        if len(content) != size:
            raise BadArchive("the dictionary is cut off")
        if content[:4] == struct.pack("<I", ZSTD_FRAME):
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        learned, rest = zstandard.ZstdCompressionDict(content), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        frame, parts = unpacker.decompressobj(), []
        try:
            while not frame.eof:
                if not rest:
                    rest = stream.read(CHUNK)
                    if not rest:
                        raise BadArchive("the last frame is cut off")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as error:
            raise BadArchive(f"not a frame: {error}") from error
        yield b"".join(parts)


def store_of(folder: str):
    from pyarrow import fs

    if ":" not in folder.split("/")[0]:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """`pages` (page_id, url, html) with _refers, whether another page's record holds the payload, and _response, its page_id.

    Of equal payloads of `least` bytes or more the page of the largest page_id has it;
    rows that share this id all do. Payloads are compared by their SHA-256. Only payloads
    that occur more than once are joined back, each at SALTS places, so copies of one
    page spread over that many tasks and more.
    """
    keyed = pages.select("page_id", "url", "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("_payload"))
    groups = keyed.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least).groupBy("_payload").agg(
        F.count("*").alias("_n"), F.max("page_id").alias("_response"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    groups = groups.filter("_n > 1").select("_payload", "_response", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias("_salt"))
    joined = keyed.withColumn("_salt", salt).join(groups, ["_payload", "_salt"], "left")
    # A page without an id is never the larger one; where all lack ids, all have the payload.
    other = F.col("_response").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("_response"), F.lit(False))
    return joined.select("page_id", "url", "html", other.alias("_refers"), F.when(other, F.col("_response")).alias("_response"))


def write(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of `pages` below `folder`; returns the list (part, number, file, records, bytes).

    A file gets its name once it is whole, and only listed files count, so repeated or
    lost tasks leave no half of anything. `folder` must be shared by all executors.
    """
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        part, number, out, packer = TaskContext.get().partitionId(), 0, None, None
        name, records, size = "", 0, 0

        def close():
            out.close()
            store.move(f"{root}/_{name}", f"{root}/{name}")
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, number, name, records, size), kinds)],
                                              ["part", "number", "file", "records", "bytes"])

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            if out is None:
                name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.warc.zst"
                out, records, size = store.open_output_stream(f"{root}/_{name}", compression=None), 0, 0
                some = sorted({r[2].encode() for r in rows if r[2]}, key=lambda p: (zlib.crc32(p), p))[:TRAINING_PAGES]
                total = [0]
                some = [p for p in some if total.append(total[-1] + len(p)) or total[-1] <= TRAINING_BYTES]
                frame, learned = dictionary_frame(some)
                out.write(frame)
                size = len(frame)
                packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned) if learned else zstandard.ZstdCompressor(level=LEVEL)
            for page_id, url, page, refers, response in rows:
                frame = packer.compress(record(page_id, url, (page or "").encode(), response, refers))
                out.write(frame)
                records, size = records + 1, size + len(frame)
            if size >= file_bytes:
                yield close()
                number, out = number + 1, None
        if out is not None:
            yield close()

    schema = "part long, number long, file string, records long, bytes long"
    return materialise(revisits(pages, least).mapInArrow(put, schema), "archives")


def read(files: DataFrame, folder: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record of the listed files.

    Each frame must be one whole record; headers, lengths and digests are checked, and
    a file must hold as many records as its list says. payload is NULL for revisits.
    """
    kinds = [pa.string()] * 3 + [pa.int64(), pa.string(), pa.string(), pa.binary()][: 4 if payloads else 3]
    names = ["page", "url", "record_type", "payload_bytes", "payload_digest", "refers", "payload"][: len(kinds)]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held, seen = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in frames(stream):
                        r = parse(data)
                        rows.append(tuple(r[k] for k in ("page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"))[: len(kinds)])
                        held, seen = held + len(data), seen + 1
                        if len(rows) >= 10_000 or held >= 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                if seen != records:
                    raise BadArchive(f"{name}: {seen} records, {records} listed")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    # A file a task: files are dealt out by their place in the list, not by a hash that may meet.
    tasks = max(1, min(10_000, files.count()))
    at = F.row_number().over(Window.orderBy("part", "number")) - 1
    spread = files.withColumn("at", at).repartitionByRange(tasks, "at").select("file", "records")
    schema = "page string, url string, record_type string, payload_bytes long, payload_digest string, refers string" + ", payload binary" * payloads
    found = spread.mapInArrow(take, schema)
    return found.select(F.col("page").cast(id_type).alias("page_id"), "url", "record_type", "payload_bytes", "payload_digest",
                        F.col("refers").cast(id_type).alias("refers_to"), *["payload"] * payloads)


def round_trip(pages: DataFrame, least: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `pages` to new archives in the shared folder and return what `read` finds there.

    NULL html is an empty payload; rows that share the largest page_id of a payload are
    all responses; a NULL url has no target; other columns are ignored; an empty table
    writes no file and gives no row.
    """
    folder = work_folder(pages.sparkSession, "warc")
    id_type = pages.schema["page_id"].dataType.simpleString()
    found = read(write(pages, folder, least, file_bytes), folder, id_type, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
