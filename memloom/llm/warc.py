"""WARC archives with individually compressed records and an embedded Zstandard dictionary.

Each archive is self-contained: a leading skippable frame holds a dictionary built from a bounded sample of the
archive's own records, then every record is a frame of its own. Of records with equal payloads the one with the
largest page_id is a response; the others are revisits of it and carry no payload.

Archives are rows (archive, data) of a table in shared storage, of about ARCHIVE_BYTES of records each, so
writing and reading scale with tasks and a lost executor's archives are written again, equal to the byte.

Edge cases: null html is the empty payload; null urls get no target header; rows that repeat the largest page_id
of a payload are all responses; a null page_id counts as the smallest, and if a payload has only null ids its rows
are all responses; payloads smaller than ``least`` bytes are all responses; empty tables give no archives; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:memloom:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary_of(sample: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or the sample's last bytes as they are where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, top: int | None, date: str) -> bytes:
    """One WARC record; payload None: a revisit of page top."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{top}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    sample, total = [], 0
    for r in records:
        if total >= SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES])
        total += len(sample[-1])
    words = dictionary_of(sample)
    raw = words.as_bytes()
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(pack.compress, records)])


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    words = zstandard.ZstdCompressionDict(data[8 : 8 + n])
    with zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(memoryview(data)[8 + n :]), read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 16)
        while version := stream.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"not a record: {version[:40]!r}")
            head: dict[str, str] = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            block = stream.read(int(head["content-length"]))
            if len(block) != int(head["content-length"]) or stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut short")
            yield head, block


def _roles(pages: DataFrame, least: int) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", html.alias("html"), F.unhex(F.sha2(html, 256)).alias("same"))
    tops = pages.select("page_id", F.unhex(F.sha2(html, 256)).alias("same2")).groupBy("same2").agg(F.max("page_id").alias("top"))
    j = p.join(tops.hint("shuffle_hash"), F.col("same") == F.col("same2"))
    size = F.octet_length("html")
    alone = (size < least) | F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    return j.select("page_id", "url", "html", alone.alias("alone"), "top")


def write_archives(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archive pages(page_id, url, html); the stored table archive, data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        total = 0

        def flush() -> pa.RecordBatch:
            data = archive(held)
            name = uuid.UUID(bytes=hashlib.md5(data).digest()).hex + ".warc.zst"
            return pa.RecordBatch.from_pydict({"archive": [name], "data": pa.array([data], pa.binary())})

        for b in batches:
            for page_id, url, html, alone, top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = html.encode()
                r = record(page_id, url, payload if alone else None, len(payload), sha1_base32(payload), top, date)
                held.append(r)
                total += len(r)
                if total >= ARCHIVE_BYTES:
                    yield flush()
                    held.clear()
                    total = 0
        if held:
            yield flush()

    packed = _roles(pages, least).mapInArrow(pack, "archive string, data binary")
    return materialize(packed, "archives", "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A response whose payload does not have the digest of its header is an error.
    """
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def page(value: str | None) -> int | None:
        digits = (value or "").strip("<>").removeprefix(_ID)
        return int(digits) if digits else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                rows, held = [], 0
                for head, block in read_archive(data.as_py()):
                    digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                    payload = None
                    if head["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != n or sha1_base32(payload) != digest:
                            raise ValueError("a payload does not have its digest")
                    rows.append((page(head["warc-record-id"]), head.get("warc-target-uri"), payload, n, digest, head["warc-type"], page(head.get("warc-refers-to"))))
                    held += len(block)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kinds)], schema=kinds)

    return archives.select("data").mapInArrow(unpack, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
