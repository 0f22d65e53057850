"""WARC archives: a writer and a sequential reader.

Every record is a gzip member of its own.  The reader feeds a file to an
incremental zlib decompressor in small pieces, finds the end of each member,
frames the record by its Content-Length and verifies the digests of block and
payload.  Memory is one record, whatever the size of the archive.

Payloads that are equal (SHA-1) are stored once: the smallest page_id is the
response and the others are revisit records (identical payload digest) which
carry the HTTP header, so the full payload's length and digest can be read from
them alone.

Archives are rows of a table in the shared folder (archive, data), so writer
and reader need nothing but Spark's own storage and survive lost executors.

Defined cases: null html is the empty payload; control characters, blanks and
bytes outside ASCII in a url are percent-encoded in the header and decoded when
read; a null url reads back as null; a null page_id counts as larger than all;
rows repeating a page_id with equal payload are written each, with the same
type; an empty table gives no rows.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsort.llm.common import join_hot, materialise, store

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 4 << 20
NO_ID = (1 << 63) - 1


class WarcError(ValueError):
    """A record that is damaged or framed wrongly."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_header(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    n = urn.rpartition(":")[2].rstrip(">")
    return None if n == "null" else int(n)


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False,
           date: str = "1970-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One record as one gzip member."""
    block = http_header(len(payload)) + (b"" if revisit else payload)
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=";/?:@&=+$,-_.!~*'()#[]|")
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to)}
    head |= {"WARC-Payload-Digest": "sha1:" + sha1_base32(payload), "WARC-Block-Digest": "sha1:" + sha1_base32(block),
             "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in head.items()]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream given in pieces."""
    z, got, rest = None, bytearray(), b""
    for piece in pieces:
        rest = piece
        while rest:
            if z is None:
                z, got = zlib.decompressobj(31), bytearray()
            try:
                got += z.decompress(rest)
            except zlib.error as e:
                raise WarcError(f"damaged gzip member: {e}") from e
            rest = z.unused_data
            if z.eof:
                yield bytes(got)
                z = None
    if z is not None:
        raise WarcError("the archive ends inside a gzip member")


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}


def read_record(raw: bytes) -> dict:
    """One record, framed by Content-Length and verified."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise WarcError("no WARC header")
    h = fields(head)
    n = int(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"{h.get('warc-record-id')}: Content-Length {n} does not frame the record")
    if h["warc-block-digest"] != "sha1:" + sha1_base32(block):
        raise WarcError(f"{h.get('warc-record-id')}: block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = h["warc-type"]
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest != sha1_base32(payload):
        raise WarcError(f"{h.get('warc-record-id')}: payload digest differs")
    url = h.get("warc-target-uri")
    return {"page_id": page_of(h["warc-record-id"]), "url": None if url is None else unquote(url), "record_type": kind,
            "payload": payload if kind == "response" else None, "payload_bytes": int(fields(http)["content-length"]),
            "payload_digest": digest, "refers_to": page_of(h["warc-refers-to"]) if kind == "revisit" else None}


def read_archive(data, piece: int = 1 << 16) -> Iterator[dict]:
    """The records of an archive, in order."""
    view = memoryview(data)
    for raw in members(bytes(view[i:i + piece]) for i in range(0, len(view), piece)):
        yield read_record(raw)


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, data: the pages as archives, stored in the shared folder."""
    src = pages.select(F.coalesce(F.col(page_id).cast("bigint"), F.lit(NO_ID)).alias("page"), F.col(url).cast("string").alias("url"),
                       F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    ids = materialise(src.select("page", "digest"))
    firsts = ids.groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = (join_hot(ids, firsts, "digest", "n", ids.count(), F.col("page"))
                .where("first <> page").select("page", "digest", "first").distinct())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array([bytes(data)], pa.binary())], names=["data"])
        data = bytearray()
        for b in batches:
            for page, u, h, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                data += member(None if page == NO_ID else page, u, h.encode(), first, first is not None)
                if len(data) >= archive_bytes:
                    yield out()
                    data = bytearray()
        if data:
            yield out()

    rows = src.join(revisits, ["page", "digest"], "left").select("page", "url", "html", "first")
    return store(rows.mapInArrow(write, "data binary").withColumn("archive", F.monotonically_increasing_id()), "warc")


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives (column ``data``), verified."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string() if " string" in c else pa.int64() for c in RECORD.split(", ")]
    if with_payload:
        names, types = [*names, "payload"], [*types, pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
        for b in batches:
            for cell in b.column(0):
                rows, size = [], 0
                for r in read_archive(cell.as_buffer()):
                    rows.append(r)
                    size += 200 + (r["payload_bytes"] if with_payload else 0)
                    if size > 1 << 22:
                        yield out()
                        rows, size = [], 0
                if rows:
                    yield out()

    return archives.select("data").mapInArrow(read, RECORD + (", payload binary" if with_payload else ""))
