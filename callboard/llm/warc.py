"""WARC archives: records with revisits, an index of offsets, and coalesced range reads.

Writing. One aggregate finds, for every payload digest, the page that keeps the payload; all
other pages with this digest become revisit records that name it. Only digests and page ids
go through that aggregate; the pages then join its result by digest, a join whose hot
partitions AQE can split. Every task writes its records, each a gzip member of its own, into
archive files in the shared folder and returns one index row per record: file, offset,
length, URL and digest. The index is written as a table; a repeated task writes new files,
so only files that the index names count, whatever happened to lost executors.

Reading starts at the index. The wanted rows are sorted by file and offset; neighbouring
byte ranges are read as one where the gap between them is small, and the records are cut out
of it by their offsets.

Task code reaches files through ``pyarrow.fs`` by their full address, so the folder may be on
any file system known there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callboard.llm import workspace
from callboard.operators import joins

#: A task starts a new archive file beyond so many bytes.
FILE_BYTES = 1 << 30
#: Ranges in one file are read together if so few bytes lie between them ...
GAP_BYTES = 64 << 10
#: ... up to so many bytes in one read.
READ_BYTES = 8 << 20
_DATE = "2020-01-01T00:00:00Z"
_BREAK = b"\r\n\r\n"

_INDEX_DDL = (
    "page_id bigint, url string, file string, offset bigint, length bigint, payload_digest string, record_type string"
)
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORDS_DDL = (
    "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, hashed: str, first: int | None, revisit: bool) -> bytes:
    """One record: an HTTP response with its payload, or a revisit with the HTTP head alone.

    White space and other characters that a header can't hold are percent-encoded in the
    URL; a null URL gives no target header, a null page id an id of its own kind.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{hashed}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{first}>")
    return "\r\n".join(lines).encode() + _BREAK + block + _BREAK


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archive:
    """Archive files of one task in one folder; a new one whenever the last is full."""

    def __init__(self, folder: str):
        self.system, self.path = fs.FileSystem.from_uri(workspace.arrow_uri(folder))
        self.folder, self.out, self.at, self.name = folder, None, 0, ""

    def add(self, member: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.at = self.system.open_output_stream(f"{self.path}/{self.name}", compression=None), 0
        place = f"{self.folder}/{self.name}", self.at
        self.out.write(member)
        self.at += len(member)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = _Archive(folder)
        try:
            for batch in batches:
                rows: list[tuple] = []
                for page, url, html, first in zip(*(batch.column(k) for k in range(4))):
                    page, url, payload, first = page.as_py(), url.as_py(), (html.as_py() or "").encode(), first.as_py()
                    revisit = first is not None and page != first
                    hashed = digest(payload)
                    member = _member(record(page, url, payload, hashed, first, revisit))
                    file, at = archive.add(member)
                    rows.append((page, url, file, at, len(member), hashed, "revisit" if revisit else "response"))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)] if rows else [pa.array([], f.type) for f in _INDEX], schema=_INDEX)
        finally:
            archive.close()

    return run


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Write one record per row below ``folder`` and return the index, itself a table there.

    Among rows with equal payloads of at least ``least`` bytes, that with the largest key is
    the response and the others revisit it; smaller payloads are responses all. A null
    payload is empty. Rows that repeat the largest key are responses too; rows without a key
    revisit if any row of their payload has one. An empty table gives an empty index.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("hashed", F.unhex(F.sha1(F.col("html").cast("binary"))))
    shared = rows.where(F.octet_length("html") >= least).groupBy("hashed").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1").select("hashed", "first")
    named = joins.lookup(rows, shared, {"hashed": "hashed"}, ["first"], spread=True)
    files = workspace.made(spark, f"{folder}/files")
    index = named.select("page_id", "url", "html", "first").mapInArrow(_writer(files), _INDEX_DDL)
    return workspace.written(index, f"{folder}/index")


def _parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(_BREAK)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


_ID = re.compile(r"<urn:page:(-?\d+)>")


def _number(text: str | None) -> int | None:
    found = _ID.fullmatch(text or "")
    return int(found[1]) if found else None


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, start, stop and the records in it."""
    file, start, stop, cuts = "", 0, 0, []
    for name, at, size in rows:
        if cuts and (name != file or at - stop > GAP_BYTES or at + size - start > READ_BYTES):
            yield file, start, stop, cuts
            cuts = []
        if not cuts:
            file, start = name, at
        stop = max(stop, at + size) if cuts else at + size
        cuts.append((at, size))
    if cuts:
        yield file, start, stop, cuts


def _reader(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, handle = "", None
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for file, start, stop, cuts in _ranges(places):
                if file != open_name:
                    if handle is not None:
                        handle.close()
                    system, path = fs.FileSystem.from_uri(workspace.arrow_uri(file))
                    open_name, handle = file, system.open_input_file(path)
                data = handle.read_at(stop - start, start)
                rows = []
                for at, size in cuts:
                    fields, block = _parse(zlib.decompress(data[at - start : at - start + size], 31))
                    head, _, payload = block.partition(_BREAK)
                    revisit = fields["WARC-Type"] == "revisit"
                    hashed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size_ = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    if not revisit and (len(payload) != size_ or digest(payload) != hashed):
                        raise ValueError(f"damaged record in {file} at {at}")
                    rows.append((_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if payloads and not revisit else None, size_, hashed, fields["WARC-Type"], _number(fields.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORDS)], schema=_RECORDS)
        if handle is not None:
            handle.close()

    return run


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that index rows name, one row each; revisits have no payload of their own.

    Filter the index first, by URL, digest or type: bytes of other records are read only
    where they lie in a small gap. Every response's payload is checked against its digest.
    ``payloads=False`` reads and checks them but doesn't return them.
    """
    count = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = index.select("file", "offset", "length").repartitionByRange(count, "file", "offset").sortWithinPartitions("file", "offset")
    return sorted_.mapInArrow(_reader(payloads), _RECORDS_DDL)
