"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle ends with the seek table of the seekable format (a
skippable frame with the compressed and plain size of every frame), and an index maps record ids to
a frame and the offset in it, so one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch
from ._files import AtomicFile, locate

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FRAME_BYTES = 1 << 20
INDEX = "part long, uri string, record_id string, frame int, at long, size long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has the head of the response, whose length is the payload's, and no payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block, and where the next record begins."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    return fields, block, end + 4 + len(block) + 4


def http_response(block: bytes) -> tuple[int, bytes]:
    """Length of the payload as the head gives it, and the payload there is."""
    head, _, payload = block.partition(b"\r\n\r\n")
    _, *lines = head.decode().split("\r\n")
    return int(dict(x.split(": ", 1) for x in lines)["Content-Length"]), payload


class Bundle:
    """Writes frames of about ``FRAME_BYTES`` plain bytes and the seek table."""

    def __init__(self, file: AtomicFile, level: int):
        self.file, self.coder = file, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held, self.size, self.frames = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """The record's frame and offset in it."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self._flush()
        place = len(self.frames), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def _flush(self) -> None:
        packed = self.coder.compress(b"".join(self.held))
        self.file.write(packed)
        self.frames.append((len(packed), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Seekable:
    """Reads frames of a bundle by number."""

    def __init__(self, uri: str):
        system, path = locate(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        self.sizes = np.frombuffer(self.file.read_at(8 * count, size - 9 - 8 * count), "<u4").reshape(-1, 2).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes[:, 0])])
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        return self.coder.decompress(self.file.read_at(int(self.sizes[k, 0]), int(self.at[k])), max_output_size=int(self.sizes[k, 1]))

    def record(self, frame: int, at: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), at)[:2]


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with what their payload is known by."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"), F.octet_length(payload).alias("bytes"))


def references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, digest, bytes, refers_to`` of the payloads of pages that an earlier page (a smaller id) has; copies never meet in a group."""
    keyed = _keyed(pages).where("page_id is not null").where(F.col("bytes") >= least_bytes).select("page_id", "digest", "bytes")
    first = keyed.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    return keyed.join(first, ["digest", "bytes"]).where("page_id <> refers_to").select("page_id", "digest", "bytes", "refers_to").distinct()


def write_warc(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes bundles and returns the index (``part, uri, record_id, frame, at, size``); the call is lazy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        uri, rows = f"{folder}/part-{part:06d}.warc.zst", []

        def index() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("uri", pa.string()), ("record_id", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("size", pa.int64())]))
            rows.clear()
            return out

        with AtomicFile(uri) as file:
            bundle = Bundle(file, level)
            for batch in batches:
                for r in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    page, url, html, refers = (x.as_py() for x in r)
                    data = record(page, url, html.encode(), refers, date)
                    frame, at = bundle.add(data)
                    rows.append({"part": part, "uri": uri, "record_id": record_id(page), "frame": frame, "at": at, "size": len(data)})
                if rows:
                    yield index()
            bundle.close()

    source = _keyed(pages).join(references(pages, least_bytes), ["page_id", "digest", "bytes"], "left")
    return source.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX)


def read_warc(files: DataFrame) -> DataFrame:
    """Every record of the bundles in column ``uri``: ids, type, digest, payload length and payload (empty for a revisit)."""

    def number(x: str | None) -> int | None:
        tail = (x or "<>")[1:-1].rpartition(":")[2]
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                bundle = Seekable(uri)
                for k in range(len(bundle.sizes)):
                    data, at, rows = bundle.frame(k), 0, []
                    while at < len(data):
                        fields, block, at = parse(data, at)
                        size, payload = http_response(block)
                        rows.append({
                            "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
                            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload,
                        })
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    return files.select("uri").distinct().repartition("uri").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, least_bytes: int = 0, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes ``pages`` (``page_id, url, html``) and reads them back: records, and the index.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least ``least_bytes`` bytes the
    page with the smallest id is a response and the others revisit it; smaller ones and pages with a
    null id are responses. A null url has no target header. Rows that repeat a page id give a record
    each: with a payload of its own each is a response, with equal ones all are what the page is. Further columns are ignored; an empty table gives none.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    index = scratch.save(write_warc(pages, scratch.path("warc"), least_bytes=least_bytes), "index")
    return read_warc(index), index
