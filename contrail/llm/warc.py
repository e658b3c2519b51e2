"""WARC archives: written by tasks into the shared folder, read back one gzip member at a time.

Writing: each task writes its rows to archives of its own, rolled at a size, under names no other attempt uses. The manifest
that the write returns lists the archives of successful attempts only, so what a lost executor left behind is never read.
Equal payloads are found by grouping on their digest; only digests that occur more than once are joined back, so pages are
not shuffled.

Reading: one record per gzip member. Bytes are decompressed piece by piece with a bounded output, the record header is read
up to its empty line, the block is exactly Content-Length bytes, and block and payload digests are recomputed on the way.
A record that breaks the framing or a digest stops the read with its archive and offset.

Defined cases: null html is an empty payload; a null url is written as an empty one; rows that repeat the smallest id of
their payload are responses too; a row without id revisits the smallest id there is, or is a response if there is none;
other columns are ignored; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.shared import TEXT_ROWS, arrow_rows, broadcast_if_small, work_path, written

PIECE = 1 << 16
ARCHIVE_BYTES = 256 << 20
BROADCAST_ROWS = 500_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records long, bytes long"
RECORDS = (
    "archive string, offset long, record_id string, record_type string, target_uri string, refers_to_id string,"
    " payload_digest string, payload_bytes long, payload binary"
)


class BrokenRecord(ValueError):
    """An archive that does not hold what its headers say."""


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _plain(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_bytes(record_id: str, uri: str, payload: bytes, refers_to: str | None, level: int) -> bytes:
    """One compressed record: a response with its payload, or a revisit with the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_plain(uri)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[4:4] = [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class MemberStream:
    """Decompressed pieces of one gzip member after another, none longer than a fixed size."""

    def __init__(self, source: BinaryIO, piece: int = PIECE) -> None:
        self.source, self.piece = source, piece
        self.waiting, self.taken, self.offset = b"", 0, 0
        self.inflate: zlib._Decompress | None = None

    def _more(self) -> bool:
        if not self.waiting:
            self.waiting = self.source.read(self.piece)
            self.taken += len(self.waiting)
        return bool(self.waiting)

    def next_member(self) -> bool:
        if not self._more():
            return False
        self.offset = self.taken - len(self.waiting)
        self.inflate = zlib.decompressobj(31)
        return True

    def read(self) -> bytes:
        """The next piece; empty at the member's end."""
        assert self.inflate is not None
        while not self.inflate.eof:
            if not self._more():
                raise BrokenRecord("the archive ends within a member")
            out = self.inflate.decompress(self.waiting, self.piece)
            self.waiting = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if out:
                return out
        return b""


def _read_record(stream: MemberStream, with_payload: bool) -> tuple:
    """One record of the current member, checked to its last byte."""
    data = stream.read()
    while (end := data.find(b"\r\n\r\n")) < 0:
        piece = stream.read()
        if not piece:
            raise BrokenRecord("no end of the record header")
        data += piece
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise BrokenRecord(f"not a record: {version[:20]!r}")
    head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    left, data = int(head["content-length"]), data[end + 4 :]
    whole, payload, http, kept = hashlib.sha1(), hashlib.sha1(), b"", []
    in_payload, size = not head.get("content-type", "").startswith("application/http"), 0
    while True:
        part, data = data[:left], data[left:]
        left -= len(part)
        whole.update(part)
        if not in_payload:
            http += part
            if (at := http.find(b"\r\n\r\n")) >= 0:
                in_payload, part, http = True, http[at + 4 :], http[: at + 2]
        if in_payload:
            payload.update(part)
            size += len(part)
            if with_payload:
                kept.append(part)
        if not left:
            break
        data = stream.read()
        if not data:
            raise BrokenRecord("the block is shorter than its Content-Length")
    while piece := stream.read():
        data += piece
    if data != b"\r\n\r\n":
        raise BrokenRecord("the record does not end after its block")
    stated = {k: head.get(f"warc-{k}-digest", "").removeprefix("sha1:") for k in ("block", "payload")}
    revisit = head["warc-type"] == "revisit"
    if stated["block"] and stated["block"] != base32_sha1(whole.digest()):
        raise BrokenRecord("block digest")
    if not revisit and stated["payload"] and stated["payload"] != base32_sha1(payload.digest()):
        raise BrokenRecord("payload digest")
    if revisit and (m := re.search(rb"(?im)^content-length:\s*(\d+)", http)):
        size = int(m[1])
    bare = lambda name: head[name].strip("<>") if name in head else None
    return (
        bare("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), bare("warc-refers-to"),
        stated["payload"] or base32_sha1(payload.digest()), size, b"".join(kept) if with_payload and not revisit else None,
    )


def read_records(source: BinaryIO, with_payload: bool = True, piece: int = PIECE) -> Iterator[tuple]:
    """(offset, id, type, uri, refers-to id, payload digest, payload size, payload) of each record in order."""
    stream = MemberStream(source, piece)
    while stream.next_member():
        try:
            yield stream.offset, *_read_record(stream, with_payload)
        except (BrokenRecord, zlib.error, ValueError, KeyError) as error:
            raise BrokenRecord(f"record at byte {stream.offset}: {error}") from error


def with_revisits(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """key, url, payload (binary) and refers_to: the smallest key with an equal payload, null for responses."""
    pages = df.select(
        df[key].alias("own_key"),
        F.coalesce(df[url].cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(df[html].cast("string"), F.lit("")), "utf-8").alias("payload"),
    )
    digest = F.sha1("payload")
    repeated = written(
        pages.where(F.length("payload") >= least_bytes)
        .select(digest.alias("digest"), "own_key")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("own_key").alias("first"))
        .where("n > 1 AND first IS NOT NULL")
        .select("digest", "first"),
        "repeated",
    )
    joined = pages.withColumn("digest", digest).join(
        broadcast_if_small(repeated, repeated.count(), BROADCAST_ROWS), "digest", "left"
    )
    return joined.select(
        "own_key", "url", "payload", F.when(~F.col("own_key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write_archives(
    df: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    folder: str | None = None,
    archive_bytes: int = ARCHIVE_BYTES,
    level: int = 6,
) -> DataFrame:
    """Write every row as a record; returns the manifest (archive, records, bytes) as a stored table."""
    spark = df.sparkSession
    folder = folder or work_path(spark, "archives")
    arrow_rows(spark, TEXT_ROWS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        base = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}"
        out, name, done, records, size = None, "", [], 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((posixpath.join(folder, name), records, size))

        for batch in batches:
            for own, uri, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or size >= archive_bytes:
                    close()
                    name, records, size = f"{base}-{len(done):05d}.warc.gz", 0, 0
                    out = store.open_output_stream(posixpath.join(path, name), compression=None)
                refers = None if refers is None else f"urn:page:{refers}"
                packed = record_bytes(f"urn:page:{'' if own is None else own}", uri, payload, refers, level)
                out.write(packed)
                records, size = records + 1, size + len(packed)
        close()
        if done:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("archive", "records", "bytes"), d, strict=True)) for d in done],
                schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]),
            )

    return written(with_revisits(df, key, url, html, least_bytes).mapInArrow(write, MANIFEST), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives that the manifest lists, one archive after another in each task."""
    arrow_rows(spark, TEXT_ROWS)
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(archive)
                with store.open_input_stream(path, compression=None) as source:
                    try:
                        for record in read_records(source, with_payload):
                            rows.append((archive, *record))
                            if len(rows) >= (TEXT_ROWS if with_payload else 4096):
                                yield packed()
                                rows = []
                    except BrokenRecord as error:
                        raise BrokenRecord(f"{archive}: {error}") from error
        if rows:
            yield packed()

    archives = manifest.select("archive")
    return archives.repartition(max(1, archives.count())).mapInArrow(read, RECORDS)


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back: key, payload_bytes, payload_digest, record_type, refers_to."""
    kind = df.schema[key].dataType
    records = read_archives(df.sparkSession, write_archives(df, key, url, html, least_bytes), with_payload=False)

    def own(urn: str):
        bare = F.substring(F.col(urn), len("urn:page:") + 1, 1 << 30)
        return F.when(bare != "", bare).cast(kind)

    return records.select(
        own("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", own("refers_to_id").alias("refers_to")
    )
