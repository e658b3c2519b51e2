from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest
from pyarrow import fs

from contrail.llm import warc as W


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def archive(payloads, piece=W.PIECE):
    return b"".join(W.record_bytes(f"urn:page:{i}", "http://a b/\r\nX: y", p, None, 6) for i, p in enumerate(payloads))


@pytest.mark.parametrize("piece", [1, 7, 4096, W.PIECE])
def test_sequential_reader_returns_payloads(piece):
    rng = random.Random(piece)
    payloads = [b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", bytes(rng.randrange(256) for _ in range(900)), b"a" * 5000]
    got = list(W.read_records(io.BytesIO(archive(payloads)), piece=piece))
    assert [r[7] for r in got] == payloads
    assert [r[5] for r in got] == [b32(p) for p in payloads]
    data = archive(payloads)
    assert [gzip.decompress(data[a:b])[:8] for a, b in zip([r[0] for r in got], [r[0] for r in got][1:] + [len(data)])] == [b"WARC/1.1"] * 5


def remake(change):
    return gzip.compress(change(gzip.decompress(W.record_bytes("urn:page:1", "u", b"payload text", None, 6))))


@pytest.mark.parametrize(
    "data",
    [
        remake(lambda d: d.replace(b"payload text", b"payload tent")),
        remake(lambda d: d.replace(b"\r\nContent-Length: 9", b"\r\nContent-Length: 8")),
        remake(lambda d: d[:-9]),
        remake(lambda d: d + b"more"),
        remake(lambda d: d.replace(b"WARC/1.1", b"HTTP/1.1")),
        archive([b"x" * 500])[:-20],
        b"not gzip at all",
    ],
)
def test_broken_records_are_refused(data):
    with pytest.raises(W.BrokenRecord):
        list(W.read_records(io.BytesIO(data)))


def expected(rows, least=0):
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = min(k, first.get(h or "", k))
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "") if len(data) >= least else None
        refers = f if f is not None and f != k else None
        out.append((k, len(data), b32(data), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(spark, least):
    rows = [
        (5, "http://a/é", "<p>x</p>"), (3, None, "<p>x</p>"), (3, None, "<p>x</p>"), (9, "u", None), (8, "u", ""), (None, "u", "<p>x</p>"),
        (None, "v", "only"), (11, "u", "é" * 100000), (12, "u", "abc"), (13, "u", "abc"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(map(tuple, W.round_trip(df, least_bytes=least).collect()), key=str)
    assert got == expected(rows, least)
    assert W.round_trip(df.limit(0)).count() == 0


def test_archives_roll_and_keep_payloads(spark):
    rows = [(i, "u", f"text {i % 40} " * 50) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = W.write_archives(df, archive_bytes=2000)
    listed = manifest.collect()
    assert len(listed) > 5 and sum(r.records for r in listed) == 100
    for r in listed[:2]:
        store, path = fs.FileSystem.from_uri(r.archive)
        assert store.get_file_info(path).size == r.bytes
    got = W.read_archives(spark, manifest).collect()
    assert {r.record_id: bytes(r.payload).decode() for r in got if r.record_type == "response"} == {
        f"urn:page:{i}": h for i, _, h in rows[:40]
    }
