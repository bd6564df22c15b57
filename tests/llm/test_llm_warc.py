"""WARC round trips, revisits, framing and damage."""

import gzip
import hashlib
import io
import zlib

import pytest

from labelscope.llm import warc as W
from labelscope.session import ensure_checkpoint_dir

LONG = "<p>" + "ü" * 400_000 + "</p>"
PAGES = [(1, "http://a.org/x", "<b>one</b>"), (2, None, None), (3, "http://a.org/\r\ny z", ""), (4, "", "<b>one</b>"),
         (5, "u", LONG), (9, "v", "<b>one</b>"), (7, "w", "\r\n\r\nWARC/1.1\r\n"), (9, "again", "<b>one</b>")]


def expected(rows, least=0):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and i < top[h or ""]
        out.append((i, len(raw), W.base32(hashlib.sha1(raw).digest()), "revisit" if again else "response", top[h or ""] if again else None))
    return sorted(out)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    got = W.round_trip(spark, df, "page_id", "url", "html", least)
    rows = sorted((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect())
    assert rows == expected(PAGES, least)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.round_trip(spark, df, "page_id", "url", "html").count() == 0


def test_archives_roll_and_hold_one_member_per_record(spark):
    rows = W.with_revisits(spark.createDataFrame([(i, f"u{i}", f"page {i}".encode() * 50) for i in range(40)], "id long, url string, payload binary").coalesce(1))
    folder = "file://" + ensure_checkpoint_dir(spark).replace("file:", "").replace("//", "/") + "/warc-roll-test"
    manifest = W.write_archives(rows, folder, roll_bytes=1500)
    files = manifest.collect()
    assert len(files) > 3 and sum(f["n_records"] for f in files) == 40
    raw = open(files[0]["path"].replace("file://", ""), "rb").read()
    members = 0
    while raw:
        z = zlib.decompressobj(31)
        text = z.decompress(raw)
        assert z.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        raw, members = z.unused_data, members + 1
    assert members == files[0]["n_records"]
    read = W.read_archives(manifest)
    assert read.where("ok").count() == 40


def record(i=1, payload=b"hello", refers=None):
    return W.record_bytes(i, "http://x.org", payload, hashlib.sha1(payload).digest(), refers, "2024-01-01T00:00:00Z")


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_sequential_reader_frames_by_length(chunk):
    payloads = [b"a", b"", b"\r\n\r\nWARC/1.1\r\n" * 9, b"z" * 5000]
    raw = b"".join(gzip.compress(record(i, p)) for i, p in enumerate(payloads))
    got = list(W.SequentialReader(io.BytesIO(raw), chunk))
    assert [r["payload_bytes"] for r in got] == [len(p) for p in payloads]
    assert [r["record_id"] for r in got] == [f"urn:record:{i}" for i in range(4)]


@pytest.mark.parametrize("damage", ["cut", "flip", "length", "digest", "version", "tail"])
def test_damage_is_found(damage):
    rec = record(3, b"payload " * 40)
    if damage == "length":
        rec = rec.replace(b"Content-Length: 3", b"Content-Length: 9")
    elif damage == "digest":
        rec = rec.replace(b"payload payload", b"payload Payload", 1)
    elif damage == "version":
        rec = rec.replace(b"WARC/1.1", b"JUNK/1.1")
    elif damage == "tail":
        rec += b"more"
    raw = gzip.compress(record(1)) + gzip.compress(rec)
    if damage == "cut":
        raw = raw[:-20]
    elif damage == "flip":
        raw = raw[:-30] + bytes([raw[-30] ^ 255]) + raw[-29:]
    reader = iter(W.SequentialReader(io.BytesIO(raw), 50))
    assert next(reader)["record_id"] == "urn:record:1"
    with pytest.raises(W.DamagedRecord):
        next(reader)


def test_revisit_holds_no_payload():
    body = record(1, b"x" * 10_000, refers=7)
    assert len(body) < 1200 and b"WARC-Refers-To: <urn:record:7>" in body
    r = next(iter(W.SequentialReader(io.BytesIO(gzip.compress(body)))))
    assert (r["record_type"], r["payload_bytes"], r["refers_to"]) == ("revisit", 10_000, "urn:record:7")
    assert r["payload_digest"] == W.base32(hashlib.sha1(b"x" * 10_000).digest())


def test_rows_without_id_are_responses(spark):
    rows = [(None, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (None, None, None), (None, "http://c/", "own")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in W.round_trip(spark, df, "page_id", "url", "html").collect()), key=str)
    assert got == sorted([(None, "response", None, 4), (3, "revisit", 9, 4), (9, "response", None, 4), (None, "response", None, 0),
                          (None, "response", None, 3)], key=str)
