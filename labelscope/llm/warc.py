"""WARC archives: one gzip member per record, written and read sequentially.

Records with equal payloads of at least ``min_bytes`` are stored once: the one
with the largest id is the ``response``, the others are ``revisit`` records
(identical-payload-digest profile) that refer to it and hold only the HTTP
header. Writers put archives of about ``roll_bytes`` in a folder that all
executors share; the manifest is a table that Spark commits, so only files of
successful tasks count and a lost executor's files are written again under
another name. The reader inflates a file chunk by chunk, frames each record by
Content-Length, and verifies block and payload digests; memory is bounded by
the chunk size, whatever the record's length.

Defined results: a null payload is empty; a null or unsafe URL is stored
percent-encoded; an empty table gives no archive and no rows; rows that repeat
the largest id of their group are all responses, and so are rows without id,
which no other record refers to and which come back without id; a damaged record is reported
with ``ok`` false and ``error`` text, and the rest of its file is not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm._io import ensure_checkpoint_dir, stage_table

# The archive format's version line, profile and media types.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

CHUNK = 256 << 10
ROLL_BYTES = 64 << 20
_ID = "urn:record:"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


# --- deduplication ------------------------------------------------------------

def with_revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``rows(id, url, payload)`` with ``digest`` and ``refers_to`` (null: response).

    Groups are counted on digests alone; only digests that occur twice join back
    to the payloads, and that join has a plain scan on either side, so a hot
    digest is split as a skewed join."""
    size = F.octet_length("payload")
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("large", size >= min_bytes)
    groups = (rows.where("large").groupBy(F.col("digest").alias("d"))
              .agg(F.max("id").alias("target"), F.count("*").alias("n")).where("n > 1").drop("n"))
    groups = stage_table(groups, "warc-groups")
    out = rows.join(groups, (rows["digest"] == groups["d"]) & rows["large"], "left")
    refers = F.when(F.col("id") < F.col("target"), F.col("target"))
    return out.select("id", "url", "payload", "digest", refers.alias("refers_to"))


# --- writing --------------------------------------------------------------------

def record_bytes(record_id: int | None, url: str | None, payload: bytes, digest: bytes,
                 refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode("ascii")
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION.decode("ascii"),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'none' if record_id is None else record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"Content-Type: {HTTP_TYPE}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z",
                   roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Write ``rows(id, url, payload, digest, refers_to)``; returns the committed
    manifest ``(path, n_records, n_bytes)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _fs(folder)
        filesystem.create_dir(root, recursive=True)
        task = TaskContext.get()
        done: list[dict] = []
        out, size, n = None, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done[-1] |= {"n_records": n, "n_bytes": size}
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, size, n = filesystem.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    done.append({"path": f"{folder}/{name}"})
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record_bytes(r["id"], r["url"], r["payload"], r["digest"], r["refers_to"], date))
                member += z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
                [("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return stage_table(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


# --- reading --------------------------------------------------------------------

class DamagedRecord(ValueError):
    """A record whose framing or digest does not hold."""


class SequentialReader:
    """Records of one archive, inflated and framed chunk by chunk."""

    def __init__(self, stream: BinaryIO, chunk: int = CHUNK):
        self.stream, self.chunk = stream, chunk
        self.raw = b""  # compressed bytes not yet inflated
        self.buf = bytearray()  # inflated bytes of the current member
        self.member = None

    def _fill(self) -> bool:
        """Inflate a little more of the current member; False at its end."""
        while not self.member.eof:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    raise DamagedRecord("gzip member cut short")
            try:
                got = self.member.decompress(self.raw, self.chunk)
            except zlib.error as e:
                raise DamagedRecord(f"gzip: {e}") from None
            self.raw = self.member.unconsumed_tail or self.member.unused_data
            if got:
                self.buf += got
                return True
        return False

    def _until(self, mark: bytes, what: str) -> bytes:
        seen = 0
        while (at := self.buf.find(mark, max(seen - len(mark), 0))) < 0:
            seen = len(self.buf)
            if not self._fill():
                raise DamagedRecord(f"no end of {what}")
        got = bytes(self.buf[:at])
        del self.buf[: at + len(mark)]
        return got

    def _body(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.buf and not self._fill():
                raise DamagedRecord("block shorter than Content-Length")
            got = bytes(self.buf[:length])
            del self.buf[: len(got)]
            length -= len(got)
            yield got

    def __iter__(self) -> Iterator[dict]:
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    return
            self.member, self.buf = zlib.decompressobj(31), bytearray()
            yield self._record()

    def _record(self) -> dict:
        head = self._until(b"\r\n\r\n", "the header").decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/1."):
            raise DamagedRecord("no WARC version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            raise DamagedRecord("no Content-Length") from None
        block, payload, n, http = hashlib.sha1(), hashlib.sha1(), 0, bytearray()
        is_http, in_head = fields.get("content-type", "").startswith("application/http"), True
        for part in self._body(length):
            block.update(part)
            if is_http and in_head:
                http += part
                at = http.find(b"\r\n\r\n")
                if at < 0:
                    continue
                part, in_head = bytes(http[at + 4:]), False
                del http[at:]
            payload.update(part)
            n += len(part)
        for expected in (b"\r\n\r\n",):
            if b"".join(self._body(len(expected))) != expected:
                raise DamagedRecord("record does not end after Content-Length bytes")
        if self.buf or self._fill():
            raise DamagedRecord("bytes after the record in its member")
        kind = fields.get("warc-type", "")
        stated = {k: fields.get(f"warc-{k}-digest", "").partition(":")[2] for k in ("block", "payload")}
        if stated["block"] and stated["block"] != base32(block.digest()):
            raise DamagedRecord("block digest differs")
        if kind == "response" and stated["payload"] and stated["payload"] != base32(payload.digest()):
            raise DamagedRecord("payload digest differs")
        if kind == "revisit":  # the payload lies in the record it refers to
            sizes = [x.partition(b":")[2] for x in bytes(http).split(b"\r\n") if x.lower().startswith(b"content-length:")]
            n = int(sizes[0]) if sizes else None
        return {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind,
                "url": fields.get("warc-target-uri"), "payload_bytes": n,
                "payload_digest": stated["payload"] or base32(payload.digest()),
                "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of the archives named in ``manifest(path)``, one file per task at
    a time: record_id, record_type, url, payload_bytes, payload_digest,
    refers_to, ok, error, path."""
    schema = ("record_id string, record_type string, url string, payload_bytes long, payload_digest string, "
              "refers_to string, ok boolean, error string, path string")
    kinds = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                       ("ok", pa.bool_()), ("error", pa.string()), ("path", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                filesystem, at = _fs(path)
                out: list[dict] = []
                with filesystem.open_input_stream(at, compression=None) as stream:
                    try:
                        for r in SequentialReader(stream):
                            out.append(r | {"ok": True, "error": None, "path": path})
                            if len(out) == 4096:
                                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                                out = []
                    except DamagedRecord as e:
                        out.append({"ok": False, "error": str(e), "path": path})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=kinds)

    files = max(manifest.count(), 1)
    return manifest.select("path").repartition(files).mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str, url_col: str, payload: str | F.Column,
               min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back:
    ``id, payload_bytes, payload_digest, record_type, refers_to``. Raises when a
    record read back is damaged."""
    import uuid

    payload = F.col(payload) if isinstance(payload, str) else payload
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    root = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{root}/warc-{uuid.uuid4().hex}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    read = read_archives(write_archives(with_revisits(rows, min_bytes), folder))
    number = lambda c: F.nullif(F.regexp_extract(c, r"(-?\d+)$", 1), F.lit("")).cast("long")
    failed = F.raise_error(F.concat(F.lit("damaged record in "), F.col("path"), F.lit(": "), F.col("error")))
    return read.select(
        F.when(F.col("ok"), number("record_id")).otherwise(failed.cast("long")).alias("id"),
        "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))
