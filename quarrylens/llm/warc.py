"""WARC archives: a writer with payload deduplication and a salvage reader.

Writing: the payload digest of every page is grouped once (combined before the shuffle); of equal payloads
the one with the largest id is a ``response`` record, the others are ``revisit`` records that refer to it.  Only
digests that occur more than once are kept and joined to the pages.  Every record is one gzip member, whatever its
length; Spark's own text writer puts them into files, so archives can lie in any store that Spark can write.

Reading: files come through Spark's binary source and are inflated window by window, each member once, so the time
is linear in the file and no record is held unless its payload is asked for.  Every record is checked (gzip checksum,
version line, headers, block length, block and payload digests where stated, by SHA-1, SHA-256, SHA-512 or MD5).
After a failed check the reader searches for the next byte from which a valid member, or in plain archives a valid
version line, begins, goes on there, and logs the bytes between as a quarantined gap with the check that failed.  Every
byte of a file belongs to a record that is returned or to a logged gap.  A member may hold several records.

Defined cases: a null payload is an empty one; a null id writes no id and reads back null; repeated rows
with the largest id of their payload are all responses; an empty table writes no record; truncated or
foreign bytes are gaps; a digest by another algorithm is not checked; a revisit that does not state its payload's length has a
null length; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, staged

DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MIN_REVISIT_BYTES = 0
#: Records are handed to the writer in runs of at least so many bytes, and so many runs make a file.
RUN_BYTES = 1 << 22
RUNS_PER_FILE = 16
#: A gzip member ends with the top byte of its content's length, which is 0 below 16 MiB.
_LONG = 1 << 24
_MAGIC = b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_PLACE = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_WINDOWS = (1 << 12, 1 << 18)

RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, file string, at bigint"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str | None = None) -> bytes:
    """One record, uncompressed.  A revisit has the response's headers but no payload."""
    revisit = refers_to is not None
    digest = digest or digest32(payload)
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        f"X-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Closes a run whose last page record is too long to end with a zero byte.
_CLOSING = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:run:end>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()


def linked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest in hex, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.select("page_id", "digest", F.octet_length("payload").alias("size")).where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.min("page_id").alias("least")).where("least < response").select(F.col("digest").alias("d"), "response")
    # a table of its own: Spark sees its size and broadcasts it if it is small; if it is not, both sides are plain shuffles, and hot digests are split
    groups = staged(groups, "warc-copies")
    joined = rows.join(groups, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= min_bytes), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("response"), F.col("response")).alias("refers_to"))


def write(pages: DataFrame, path: str, compress: bool = True, level: int = 6, run_bytes: int = RUN_BYTES, runs_per_file: int = RUNS_PER_FILE, **columns) -> str:
    """Write one record for each row into archives under ``path`` (any store Spark writes).

    Spark's text writer ends every value with its line separator.  Here that is the byte with which the last member of a run
    ends anyway: 0, the top byte of a length below 16 MiB.  A run that would end with a longer record is closed by an empty ``warcinfo`` record.
    """
    frame = linked(pages, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, last = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal size
            if compress and last >= _LONG:
                held.append(_member(_CLOSING, level))
            value = b"".join(held)[:-1]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                raw = record_bytes(page_id, url, payload, refers_to, base64.b32encode(bytes.fromhex(digest)).decode("ascii"))
                last = len(raw)
                held.append(_member(raw, level) if compress else raw)
                size += len(held[-1])
                if size >= run_bytes:
                    yield close()
        if held:
            yield close()

    lines = frame.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00" if compress else "\n").option("maxRecordsPerFile", runs_per_file).text(path)
    return path


@dataclass
class Gap:
    start: int
    end: int
    reason: str


@dataclass
class Record:
    """``size`` and ``digest`` are those of the payload (``digest``: bare base32 SHA-1, or what a revisit states); ``payload`` only on demand."""

    at: int
    headers: dict[str, str]
    size: int | None
    digest: str
    payload: bytes | None = None


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _windows(raw: memoryview, at: int) -> Iterator[memoryview]:
    size, most = _WINDOWS
    while at < len(raw):
        yield raw[at : at + size]
        at, size = at + size, min(2 * size, most)


class _Stream:
    """Bytes that come in pieces and are read once, from front to back."""

    def __init__(self, pieces: Iterator[memoryview | bytes]):
        self._pieces, self._held, self.pulled = pieces, memoryview(b""), 0

    def left(self) -> bool:
        if not len(self._held):
            piece = next(self._pieces, b"")
            self.pulled += len(piece)
            self._held = memoryview(piece)
        return len(self._held) > 0

    @property
    def used(self) -> int:
        return self.pulled - len(self._held)

    def head(self) -> bytes:
        """All before the next empty line, which must begin with a version line."""
        found = bytearray()
        while self.left():
            seen = max(0, len(found) - 3)
            found += self._held
            self._held = memoryview(b"")
            if len(found) >= 10 and not _LINE.match(found):
                break
            end = found.find(b"\r\n\r\n", seen)
            if end >= 0:
                self._held = memoryview(bytes(found[end + 4 :]))
                return bytes(found[:end])
        raise ValueError("headers do not end" if _LINE.match(found) else "no version line")

    def take(self, n: int) -> Iterator[memoryview]:
        while n:
            if not self.left():
                raise ValueError("bad length")
            part, self._held = self._held[:n], self._held[n:]
            n -= len(part)
            yield part


class _Digest:
    """A digest as a header states it; algorithms that are not known here are not checked."""

    ALGORITHMS = ("sha1", "sha256", "sha512", "md5")

    def __init__(self, stated: str):
        algorithm, _, self.value = stated.partition(":")
        algorithm = algorithm.strip().lower().replace("-", "")
        self.hash = hashlib.new(algorithm) if algorithm in self.ALGORITHMS else None

    def update(self, part: memoryview) -> None:
        if self.hash:
            self.hash.update(part)

    def fails(self) -> bool:
        if not self.hash:
            return False
        own, value = self.hash.digest(), self.value.strip()
        return value.upper().rstrip("=") != base64.b32encode(own).decode("ascii").rstrip("=") and value.lower() != own.hex()


def _record(stream: _Stream, at: int, keep: bool) -> Record:
    """The next record of a stream; ValueError if a check fails."""
    headers = _headers(stream.head())
    size, kind = headers.get("content-length", ""), headers.get("warc-type")
    if not re.fullmatch("[0-9]+", size) or not kind:
        raise ValueError("bad headers")
    http = headers.get("content-type", "").lower().startswith("application/http")
    block_digest, payload_digest, own = _Digest(headers.get("warc-block-digest", "")), _Digest(headers.get("warc-payload-digest", "")), hashlib.sha1()
    n, kept, front = 0, [], bytearray() if http else None
    for part in stream.take(int(size)):
        block_digest.update(part)
        if front is not None:  # the payload begins after the empty line of the HTTP message
            seen = max(0, len(front) - 3)
            front += part
            end = front.find(b"\r\n\r\n", seen)
            if end < 0:
                continue
            part, front = memoryview(bytes(front[end + 4 :])), None
        n += len(part)
        own.update(part)
        payload_digest.update(part)
        if keep:
            kept.append(bytes(part))
    if b"".join(bytes(x) for x in stream.take(4)) != b"\r\n\r\n":
        raise ValueError("bad length")
    if block_digest.fails():
        raise ValueError("bad block digest")
    if kind == "revisit":
        length = headers.get("x-payload-length", "")
        return Record(at, headers, int(length) if re.fullmatch("[0-9]+", length) else None, headers.get("warc-payload-digest", "").removeprefix("sha1:"))
    if payload_digest.fails():
        raise ValueError("bad payload digest")
    return Record(at, headers, n, base64.b32encode(own.digest()).decode("ascii"), b"".join(kept) if keep else None)


class _Member:
    """The content of the gzip member at ``at``; ``end`` is known when all is read."""

    def __init__(self, raw: memoryview, at: int):
        self.raw, self.at, self.end = raw, at, 0

    def __iter__(self) -> Iterator[bytes]:
        z, end = zlib.decompressobj(31), self.at
        try:
            for window in _windows(self.raw, self.at):
                end += len(window)
                data: bytes | memoryview = window
                while True:
                    out = z.decompress(data, 1 << 20)
                    if out:
                        yield out
                    if z.eof:
                        self.end = end - len(z.unused_data)
                        return
                    data = z.unconsumed_tail
                    if not data and len(out) < 1 << 20:
                        break
        except zlib.error as e:
            raise ValueError(str(e)) from None
        raise ValueError("member does not end")


def _records_at(raw: memoryview, at: int, keep: bool) -> tuple[list[Record], int]:
    """The records of the member, or the plain record, that begins at ``at``, and where it ends."""
    if bytes(raw[at : at + 3]) != _MAGIC:
        stream = _Stream(_windows(raw, at))
        return [_record(stream, at, keep)], at + stream.used
    member = _Member(raw, at)
    stream, out = _Stream(iter(member)), []
    while stream.left():
        out.append(_record(stream, at, keep))
    if not out:
        raise ValueError("empty member")
    return out, member.end


def salvage(raw: bytes | memoryview, keep: bool = False) -> Iterator[Record | Gap]:
    """All records that pass their checks and the gaps between them, in the order of the file."""
    raw = memoryview(raw)
    at, bad, reason = 0, -1, ""
    while at < len(raw):
        try:
            records, end = _records_at(raw, at, keep)
        except ValueError as e:
            if bad < 0:
                bad, reason = at, str(e)
            place = _PLACE.search(raw, at + 1)
            at = place.start() if place else len(raw)
            continue
        if bad >= 0:
            yield Gap(bad, at, reason)
            bad = -1
        yield from records
        at = end
    if bad >= 0:
        yield Gap(bad, len(raw), reason)


def _page(value: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", value)
    return int(m[1]) if m else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _found(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[tuple[str, Record | Gap]]:
    for batch in batches:
        for i in range(batch.num_rows):
            file, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer()
            for found in salvage(memoryview(content or b""), keep):
                yield file, found


def _batches(rows: Iterator[tuple], names: list[str], types: tuple[pa.DataType, ...], most: int = 5000, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row (``RECORD``) for each valid record of the archives under ``path``; payloads on demand."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, r in _found(batches, payloads):
            if isinstance(r, Record):
                h = r.headers
                yield _page(h.get("warc-record-id", "")), h.get("warc-target-uri"), h["warc-type"], r.size, r.digest, _page(h.get("warc-refers-to", "")), r.payload, file, r.at

    return _files(spark, path).mapInArrow(lambda batches: _batches(rows(batches), names, types), RECORD)


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine log: (file, start, end, reason) of all bytes that belong to no valid record."""
    names, types = ["file", "start", "end", "reason"], (pa.string(), pa.int64(), pa.int64(), pa.string())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for file, g in _found(batches, False):
            if isinstance(g, Gap):
                yield file, g.start, g.end, g.reason

    return _files(spark, path).mapInArrow(lambda batches: _batches(rows(batches), names, types), "file string, start bigint, end bigint, reason string")


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, **columns)
    return read(spark, path).where(F.col("record_type").isin("response", "revisit"))
