"""WARC records as a chunked table: a record is the concatenation of its chunk rows in order.

An archive is the chunk rows of one file of the table, record after record; written one after the other they are a WARC
file. A payload beyond one chunk streams through several rows, so neither writer nor reader builds whole records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import BinaryIO
from uuid import NAMESPACE_OID, uuid5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import TwiceFilter, build_once
from .common import Stored, strings

CHUNK_BYTES = 1 << 16
ROWS = 512
#: A record's header ends within so many bytes, or it is malformed.
HEADER_BYTES = 1 << 20
#: Repeated payloads up to this many go to all executors (about 20 MB); beyond, a filter of them goes, and only rows that it
#: suspects are joined.
BROADCAST_KEYS = 100_000
CHUNKS = "record_id string, chunk_no int, n_chunks int, data binary, state binary"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
DATE = "2000-01-01T00:00:00Z"


def record_urn(page_id: int | None, digest: str, place: str = "") -> str:
    """A record's name: of its page and payload, so that a revisit can name its response; by its place without a page."""
    return f"urn:uuid:{uuid5(NAMESPACE_OID, f'{place if page_id is None else page_id}/{digest}')}"


def record_header(kind: str, place: str, url: str | None, digest: str, size: int, page_id: int | None, refers_to: int | None, date: str = DATE) -> bytes:
    """The header of one record, and that of the HTTP message in it. `size` is the whole payload's; a revisit has no block."""
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_urn(page_id, digest, place)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    message = b""
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_urn(refers_to, digest)}>", f"X-Refers-To-Page: {refers_to}", "Content-Length: 0"]
    else:
        message = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        lines.append(f"Content-Length: {len(message) + size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + message


def chunked(header: bytes, payload: memoryview, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(chunk number, number of chunks, bytes, chain) of a record.

    The chain is an incremental digest: SHA-256 of the chain before it and the chunk, so a reader can verify each chunk
    as it passes and notice one that is missing or out of order.
    """
    room = max(0, size - len(header) - 4)
    cuts = [0, min(room, len(payload)), *range(min(room, len(payload)) + size, len(payload), size)]
    if cuts[-1] < len(payload):
        cuts.append(len(payload))
    chain = b""
    for i in range(len(cuts) - 1):
        data = b"".join((header if i == 0 else b"", payload[cuts[i] : cuts[i + 1]], b"\r\n\r\n" if i == len(cuts) - 2 else b""))
        chain = hashlib.sha256(chain + data).digest()
        yield i, len(cuts) - 1, data, chain


class RecordReader:
    """Takes the bytes of one archive or record piece by piece and gives each record's fields as it ends.

    Holds a header at most and an incremental digest, never a payload. The payload of an HTTP message is what follows its
    header.
    """

    def __init__(self):
        self._buffer, self._left, self._fields, self._hash, self._http = b"", 0, None, None, False

    def feed(self, data: bytes) -> Iterator[dict]:
        view = memoryview(data)
        while True:
            if self._fields is None:
                before = len(self._buffer)
                self._buffer += bytes(view[: HEADER_BYTES + 4 - before])
                stripped = self._buffer.lstrip(b"\r\n")
                end = stripped.find(b"\r\n\r\n")
                if end < 0:
                    if len(self._buffer) > HEADER_BYTES:
                        raise ValueError("no WARC header")
                    return
                used = len(self._buffer) - len(stripped) + end + 4
                view = view[used - before :]
                lines = stripped[:end].decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("no WARC header")
                self._fields = dict(x.split(": ", 1) for x in lines[1:])
                self._left, self._hash, self._buffer = int(self._fields["Content-Length"]), hashlib.sha256(), b""
                self._http = self._left > 0 and self._fields.get("Content-Type", "").startswith("application/http")
            part = view[: self._left]
            if self._http:
                self._buffer += bytes(part)
                end = self._buffer.find(b"\r\n\r\n")
                if end < 0 and (len(part) == self._left or len(self._buffer) > HEADER_BYTES):
                    raise ValueError("no HTTP header")
                if end >= 0:
                    self._hash.update(self._buffer[end + 4 :])
                    self._http, self._buffer = False, b""
            else:
                self._hash.update(part)
            self._left -= len(part)
            view = view[len(part) :]
            if self._left:
                return  # more of this payload is to come
            yield self._fields | {"sha256": self._hash.hexdigest()}
            self._fields = None

    def feed_all(self, stream: BinaryIO, size: int = CHUNK_BYTES) -> Iterator[dict]:
        while data := stream.read(size):
            yield from self.feed(data)


def assign_types(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """`pages` (page_id, url, html) with digest, n_bytes, record_type and refers_to.

    Of rows with equal payloads of at least `min_bytes`, those of the least page_id are response, others revisit it. Only
    digests and ids are grouped; a digest that many rows share is combined before the shuffle. Payloads stay where they are
    while the repeated ones are few enough to be named to all; beyond that, only those that may be repeated are joined.
    """
    html = F.coalesce("html", F.lit(""))
    full = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    narrow = full.where(F.col("n_bytes") >= min_bytes).select("page_id", "digest")
    firsts = Stored(narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "payloads")
    found = firsts.df.count()
    if found <= BROADCAST_KEYS:
        out = full.join(F.broadcast(firsts.df), "digest", "left")
    else:
        once = build_once(firsts.df.select(F.xxhash64("digest").alias("h")), lambda b: iter([b.column("h").to_numpy().view(np.uint64)]), found)
        sent = pages.sparkSession.sparkContext.broadcast((once.bits.tobytes(), once.log2))

        @F.pandas_udf("boolean")
        def suspected(h: pd.Series) -> pd.Series:
            return pd.Series(TwiceFilter(*sent.value).suspects(h.to_numpy().view(np.uint64)))

        marked = full.withColumn("_some", suspected(F.xxhash64("digest")))
        alone = marked.where("not _some").drop("_some").withColumn("first", F.lit(None).cast("long"))
        out = alone.unionByName(marked.where("_some").drop("_some").join(firsts.df, "digest", "left"))
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return out.withColumn("refers_to", refers).drop("first").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def _write(chunk_bytes: int, date: str):
    def write(batches):
        part, n, rows = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            at, data = strings(batch.column("html"))
            names = ("page_id", "url", "digest", "n_bytes", "record_type", "refers_to")
            for i, (page_id, url, digest, size, kind, refers_to) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                n += 1
                record_id = f"{part}:{n}"
                header = record_header(kind, record_id, url, digest, size, page_id, refers_to, date)
                payload = memoryview(b"") if kind == "revisit" else memoryview(data[at[i] : at[i + 1]])
                for chunk_no, n_chunks, chunk, chain in chunked(header, payload, chunk_bytes):
                    rows.append((record_id, chunk_no, n_chunks, chunk, chain))
                    if len(rows) >= ROWS:
                        yield _chunk_batch(rows)
                        rows = []
        if rows:
            yield _chunk_batch(rows)

    return write


def _chunk_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["record_id", "chunk_no", "n_chunks", "data", "state"])


def write_archives(pages: DataFrame, min_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> Stored:
    """A record for each row of `pages`, in the shared folder, dated `date`. Null html is an empty payload."""
    return Stored(assign_types(pages, min_bytes).mapInArrow(_write(chunk_bytes, date), CHUNKS), "warc")


def _read(batches):
    now, reader, chain, expect, rows = None, None, b"", 0, []
    for batch in batches:
        for record_id, chunk_no, n_chunks, data, state in zip(*(batch.column(c).to_pylist() for c in ("record_id", "chunk_no", "n_chunks", "data", "state")), strict=True):
            if record_id != now:
                now, reader, chain, expect = record_id, RecordReader(), b"", 0
            chain = hashlib.sha256(chain + data).digest()
            if chunk_no != expect or chain != state:
                raise ValueError(f"record {record_id}: chunk {chunk_no} is missing, out of order or damaged")
            expect += 1
            for f in reader.feed(data):
                digest, revisit = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "revisit"
                if not revisit and f["sha256"] != digest:
                    raise ValueError(f"record {record_id}: its payload is damaged")
                rows.append((int(f["X-Page-Id"]) if "X-Page-Id" in f else None, int(f["X-Payload-Length"]), digest, f["WARC-Type"], int(f["X-Refers-To-Page"]) if revisit else None))
        if len(rows) >= ROWS:
            yield _read_batch(rows)
            rows = []
    if rows:
        yield _read_batch(rows)


def _read_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A record of one chunk is read where it is stored. Chunks of larger records are brought together in order and
    stream through an incremental digest. Every chunk's chain and every response's digest are verified.
    """
    whole = chunks.where("n_chunks = 1").mapInArrow(_read, READ)
    large = chunks.where("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, READ)
    return whole.union(large)


def archive_pages(pages: DataFrame, min_bytes: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes a record for every row of `pages`, reads the archives back and returns one row for each.

    Null html is an empty payload; null page_id and url are left out of the header, and rows without an id are response.
    Rows of equal page_id and payload count as one page. An empty table gives an empty result; other columns are dropped.
    """
    return read_archives(write_archives(pages, min_bytes, chunk_bytes).df)
