"""Content-defined payload chunking: gear-hash cuts, chunks stored once, ordered chunk lists rebuild verified media."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import TwiceFilter, build_twice
from .common import Stored, frugal, mix64, release, slices, strings

BLOCK = 576
LEVEL = 3
#: Gear window in bytes; cuts fall where the hash's highest bits are zero, 1 position in 2^CUT_BITS on average.
WINDOW, CUT_BITS = 32, 11
MIN_CHUNK, MAX_CHUNK = 256, 1 << 15
#: Chunks expected in a document, for the filter's size only.
CHUNKS_A_DOC = 3
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def pad(payload: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of 576."""
    return payload + b"\xff" * (max(BLOCK, -(-len(payload) // BLOCK) * BLOCK) - len(payload))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling gear hash at every byte: of the last 32 bytes, each shifted left by its distance. By doubling."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width].copy() << np.uint32(width)
        width *= 2
    return h


def cut_points(marks: np.ndarray, begin: int, end: int) -> list[int]:
    """Ends of the chunks of data[begin:end]: the first mark at least MIN_CHUNK on, MAX_CHUNK on at the latest."""
    out, at = [], begin
    own = marks[np.searchsorted(marks, begin) : np.searchsorted(marks, end)].tolist()
    i = 0
    while end - at > MIN_CHUNK:
        while i < len(own) and own[i] + 1 < at + MIN_CHUNK:
            i += 1
        cut = min(own[i] + 1 if i < len(own) else end, at + MAX_CHUNK, end)
        out.append(cut)
        at = cut
    if at < end:
        out.append(end)
    return out


def chunk_payloads(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each padded payload. A chunk's end depends on the bytes since its begin alone.

    The window reaches over a payload's begin only where no cut may fall (MIN_CHUNK is beyond WINDOW).
    """
    joined = b"".join(payloads)
    marks = np.flatnonzero(gear(np.frombuffer(joined, np.uint8)) >> np.uint32(32 - CUT_BITS) == 0)
    out, at = [], 0
    for p in payloads:
        ends = cut_points(marks, at, at + len(p))
        out.append([joined[a:b] for a, b in zip([at, *ends], ends, strict=False)])
        at += len(p)
    return out


def _payloads(batch: pa.RecordBatch):
    at, data = strings(batch.column("text"))
    for a, b in slices(at):
        texts = [data[at[i] : at[i + 1]].tobytes() for i in range(a, b)]
        yield a, texts, chunk_payloads([pad(t) for t in texts])


def _digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def features(payload_bytes: int, chunks: list[bytes]) -> str:
    """Chunk count, mean sample, and an 8-bin histogram of samples in per mille, from the bytes read back."""
    bins, total = np.zeros(8, np.int64), 0
    for c in chunks:
        x = np.frombuffer(c, np.uint8)
        bins += np.bincount(x >> 5, minlength=8)
        total += int(x.sum(dtype=np.int64))
    return f"chunks={len(chunks)};mean={total / payload_bytes:.4f};hist=" + ",".join(str(int(v) * 1000 // payload_bytes) for v in bins)


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
_NAMES = [x.split(" ")[0] for x in RESULT.split(", ")]


def read_media(batches):
    """Rows (doc_id, n_bytes, chunks: list of struct(digest, frame)) to features of the verified payloads."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for doc_id, n_bytes, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "chunks")), strict=True):
            whole, media, size, media_size, chunks, tail = hashlib.sha256(), hashlib.sha256(), 0, 0, [], b""
            for x in stored:
                if x["frame"] is None:
                    raise ValueError(f"document {doc_id}: a chunk is missing")
                chunk = unpack.decompress(x["frame"])
                if _digest(chunk) != x["digest"]:
                    raise ValueError(f"document {doc_id}: a chunk is damaged")
                whole.update(chunk)
                media.update(x["frame"])
                size, media_size, tail = size + len(chunk), media_size + len(x["frame"]), (tail + chunk)[-32:]
                chunks.append(chunk)
            rows.append((doc_id, n_bytes, size, whole.hexdigest(), zlib.crc32(tail), media_size, media.hexdigest(), features(size, chunks)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(_TYPES), _TYPES, strict=True)], _NAMES)


class MediaStore:
    """Two tables in the shared folder.

    media: a row for each document, with its ordered chunk list: digest, and the chunk's frame unless the chunk may be
    repeated. chunks: digest and frame of those that may be, once each. A payload's stored form is its frames in order.
    """

    def __init__(self, docs: DataFrame):
        """Stores text of every row of `docs` (doc_id, text). Null counts as empty."""
        sc = docs.sparkSession.sparkContext

        def hashes_of(batch):
            for _, _, chunked in _payloads(batch):
                yield np.frombuffer(b"".join(_digest(c)[:8] for own in chunked for c in set(own)), np.uint64)

        twice = build_twice(docs.select("text"), hashes_of, docs.count() * CHUNKS_A_DOC)
        sent = sc.broadcast((twice.bits.tobytes(), twice.log2))

        @frugal
        def store(batches):
            filt, pack = TwiceFilter(*sent.value), zstandard.ZstdCompressor(level=LEVEL)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for first, texts, chunked in _payloads(batch):
                    digests = [_digest(c) for own in chunked for c in own]
                    shared = iter(filt.suspects(np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)))
                    digests, lists, seen, once = iter(digests), [], set(), []
                    for own in chunked:
                        row = []
                        for c in own:
                            d, far = next(digests), next(shared)
                            if far and d not in seen:  # the frames of one slice are sent once
                                seen.add(d)
                                once.append({"digest": d, "frame": pack.compress(c)})
                            row.append({"digest": d, "frame": None if far else pack.compress(c)})
                        lists.append(row)
                    kind = pa.list_(pa.struct([("digest", pa.binary()), ("frame", pa.binary())]))
                    rows = [ids[first : first + len(texts)], list(map(len, texts)), lists, [once] + [[]] * (len(texts) - 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), kind, kind), strict=True)], ["doc_id", "n_bytes", "chunks", "shared"])

        kind = "array<struct<digest:binary,frame:binary>>"
        rows = docs.select("doc_id", "text").mapInArrow(store, f"doc_id long, n_bytes long, chunks {kind}, shared {kind}")
        self._raw = Stored(rows, "media", "none")
        once = self._raw.df.select(F.explode("shared").alias("x")).select("x.digest", "x.frame").groupBy("digest").agg(F.first("frame").alias("frame"))
        self._shared = Stored(once, "chunks", "none")
        sent.unpersist()
        self.media, self.chunks = self._raw.df.select("doc_id", "n_bytes", "chunks"), self._shared.df
        release(docs.sparkSession)

    def payload_rows(self) -> DataFrame:
        """(doc_id, n_bytes, chunks) with every frame in place.

        Rows that hold all their frames are read where they are; the others get the missing ones by a join on digest and
        are put together again by row. A chunk that very many documents share is one row of the join's small side.
        """
        whole = ~F.exists("chunks", lambda x: x["frame"].isNull())
        rows = self.media.withColumn("row", F.monotonically_increasing_id())
        part = rows.where(~whole).select("row", "doc_id", "n_bytes", F.posexplode("chunks").alias("i", "x")).select("row", "doc_id", "n_bytes", "i", "x.digest", F.col("x.frame").alias("own"))
        found = part.join(self.chunks, "digest", "left")
        item = F.struct("i", "digest", F.coalesce("own", "frame").alias("frame"))
        again = found.groupBy("row", "doc_id", "n_bytes").agg(F.array_sort(F.collect_list(item)).alias("c"))
        again = again.select("doc_id", "n_bytes", F.transform("c", lambda x: F.struct(x["digest"], x["frame"])).alias("chunks"))
        return self.media.where(whole).union(again)


def media_features(docs: DataFrame) -> DataFrame:
    """Stores text of every row of `docs` as chunked media, reads it back, verifies it and returns RESULT.

    Null and empty texts are 576 bytes 255. Equal texts get equal values; repeated rows are stored and returned as often
    as they come. Other columns are not looked at; an empty table gives an empty result.
    """
    return MediaStore(docs).payload_rows().mapInArrow(read_media, RESULT)
