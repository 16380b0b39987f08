"""Line dedup: two Bloom filters find suspected repeats, only these shuffle for exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import TwiceFilter, build_once, build_twice
from .common import SPACES, Stored, frugal, slices, strings

#: Confirmed keys up to this many go to all executors (about 12 MB). Beyond, a filter of them goes, and the documents that it
#: suspects are joined with their keys.
BROADCAST_KEYS = 100_000
#: Lines expected in a document, for the filter's size only.
LINES_A_DOC = 12


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()  # bytes.lower() changes A-Z alone


def key_digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _docs(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    at, data = strings(batch.column("text"))
    for i in range(len(at) - 1):
        yield data[at[i] : at[i + 1]].tobytes().split(b"\n")


def _distinct(keys: list[bytes], min_chars: int) -> dict[bytes, int]:
    """Key to the first line that has it."""
    first: dict[bytes, int] = {}
    for i, k in enumerate(keys):
        if k and k not in first and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars):
            first[k] = i
    return first


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def dedup_lines(docs: DataFrame, min_docs: int = 2, keep: str = "first", min_chars: int = 1) -> DataFrame:
    """`docs` with repeated lines removed from text, and n_lines (before) and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at least `min_chars` code points
    found in at least `min_docs` rows is a repeat. keep="none" drops all lines of a repeat, keep="first" leaves its first
    line in the row of least doc_id (in each of these rows, where they share that id; in those without an id only if no row
    with the line has one). Null text counts as empty: one empty line, never dropped. Each row counts as a document, so
    repeated rows count. All other columns pass through, but columns named like the new ones are replaced. An empty table
    gives an empty result.

    Texts stay where they are, but for those of documents that hold a repeat, when repeats are too many to be sent to all.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep must be first or none")
    docs = docs.drop("n_lines", "n_dropped")
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text")

    def hashes_of(batch):
        at, _ = strings(batch.column("text"))
        lines = _docs(batch)
        for a, b in slices(at):
            found = [k for _ in range(a, b) for k in _distinct([line_key(x) for x in next(lines)], min_chars)]
            yield _hashes(found)

    twice = build_twice(docs.select("text"), hashes_of, docs.count() * LINES_A_DOC)
    sent = sc.broadcast((twice.bits.tobytes(), twice.log2))

    @frugal
    def suspected(batches):
        filt = TwiceFilter(*sent.value)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for doc, lines in zip(ids, _docs(batch), strict=True):
                first = _distinct([line_key(x) for x in lines], min_chars)
                for (k, i), yes in zip(first.items(), filt.suspects(_hashes(first)), strict=True):
                    if yes:
                        rows.append((key_digest(k), doc, i))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.binary(), pa.int64(), pa.int32()), strict=True)], ["digest", "doc_id", "line"])

    suspects = texts.mapInArrow(suspected, "digest binary, doc_id long, line int")
    confirmed = Stored(
        suspects.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "line")).alias("at"))
        .where(F.col("n") >= min_docs)
        .select("digest", F.col("at.doc_id").alias("first_doc"), F.col("at.line").alias("first_line")),
        "lines",
    )
    names, keep_first = list(docs.columns), keep == "first"
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(batch: pa.RecordBatch, asked, repeats) -> pa.RecordBatch:
        """asked: which keys of a row may be repeats. repeats: for a row, what tells whether and where a key's digest is kept."""
        ids, is_null = batch.column("doc_id").to_pylist(), batch.column("text").is_null().to_pylist()
        texts, n_lines, n_dropped = [], [], []
        for row, lines in enumerate(_docs(batch)):
            keys = [line_key(x) for x in lines]
            first = _distinct(keys, min_chars)
            gone = {}
            for k in asked(first):
                if (hit := repeats(row, key_digest(k))) is not None:
                    gone[k] = first[k] if keep_first and hit == (ids[row], first[k]) else -1
            left = [x for i, (x, k) in enumerate(zip(lines, keys, strict=True)) if k not in gone or gone[k] == i] if gone else lines
            texts.append(None if is_null[row] and not gone else b"\n".join(left).decode())
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    def suspected_by(filt: TwiceFilter):
        return lambda first: [k for k, yes in zip(first, filt.suspects(_hashes(first)), strict=True) if yes]

    found = confirmed.df.count()
    if found <= BROADCAST_KEYS:
        known = sc.broadcast({bytes(r.digest): (r.first_doc, r.first_line) for r in confirmed.df.collect()})
        confirmed.drop()

        @frugal
        def by_broadcast(batches):
            repeats, asked = known.value, suspected_by(TwiceFilter(*sent.value))
            for batch in batches:
                yield rewrite(batch, asked, lambda _, d: repeats.get(d))

        return docs.mapInArrow(by_broadcast, schema)

    once = build_once(confirmed.df.select("digest"), lambda b: iter([_digest_hashes(b.column("digest").to_pylist())]), found)
    real = sc.broadcast((once.bits.tobytes(), once.log2))

    @frugal
    def asking(batches, those: bool):
        """The rows with (or without) a line that may be a repeat, and with them its digests."""
        filt, some = TwiceFilter(*sent.value), TwiceFilter(*real.value)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            lists = []
            for lines in _docs(batch):
                keys = suspected_by(filt)(_distinct([line_key(x) for x in lines], min_chars))
                digests = [key_digest(k) for k in keys]
                lists.append([d for d, yes in zip(digests, some.suspects(_digest_hashes(digests)), strict=True) if yes])
            take = [i for i, x in enumerate(lists) if bool(x) == those]
            rows = batch.take(pa.array(take, pa.int64()))
            if those:
                extra = [pa.array([lists[i] for i in take], pa.list_(pa.binary())), pa.array([part << 40 | n + i for i in range(len(take))], pa.int64())]
                n += len(take)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema)), *extra], ["row", "asked", "place"])
            else:
                yield rewrite(rows, lambda first: [], None)

    plain = docs.mapInArrow(lambda batches: asking(batches, False), schema)
    held = Stored(docs.mapInArrow(lambda batches: asking(batches, True), T.StructType([T.StructField("row", docs.schema), T.StructField("asked", T.ArrayType(T.BinaryType())), T.StructField("place", T.LongType())])), "line-texts")
    hits = held.df.select("place", F.explode("asked").alias("digest")).join(confirmed.df, "digest")
    hits = hits.groupBy("place").agg(F.collect_list(F.struct("digest", "first_doc", "first_line")).alias("repeats"))
    joined = held.df.select("row", "place").join(hits, "place", "left").select("row", "repeats")

    @frugal
    def by_join(batches):
        for batch in batches:
            lists = [{bytes(x["digest"]): (x["first_doc"], x["first_line"]) for x in r or ()} for r in batch.column("repeats").to_pylist()]
            rows = batch.column("row")
            own = pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in rows.type])
            yield rewrite(own, list, lambda row, d, lists=lists: lists[row].get(d))

    return plain.union(joined.mapInArrow(by_join, schema))


def _digest_hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d)[:8] for d in digests), np.uint64)
