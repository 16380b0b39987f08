"""What the operators of this subpackage share: tables, the shared folder, text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel handles at once. NumPy kernels need up to about 60 bytes of scratch for each; a longer text is
#: handled in parts of about this size, so that beyond it a text needs its own size and that of its words alone.
SLICE_BYTES = 1 << 19
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a folder of our own only in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="phonoweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


class Stored:
    """A table written to the shared folder. It cuts lineage, survives lost executors and can be dropped."""

    def __init__(self, df: DataFrame, label: str, codec: str = "zstd"):
        self.spark = df.sparkSession
        bounded(self.spark)
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.option("compression", codec).parquet(self.path)
        fs, path = self._files()
        fs.deleteOnExit(path)  # what is not dropped before goes when the application ends

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        fs, path = self._files()
        fs.delete(path, True)

    def _files(self) -> tuple:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def bounded(spark: SparkSession) -> SparkContext:
    """Lets a batch that goes to Python hold BATCH_BYTES at most (or one row), so that long texts do not add up; the context."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.sparkContext


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives back the memory that it no longer needs: idle workers live on beside others."""

    @functools.wraps(run)
    def wrapped(batches, *more):
        try:
            yield from run(batches, *more)
        finally:
            _trim()

    return wrapped


def _trim() -> None:
    """Gives back the memory that this Python no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are no longer referenced, and trims the driver's Python."""
    _trim()
    spark.sparkContext._jvm.System.gc()


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying its text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts_of(batch: pa.RecordBatch, first: int, last: int) -> list[str]:
    """The texts of some rows of a batch; null counts as empty."""
    return ["" if t is None else t for t in batch.column("text").slice(first, last - first).to_pylist()]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer text gets a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last
        first = last


#: Finalising constants of a well-known 64-bit mixer (splitmix64).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


SPACES = b" \t\n\x0b\x0c\r"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of each word of one part of a text."""
    return named(raw, _IS_SPACE[raw])[:2]


def named(raw: np.ndarray, space: np.ndarray, base: int = _BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, bytes) of each run of places that are not `space`; another odd `base` names the words anew."""
    before = np.ones(len(raw), bool)
    before[1:] = space[:-1]
    begin = np.flatnonzero(~space & before)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, begin
    own, empty = raw[begin[0] :], space[begin[0] :]
    at = begin - begin[0]
    room = np.diff(at, append=len(own))
    value = np.where(empty, 0, own.astype(np.uint64) + np.uint64(1))
    value *= _powers(int(room.max()), base)[np.arange(len(own)) - np.repeat(at, room)]
    size = np.add.reduceat(~empty, at, dtype=np.uint64)
    return mix64(np.add.reduceat(value, at) + size * MIX_1), begin, size.astype(np.int64)


def in_parts(at: np.ndarray, data: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, text) of parts of the texts data[at[i]:at[i + 1]]: a text over `limit` bytes is cut after bytes b with ends[b].

    What may be counted in parts is cut where nothing spans the cut; without such a byte a part goes on to the text's end.
    """
    offsets, owner = [at[:1]], []
    if not (np.diff(at) > limit).any():
        return at, np.arange(len(at) - 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        while b - a > limit:
            stop = a + limit
            while stop < b and not ends[data[stop - 1]]:
                near = np.flatnonzero(ends[data[stop : min(b, stop + limit)]])
                stop = stop + int(near[0]) + 1 if len(near) else min(b, stop + limit)
            if stop >= b:
                break
            offsets.append(np.array([stop]))
            owner.append(i)
            a = stop
        offsets.append(np.array([b]))
        owner.append(i)
    return np.concatenate(offsets), np.array(owner, np.int64)


def spaced(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the texts with A-Z lower-cased and a line feed after each, place of each text's line feed)."""
    own = at - at[0]
    n = len(at) - 1
    raw = np.full(int(own[-1]) + n, 10, np.uint8)
    raw[np.arange(own[-1]) + np.repeat(np.arange(n), np.diff(own))] = _LOWER[data[at[0] : at[-1]]]
    return raw, own[1:] + np.arange(n)


def cut_out(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings raw[begin:begin + size]."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    place = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[place]))


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in it): rows in order of the keys, the last of which counts first."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def word_hashes(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text data[at[i]:at[i + 1]]).

    A-Z is lower-cased, words are runs of anything but the six ASCII spaces. Texts are handled together up to SLICE_BYTES; a
    longer one in parts that end where a word does.
    """
    hashes, counts = [], []
    for a, b in slices(at):
        if b - a == 1:
            n, place, end = 0, int(at[a]), int(at[b])
            while place < end:
                stop = min(end, place + SLICE_BYTES)
                while stop < end and not _IS_SPACE[data[stop - 1]]:  # to the end of the word
                    near = np.flatnonzero(_IS_SPACE[data[stop : stop + SLICE_BYTES]])
                    stop = stop + int(near[0]) + 1 if len(near) else min(end, stop + SLICE_BYTES)
                h, _ = _hashes(_LOWER[data[place:stop]])
                hashes.append(h)
                n += len(h)
                place = stop
            counts.append(np.array([n]))
            continue
        own = at[a : b + 1] - at[a]
        raw = np.full(own[-1] + b - a, 32, np.uint8)  # a space after each text
        raw[np.arange(own[-1]) + np.repeat(np.arange(b - a), np.diff(own))] = _LOWER[data[at[a] : at[b]]]
        h, begin = _hashes(raw)
        hashes.append(h)
        counts.append(np.diff(np.searchsorted(begin, own + np.arange(b - a + 1))))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty.astype(np.uint64), *hashes]), np.concatenate([empty, *counts])


def ascii_lower(column):
    """A-Z lower-cased, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
