"""Once-seen and twice-seen Bloom filters, built over all rows and merged segment by segment."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, mix64

SEGMENT_BITS = 1 << 19
HASHES = 4
#: A filter of 2^30 bits is 128 MB. Beyond its best load more keys are suspected than repeat; results stay exact.
MIN_LOG2, MAX_LOG2 = 19, 30


def log2_bits(keys: int) -> int:
    """16 bits a key, within the bounds."""
    return int(np.clip(np.ceil(np.log2(max(1, keys) * 16)), MIN_LOG2, MAX_LOG2))


def positions(hashes: np.ndarray, log2: int) -> np.ndarray:
    """HASHES bit positions for each 64-bit hash; shape (n, HASHES)."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)
    return ((hashes[:, None] + i * step[:, None]) ^ ((hashes[:, None] >> np.uint64(17)) * i)) & np.uint64((1 << log2) - 1)


class TwiceFilter:
    """Tells which keys may occur twice or more; never misses one that does."""

    def __init__(self, bits: bytes, log2: int):
        self.bits, self.log2 = np.frombuffer(bits, np.uint8), log2

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        p = positions(hashes, self.log2)
        return ((self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_once(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keys: int) -> TwiceFilter:
    """The once-seen filter, which suspects every key that occurs; otherwise like build_twice()."""
    return build_twice(df, hashes_of, keys, 1)


def build_twice(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keys: int, times: int = 2) -> TwiceFilter:
    """The twice-seen filter over every hash that `hashes_of` yields for `df`'s batches.

    Each task keeps one pair of filters and emits their segments; segments of all tasks stream through the merge, of
    which a task holds one pair at a time. A bit that two keys or two tasks set in the once filter is set in the twice
    filter. The result's size is fixed by log2_bits(), so it may be sent to all executors.
    """
    log2 = log2_bits(keys)
    n_segments = (1 << log2) // SEGMENT_BITS

    @frugal
    def local(batches):
        once, twice = np.zeros(1 << log2 >> 3, np.uint8), np.zeros(1 << log2 >> 3, np.uint8)
        for batch in batches:
            for hashes in hashes_of(batch):
                p, n = np.unique(positions(hashes, log2).ravel(), return_counts=True)
                at, bit = p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)
                again = (n > 1) | ((once[at] & bit) != 0)
                np.bitwise_or.at(twice, at[again], bit[again])
                np.bitwise_or.at(once, at, bit)
        size = SEGMENT_BITS // 8
        for s in range(n_segments):
            part = once[s * size : (s + 1) * size]
            if part.any():
                packed = [zlib.compress(x.tobytes(), 1) for x in (part, twice[s * size : (s + 1) * size])]
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": pa.array(packed[:1], pa.binary()), "twice": pa.array(packed[1:], pa.binary())})

    def merged(batches):
        now, once, twice = None, None, None
        out = lambda: pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "twice": pa.array([zlib.compress((twice if times == 2 else once).tobytes(), 1)], pa.binary())})
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield out()
                    now, once, twice = s, np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                twice |= b | (once & a)
                once |= a
        if now is not None:
            yield out()

    parts = df.mapInArrow(local, "segment int, once binary, twice binary")
    whole = parts.repartition(min(n_segments, 200), "segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, twice binary")
    bits = bytearray(1 << log2 >> 3)
    # One job brings a filter of up to 32 MB; a larger one comes a partition at a time.
    for row in whole.collect() if log2 <= 28 else whole.toLocalIterator():
        bits[row.segment * SEGMENT_BITS // 8 : (row.segment + 1) * SEGMENT_BITS // 8] = zlib.decompress(row.twice)
    return TwiceFilter(bytes(bits), log2)


#: Bits of a hash that tell keys apart where a filter of repeats is built, and keys that a task holds before it sends them on.
PRINT_BITS, KEYS_HELD = 40, 1 << 22


class RepeatFilter:
    """Tells which keys may occur twice or more; never misses one that does. Each segment has the keys of one range of hashes."""

    def __init__(self, bits: bytes, log2: int):
        self.bits, self.log2 = np.frombuffer(bits, np.uint8), log2

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        prints = hashes >> np.uint64(64 - PRINT_BITS)
        segments = (prints >> np.uint64(PRINT_BITS - _segment_bits(self.log2))) * np.uint64(SEGMENT_BITS)
        p = positions(mix64(prints), int(SEGMENT_BITS).bit_length() - 1) + segments[:, None]
        return ((self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _segment_bits(log2: int) -> int:
    return log2 - (SEGMENT_BITS.bit_length() - 1)


def _packed(prints: np.ndarray) -> bytes:
    """Ascending numbers as compressed planes of bytes of their differences."""
    steps = np.diff(prints, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def build_repeats(df: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], keys: int) -> RepeatFilter:
    """A filter of the keys that occur twice in `df`: the task of a range of hashes gets their first PRINT_BITS bits alone.

    These are sent as differences, some three bytes a distinct key of a task; of the keys of its range a task finds those that
    are there twice and sets their bits in the range's segment. The result's size is fixed by log2_bits().
    """
    log2 = log2_bits(keys)
    above = PRINT_BITS - _segment_bits(log2)

    def rows(held: list):
        prints, n = np.unique(np.concatenate(held) >> np.uint64(64 - PRINT_BITS), return_counts=True)
        if not len(prints):
            return
        segment = (prints >> np.uint64(above)).astype(np.int64)
        cut = np.flatnonzero(np.diff(segment, prepend=-1))
        out = [(int(segment[a]), _packed(prints[a:b]), _packed(prints[a:b][n[a:b] > 1])) for a, b in zip(cut, [*cut[1:], len(prints)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "prints", "again"])

    @frugal
    def local(batches):
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                held.append(hashes)
                size += len(hashes)
            if size >= KEYS_HELD:
                yield from rows(held)
                held, size = [np.zeros(0, np.uint64)], 0
        yield from rows(held)

    def merged(batches):
        now, held = None, []

        def out():
            prints, n = np.unique(np.concatenate(held), return_counts=True)
            p = positions(mix64(prints[n > 1]), SEGMENT_BITS.bit_length() - 1).ravel()
            bits = np.zeros(SEGMENT_BITS // 8, np.uint8)
            np.bitwise_or.at(bits, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield out()
                    now, held = s, []
                held += [_unpacked(a), _unpacked(b)]
        if now is not None:
            yield out()

    parts = df.mapInArrow(local, "segment int, prints binary, again binary")
    whole = parts.repartition(min(1 << _segment_bits(log2), 200), "segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, bits binary")
    bits = bytearray(1 << log2 >> 3)
    for row in whole.collect() if log2 <= 28 else whole.toLocalIterator():
        bits[row.segment * SEGMENT_BITS // 8 : (row.segment + 1) * SEGMENT_BITS // 8] = zlib.decompress(row.bits)
    return RepeatFilter(bytes(bits), log2)
