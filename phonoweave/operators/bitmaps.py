"""Bitmaps of words by what stands at a place, in blocks: contingencies of any filter by AND and counts, words unread.

A block has up to BLOCK_WORDS words, each a bit. For each place of a word (1 is its first element, -1 its last) and each
predictor there (`±f`, a symbol) the block has one bitmap, and one each for all words and those in error, at place 0. A new
filter or another set of errors is a few bitmaps more; what is read does not depend on the length of the words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoweave.functions.features import MARK_OF, MORPH, WORD, SymbolTable
from phonoweave.sources.shared import stored

BLOCK_WORDS = 1 << 16
ALL, MISS = "all", "miss"
INDEX = "block long, place int, predictor string, bits array<long>"


@dataclass(frozen=True)
class Holds:
    """A predictor at a place, or with `absent` its absence there."""

    place: int
    predictor: str
    absent: bool = False


def _block(forms: list[str], miss: np.ndarray, table: SymbolTable, reach: int) -> list[tuple[int, str, np.ndarray]]:
    """(place, predictor, bitmap) of the words of a block."""
    words = [[s for s in f.split() if s not in (WORD, MORPH)] for f in forms]
    number: dict[str, int] = {}
    values = {s: np.array([v == "2" for v in vec] + [v == "0" for v in vec]) for s, vec in table.vectors.items()}
    pack = lambda x: np.packbits(np.pad(x, (0, -len(x) % 64)), bitorder="little").view(np.int64)
    out = [(0, ALL, pack(np.ones(len(words), bool))), (0, MISS, pack(miss))]
    for place in [*range(1, reach + 1), *range(-reach, 0)]:
        at = place - 1 if place > 0 else place
        codes = np.array([number.setdefault(w[at], len(number)) if len(w) >= abs(place) else -1 for w in words])
        symbols = [*number]
        for code in np.unique(codes[codes >= 0]):
            out.append((place, symbols[code], pack(codes == code)))
        known = np.array([values[s] for s in symbols] + [np.zeros(2 * len(table.features), bool)])  # the last for no symbol
        there = known[codes]
        for i, f in enumerate(table.features):
            for shift, mark in ((0, MARK_OF["2"]), (len(table.features), MARK_OF["0"])):
                if there[:, i + shift].any():
                    out.append((place, mark + f, pack(there[:, i + shift])))
    return out


def build_index(words: DataFrame, table: SymbolTable, reach: int = 3) -> DataFrame:
    """The stored index of `words` (form, miss); rows without a form or a verdict stay out. Nothing is shuffled."""

    def run(batches):
        part, forms, miss, made = TaskContext.get().partitionId(), [], [], 0

        def out() -> pa.RecordBatch:
            rows = _block(forms[:BLOCK_WORDS], np.array(miss[:BLOCK_WORDS]), table, reach)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["block", "place", "predictor", "bits"])

        for batch in batches:
            forms += batch.column("form").to_pylist()
            miss += batch.column("miss").to_pylist()
            while len(forms) >= BLOCK_WORDS:
                yield out()
                forms, miss, made = forms[BLOCK_WORDS:], miss[BLOCK_WORDS:], made + 1
        if forms:
            yield out()

    return stored(words.where("form is not null and miss is not null").select("form", "miss").mapInArrow(run, INDEX), "predictors")


def _and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def _count(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x))


def chosen(index: DataFrame, filters: Sequence[Holds]) -> DataFrame:
    """(block, bits, missed): the words of each block of which all the filters hold, and those of them in error."""
    wanted = [(0, ALL), (0, MISS), *((h.place, h.predictor) for h in filters)]
    here = lambda place, predictor: (F.col("place") == place) & (F.col("predictor") == predictor)
    some = index.where(F.greatest(F.lit(False), *(here(*w) for w in wanted)))
    got = some.groupBy("block").agg(*(F.max(F.when(here(*w), F.col("bits"))).alias(f"b{i}") for i, w in enumerate(wanted)))
    bits = F.col("b0")
    for i, h in enumerate(filters, 2):
        none = F.transform("b0", lambda _: F.lit(0).cast("long"))
        own = F.coalesce(F.col(f"b{i}"), none)
        bits = _and(bits, F.transform(own, lambda x: F.bitwise_not(x)) if h.absent else own)
    return got.select("block", bits.alias("in"), _and(bits, F.col("b1")).alias("in_missed"))


def contingency(index: DataFrame, filters: Sequence[Holds] = ()) -> DataFrame:
    """(place, predictor, n11, n10, n01, n00) among the words of which all the filters hold.

    The first figure says whether the predictor holds there, the second whether the word is in error.
    """
    own = stored(chosen(index, filters), "chosen")  # a row a block
    totals = own.agg(F.sum(_count("in")).alias("n"), F.sum(_count("in_missed")).alias("misses"))
    met = index.where("place <> 0").join(own, "block").groupBy("place", "predictor").agg(F.sum(_count(_and(F.col("bits"), F.col("in")))).alias("have"), F.sum(_count(_and(F.col("bits"), F.col("in_missed")))).alias("n11"))
    each = met.where("have > 0").join(F.broadcast(totals), F.lit(True))  # one row
    return each.select("place", "predictor", "n11", F.expr("have - n11").alias("n10"), F.expr("misses - n11").alias("n01"), F.expr("n - misses - (have - n11)").alias("n00"))


def subset(index: DataFrame, filters: Sequence[Holds]) -> DataFrame:
    """(n, n_in, n_miss, n_in_miss, share, error_share) of the words of which the filters hold among all."""
    sums = lambda fs, a, b: chosen(index, fs).agg(F.sum(_count("in")).alias(a), F.sum(_count("in_missed")).alias(b), F.lit(1).alias("_"))
    both = sums((), "n", "n_miss").join(sums(filters, "n_in", "n_in_miss"), "_")
    return both.select("n", "n_in", "n_miss", "n_in_miss", (F.col("n_in") / F.nullif("n", F.lit(0))).alias("share"), (F.col("n_in_miss") / F.nullif("n_miss", F.lit(0))).alias("error_share"))
