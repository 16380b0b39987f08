"""Source divergence audit: by how much a source's words stray from its language's, and from each other source's.

A count-min sketch of document frequencies is built by each task over its own documents and merged cell by cell, so that its
figures are never too low. Terms that the sketch shows to be in too few documents are dropped where the texts are; what is
left is counted exactly, and those that still are too rare go. Divergences are sums over all kept terms, but most terms occur
in few sources: with the values of terms that do not occur taken out in closed form, only terms that two sources share are
joined, and each source's own terms enter by the histogram of their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bloom import positions
from .common import Stored, cut_out, distinct, frugal, in_parts, mix64, named, slices, spaced, strings

#: Fixed values of the contract: what a term is made of, and the scale of the shares.
_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
SCALE = 1_000_000_000
#: Cells of the sketch: so many a document, within bounds, each of a byte while it is built and of a bit when it is sent (8 MB).
#: Beyond the upper bound fewer terms are dropped early; results are the same.
CELLS_A_DOC, MIN_LOG2, MAX_LOG2 = 64, 20, 26
SEGMENT = 1 << 18
#: Sums that a task holds before it sends them on.
ROWS_HELD = 400_000


def terms_of(at: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """(bytes, hash, begin and size of each term, its text) for some texts at a time, each of them whole."""
    for a, b in slices(at):
        parts, _ = in_parts(at[a : b + 1], data, ~_TERM)
        found, room = [], 0
        for c, d in slices(parts):
            raw, ends = spaced(parts[c : d + 1], data)
            h, begin, size = named(raw, ~_TERM[raw])
            text = np.zeros(len(h), np.int64) if b - a == 1 else np.searchsorted(ends, begin)
            found.append((raw, h, begin + room, size, text + a))
            room += len(raw)
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]


def _groups(batch: pa.RecordBatch, seen: dict) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's (lang, source), scrambled number of its language)."""
    rows = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
    return np.array([seen.setdefault(x, len(seen)) for x in rows], np.int64), np.array([_lang_hash(lang) for lang, _ in rows], np.uint64)


def _lang_hash(lang: str) -> int:
    h = 0xCBF29CE484222325
    for b in lang.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def _keys(h: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix64(h ^ lang)


def log2_cells(docs: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, docs) * CELLS_A_DOC)), MIN_LOG2, MAX_LOG2))


def frequent_cells(docs: DataFrame, min_docs: int, log2: int) -> np.ndarray:
    """One bit for each cell of the merged sketch: whether its document frequency reaches `min_docs`.

    Cells stop at `min_docs`, at most 255, which is all that is asked of them.
    """
    most = min(min_docs, 255)

    @frugal
    def local(batches):
        cells = np.zeros(1 << log2, np.uint8)
        for batch in batches:
            _, lang = _groups(batch, {})
            for _, h, _, _, text in terms_of(*strings(batch.column("text"))):
                order, first = distinct(h, text)  # a document counts once
                at = order[first]
                p, n = np.unique(positions(_keys(h[at], lang[text[at]]), log2).ravel(), return_counts=True)
                cells[p] = np.minimum(cells[p] + np.minimum(n, most), most)
        pack = zstandard.ZstdCompressor(level=1)
        for s in range(0, 1 << log2, SEGMENT):
            part = cells[s : s + SEGMENT]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s // SEGMENT], pa.int32()), pa.array([pack.compress(part.tobytes())], pa.binary())], ["segment", "cells"])

    def merged(batches):
        now, sums, unpack = None, None, zstandard.ZstdDecompressor()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= most).tobytes()], pa.binary())], ["segment", "bits"])
        for batch in batches:
            for s, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield out()
                    now, sums = s, np.zeros(SEGMENT, np.uint16)
                sums = np.minimum(sums + np.frombuffer(unpack.decompress(x), np.uint8), most)
        if now is not None:
            yield out()

    parts = docs.mapInArrow(local, "segment int, cells binary")
    whole = parts.repartition((1 << log2) // SEGMENT, "segment").sortWithinPartitions("segment").mapInArrow(merged, "segment int, bits binary")
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for row in whole.collect():  # at most 8 MB
        bits[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _possible(bits: np.ndarray, keys: np.ndarray, log2: int) -> np.ndarray:
    p = positions(keys, log2)
    return (bits[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def term_counts(docs: DataFrame, min_docs: int) -> Stored:
    """(lang, source, term, n, n_lang, lead) of the kept terms, in the sources that have them.

    n and n_lang are the occurrences in the source and in the language; one source of each term leads.
    """
    log2 = log2_cells(docs.count())
    sent = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, min_docs, log2).tobytes())

    def summed(held):
        group, h, n, df = (np.concatenate([x[i] for x in held]) for i in range(4))
        order, first = distinct(h, group)
        at = order[first]
        terms = pa.chunked_array([x[4] for x in held], pa.string()).take(pa.array(at)).combine_chunks()
        return group[at], h[at], np.add.reduceat(n[order], first) if len(at) else n, np.add.reduceat(df[order], first) if len(at) else df, terms

    def sums(seen: dict, held: list):
        group, _, n, df, terms = summed(held)
        langs, sources = zip(*seen, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(group)), pa.array(sources, pa.string()).take(pa.array(group)), terms, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

    @frugal
    def count(batches):
        bits, seen, held, rows = np.frombuffer(sent.value, np.uint8), {}, [], 0
        for batch in batches:
            own, lang = _groups(batch, seen)
            for raw, h, begin, size, text in terms_of(*strings(batch.column("text"))):
                order, first = distinct(h, text)
                at, n = order[first], np.diff(first, append=len(order))
                yes = _possible(bits, _keys(h[at], lang[text[at]]), log2)
                at, n = at[yes], n[yes]
                order, first = distinct(h[at], own[text[at]])
                if not len(order):
                    continue
                lead = at[order[first]]
                held.append((own[text[lead]], h[lead], np.add.reduceat(n[order], first), np.diff(first, append=len(order)), cut_out(raw, begin[lead], size[lead])))
                rows += len(lead)
            if rows >= 2 * ROWS_HELD:
                held = [summed(held)]
                rows = len(held[0][0])
                if rows >= ROWS_HELD:
                    yield sums(seen, held)
                    held, rows = [], 0
        if held:
            yield sums(seen, held)

    parts = docs.mapInArrow(count, "lang string, source string, term string, n long, df long")
    exact = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = Window.partitionBy("lang", "term")
    marked = exact.withColumns({"n_lang": F.sum("n").over(whole), "docs": F.sum("df").over(whole), "lead": F.row_number().over(whole.orderBy("source")) == 1})
    return Stored(marked.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "n_lang", "lead"), "terms")


def _share(n: Column | str, total: str) -> Column:
    """1 + floor(SCALE * (n + 1) / total), where the product may pass 64 bits."""
    n = F.col(n) if isinstance(n, str) else n
    return 1 + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE), F.col(total))


def _far(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); the square of a difference of shares has 18 digits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that `docs` (lang, source, text) has.

    Terms are runs of letters of any but ASCII's other characters, A-Z lower-cased; a language keeps those in at least
    `min_docs` of its documents. With V of them, a group that has a kept term n times and N kept terms in all gives it
    p = 1 + floor(SCALE (n + 1) / (N + V)), and floor((p - q)^2 / q) is how far p is from q. Part `pair`: for each other source
    of the language, the sum over all kept terms. Part `term`: the `top` terms that the group has and that it gives more
    than its language does. Ranks go by value, then by the item's bytes. Null text, lang and source count as empty, each row as
    a document; a language without kept terms has pairs of value 0, a source without another of its language no pair. An empty
    table gives no row; other columns are not read.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = term_counts(docs, min_docs).df
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_all"), F.count_if("lead").alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_own"), F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["n_own", "terms", "n_all", "v"]).withColumns({"total": F.col("n_own") + F.col("v"), "total_all": F.col("n_all") + F.col("v")})
    groups = Stored(groups.withColumn("none", F.when(F.col("v") > 0, _share(F.lit(0), "total"))), "groups").df
    shares = Stored(kept.join(groups.select("lang", "source", "none", "total", "total_all"), ["lang", "source"]).select("lang", "source", "term", "none", _share("n", "total").alias("p"), _share("n_lang", "total_all").alias("q")), "shares").df

    by_value = lambda: Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    high = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))
    high = high.withColumn("rank", F.row_number().over(by_value())).where(F.col("rank") <= top)

    one, other = shares.select("lang", "source", "term", "none", "p"), shares.select("lang", F.col("source").alias("source2"), "term", F.col("none").alias("none2"), F.col("p").alias("p2"))
    shared = one.join(other, ["lang", "term"]).where("source < source2")  # the terms that two sources share, each pair once
    more = lambda p, q, np, nq: _far(p, q) - _far(p, nq) - _far(np, q) + _far(np, nq)
    both = shared.groupBy("lang", "source", "source2").agg(F.sum(more("p", "p2", "none", "none2")).alias("there"), F.sum(more("p2", "p", "none2", "none")).alias("back"))
    either = lambda df, there, back: df.select("lang", F.explode(F.array(F.struct("source", F.col("source2").alias("item"), F.col(there).alias("value")), F.struct(F.col("source2").alias("source"), F.col("source").alias("item"), F.col(back).alias("value")))).alias("x")).select("lang", "x.*")

    counts = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    rest = groups.select("lang", *(F.col(c).alias(c + "2") for c in ("source", "none", "terms")))
    alone = counts.join(rest, "lang").where("source <> source2").groupBy("lang", "source", "source2")
    alone = alone.agg(F.sum(_far("p", "none2") * F.col("times")).alias("ahead"), F.sum(_far("none2", "p") * F.col("times")).alias("against"))
    empty = groups.select("lang", "source", "none", "terms", "v").join(rest, "lang").where("source <> source2")
    empty = empty.select("lang", "source", F.col("source2").alias("item"), F.when(F.col("v") > 0, _far("none", "none2") * (F.col("v") - F.col("terms") - F.col("terms2"))).otherwise(0).alias("value"))
    pairs = either(both, "there", "back").unionByName(either(alone, "ahead", "against")).unionByName(empty).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value()))
    return pairs.unionByName(high)
