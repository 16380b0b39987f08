"""Phrase collocations by pivot partitioning: each n-gram is mined where its rarest word sends it, and nowhere else.

Words are numbered from the most frequent down, rare ones are blanks. Around each occurrence of a word the text is rewritten
to what that word, as a pivot, can own: the words before it that are more frequent, and those after it that are not rarer, as
far as the longest phrase reaches and no blank or end of a piece is between. An n-gram occurrence belongs to the first
occurrence of its rarest word, so exactly one fragment holds it. Equal fragments are added up before they are routed to their
pivot's part, where n-grams are counted and only frequent ones come out. A pivot of very many occurrences is dealt over
several parts; its n-grams, and only these, are added up once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MIX_1, MIX_2, Stored, cut_out, distinct, frugal, in_parts, mix64, named, slices, spaced, strings

#: Fixed values of the contract: what ends a piece, and what parts words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_APART = _ENDS | np.isin(np.arange(256), list(BLANKS))
UNKNOWN = "und"
FIRST_BASE = 0x9E3779B97F4A7C15
#: Frequent words up to this many are sent to all executors (20 bytes each); beyond, texts are joined with them.
WORDS_SENT = 2_000_000
#: Rows that a task adds up before it sends them on, word occurrences to a part, and occurrences above which a pivot is dealt.
ROWS_HELD, PART_ROWS, PIVOT_ROWS = 800_000, 2_000_000, 1_000_000


class _Sums:
    """Adds up counts of equal keys, some of (language, hash), until there are ROWS_HELD of them."""

    def __init__(self):
        self.langs, self.held, self.rows = [], [], 0

    def add(self, lang: np.ndarray, h: np.ndarray, n: np.ndarray, words: pa.Array) -> pa.RecordBatch | None:
        self.held.append((lang, h, n, words))
        self.rows += len(h)
        if self.rows < 2 * ROWS_HELD:
            return None
        lang, h, n, words = self._sum()
        self.held, self.rows = [(lang, h, n, words)], len(h)
        return self.out() if len(h) >= ROWS_HELD else None

    def _sum(self):
        lang, h, n = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        order, first = distinct(h, lang)
        words = pa.chunked_array([x[3] for x in self.held]).take(pa.array(order[first])).combine_chunks()
        return lang[order[first]], h[order[first]], np.add.reduceat(n[order], first) if len(first) else n, words

    def out(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        lang, h, n, words = self._sum()
        self.held, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(self.langs, pa.string()).take(pa.array(lang)), pa.array(h.view(np.int64)), words, pa.array(n)], ["lang", "hash", "word", "n"])


def _codes(batch: pa.RecordBatch, langs: dict) -> np.ndarray:
    return np.array([langs.setdefault(x, len(langs)) for x in batch.column("lang").to_pylist()], np.int64)


def _words(at: np.ndarray, data: np.ndarray, base: int):
    """By parts of the texts: (bytes, hash, begin and size of each word, text of each word, whether the next is in the same piece)."""
    at, owner = in_parts(at, data, _ENDS)
    for a, b in slices(at):
        raw, ends = spaced(at[a : b + 1], data)
        h, begin, size = named(raw, _APART[raw], base)
        piece = np.cumsum(_ENDS[raw])[begin] if len(begin) else begin
        linked = np.zeros(len(h), bool)
        linked[:-1] = piece[1:] == piece[:-1]
        yield raw, h, begin, size, owner[a + np.searchsorted(ends, begin)], linked


def word_counts(docs: DataFrame, base: int) -> DataFrame:
    """(lang, hash, word, n) of every word of `docs` (lang, text)."""

    @frugal
    def run(batches):
        langs: dict = {}
        sums = _Sums()
        for batch in batches:
            code = _codes(batch, langs)
            sums.langs = list(langs)
            for raw, h, begin, size, text, _ in _words(*strings(batch.column("text")), base):
                lang = code[text]
                order, first = distinct(h, lang)
                at = order[first]
                if len(at) and (out := sums.add(lang[at], h[at], np.diff(first, append=len(order)), cut_out(raw, begin[at], size[at]))):
                    yield out
        if out := sums.out():
            yield out

    return docs.mapInArrow(run, "lang string, hash long, word string, n long").groupBy("lang", "hash", "word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, min_count: int) -> tuple[Stored, DataFrame, int]:
    """((lang, hash, word, f, id) of the frequent words, (lang, n) of all, the base of the hashes).

    Ids count from the most frequent word of any language. Should two words of a language share a hash, all are named anew.
    """
    for base in range(FIRST_BASE, 1 << 64, 2 << 32):
        counted = Stored(word_counts(docs, base), "words")
        if counted.df.groupBy("lang", "hash").agg(F.count("*").alias("same")).where("same > 1").isEmpty():
            break
        counted.drop()
    totals = Stored(counted.df.groupBy("lang").agg(F.sum("n").alias("n")), "totals").df
    frequent = counted.df.where(F.col("n") >= min_count).select("lang", "hash", "word", F.col("n").alias("f")).orderBy(F.desc("f"), "lang", "hash")
    numbered = frequent.rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    out = Stored(docs.sparkSession.createDataFrame(numbered, "lang string, hash long, word string, f long, id int"), "frequent")
    counted.drop()
    return out, totals, base


def _fragments(ids: np.ndarray, linked: np.ndarray, f: np.ndarray, reach: int, pivot_rows: int):
    """(left, right, dealt or not, matrix of ids with -1 beyond, f of the pivot) of what each occurrence owns; blanks are ids of -1."""
    n = len(ids)
    open_ = linked & (ids >= 0)
    open_[:-1] &= ids[1:] >= 0
    open_[-1:] = False
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    more = ids >= 0
    for d in range(1, min(reach, n - 1) + 1):
        now = np.zeros(n, bool)
        now[d:] = more[d:] & open_[: n - d] & (ids[: n - d] < ids[d:])
        left += now
        more = now
    more = ids >= 0
    for d in range(1, min(reach, n - 1) + 1):
        now = np.zeros(n, bool)
        now[: n - d] = more[: n - d] & open_[d - 1 : n - 1] & (ids[d:] <= ids[: n - d])
        right += now
        more = now
    at = np.flatnonzero(left + right > 0)
    left, right = left[at], right[at]
    matrix = np.full((len(at), 2 * reach + 1), -1, np.int32)
    for d in range(-reach, reach + 1):
        own = np.flatnonzero(left >= -d if d < 0 else right >= d)
        matrix[own, d + reach] = ids[at[own] + d]
    return left.astype(np.uint8), right.astype(np.uint8), f[at] > pivot_rows, matrix, f[at]


def _row_hash(matrix: np.ndarray) -> np.ndarray:
    h = np.zeros(len(matrix), np.uint64)
    for c in range(matrix.shape[1]):
        h = (h ^ (matrix[:, c].astype(np.int64).view(np.uint64) + np.uint64(c + 2))) * MIX_1
        h ^= h >> np.uint64(29)
    return mix64(h)


def _groups(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first) of equal rows, told by a hash; where two different rows share one, by the rows."""
    order, first = distinct(_row_hash(matrix))
    own = matrix[order]
    if len(order) and (own != own[np.repeat(first, np.diff(first, append=len(order)))]).any():
        order, first = distinct(*(matrix[:, c] for c in range(matrix.shape[1])))
    return order, first


def _planes(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _from_planes(x: bytes, kind) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


_ROUTED = "part int, sides binary, times binary, ids binary"


class _Router:
    """Adds up equal fragments and sends them to their parts."""

    def __init__(self, parts: int, reach: int, pivot_rows: int):
        self.parts, self.reach, self.pivot_rows, self.held, self.rows = parts, reach, pivot_rows, [], 0

    def add(self, ids: np.ndarray, linked: np.ndarray, f: np.ndarray):
        if len(ids):
            self.held.append(_fragments(ids, linked, f, self.reach, self.pivot_rows))
            self.rows += len(self.held[-1][0])
        if self.rows >= ROWS_HELD:
            yield from self.out()

    def out(self):
        if not self.rows:
            return
        left, right, hot, matrix, f = (np.concatenate([x[i] for x in self.held]) for i in range(5))
        self.held, self.rows = [], 0
        order, first = _groups(matrix)
        at, times = order[first], np.diff(first, append=len(order)).astype(np.int32)
        left, right, hot, matrix, f = left[at], right[at], hot[at], matrix[at], f[at]
        share = np.where(hot, _row_hash(matrix) % (f.astype(np.uint64) // np.uint64(self.pivot_rows) + np.uint64(1)), 0).astype(np.uint64)
        part = ((mix64(matrix[:, self.reach].astype(np.uint64) + MIX_2) + share) % np.uint64(self.parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        sides, matrix, times = (left + np.uint8(8) * right + np.uint8(64) * hot.astype(np.uint8))[order], matrix[order], times[order]
        part = part[order]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
            own = matrix[a:b]
            rows.append((int(part[a]), _planes(sides[a:b]), _planes(times[a:b]), _planes(own[own >= 0])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "sides", "times", "ids"])


def _mined(rows: list, reach: int, min_count: int):
    """The n-grams of a part's fragments: (key, f, hot). A key is the ids, four bytes each, the highest first."""
    sides = np.concatenate([_from_planes(s, np.uint8) for s, _, _ in rows])
    times = np.concatenate([_from_planes(t, np.int32) for _, t, _ in rows]).astype(np.int64)
    ids = np.concatenate([_from_planes(i, np.int32) for _, _, i in rows])
    left, right, hot = (sides & 7).astype(np.int64), (sides >> 3 & 7).astype(np.int64), sides >= 64
    ends = np.cumsum(left + right + 1)
    pivot = ends - right - 1
    for m in range(2, reach + 2):
        found = [(np.flatnonzero((left >= before) & (right >= m - 1 - before)), before) for before in range(m)]
        begin = np.concatenate([pivot[x] - before for x, before in found])
        own = np.concatenate([x for x, _ in found])
        if not len(own):
            continue
        matrix = np.stack([ids[begin + d] for d in range(m)], axis=1)
        order, first = _groups(matrix)
        f = np.add.reduceat(times[own][order], first)
        at = order[first]
        keep = hot[own[at]] | (f >= min_count)
        if keep.any():
            keys = matrix[at[keep]].astype(">i4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * m), int(keep.sum()), [None, pa.py_buffer(keys)]).cast(pa.binary()), pa.array(f[keep]), pa.array(hot[own[at[keep]]])], ["key", "f", "hot"]
            )


def frequent_phrases(docs: DataFrame, words: Stored, base: int, min_count: int, max_words: int, words_sent: int, pivot_rows: int) -> DataFrame:
    """(key, f) of all n-grams of 2 to `max_words` words with f >= min_count; a key is made of the words' ids."""
    sc, reach = docs.sparkSession.sparkContext, max_words - 1
    row = words.df.agg(F.count("*").alias("n"), F.sum("f").alias("f")).first()
    parts = max(2 * sc.defaultParallelism, -(-(row.f or 0) // PART_ROWS))
    if row.n <= words_sent:
        found = words.df.select("lang", "hash", "id", "f").toArrow()
        langs, own = found["lang"].combine_chunks().dictionary_encode(), [found[c].to_numpy() for c in ("hash", "id", "f")]
        code, known = langs.indices.to_numpy(zero_copy_only=False), {}
        for c, name in enumerate(langs.dictionary.to_pylist()):
            at = np.flatnonzero(code == c)
            at = at[np.argsort(own[0].view(np.uint64)[at])]
            known[name] = own[0].view(np.uint64)[at], own[1][at], own[2][at]
        sent = sc.broadcast(known)

        @frugal
        def route(batches):
            router, own = _Router(parts, reach, pivot_rows), sent.value
            for batch in batches:
                langs: dict = {}
                code = _codes(batch, langs)
                for _, h, _, _, text, linked in _words(*strings(batch.column("text")), base):
                    ids, f = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
                    lang = code[text]
                    for name, c in langs.items():
                        at = np.flatnonzero(lang == c)
                        if name in own and len(at):
                            hashes, number, count = own[name]
                            place = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
                            hit = hashes[place] == h[at]
                            ids[at[hit]], f[at[hit]] = number[place[hit]], count[place[hit]]
                    yield from router.add(ids, linked, f)
            yield from router.out()

        routed = docs.mapInArrow(route, _ROUTED)
    else:
        routed = _routed_by_join(docs, words.df, base, lambda: _Router(parts, reach, pivot_rows))

    @frugal
    def mine(batches):
        now, rows = None, []
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and rows:
                    yield from _mined(rows, reach, min_count)
                    rows = []
                now = part
                rows.append(row)
        if rows:
            yield from _mined(rows, reach, min_count)

    mined = Stored(routed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(mine, "key binary, f long, hot boolean"), "phrases")
    hot = mined.df.where("hot").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    return mined.df.where("not hot").select("key", "f").union(hot)


def _routed_by_join(docs: DataFrame, words: DataFrame, base: int, made) -> DataFrame:
    """The fragments where frequent words are too many to be sent: the distinct words of each stretch of text are joined with them."""

    def read(batches):
        for batch in batches:
            langs: dict = {}
            code = _codes(batch, langs)
            names = list(langs)
            for _, h, _, _, text, linked in _words(*strings(batch.column("text")), base):
                for first in [0, *(np.flatnonzero(np.diff(text)) + 1)] if len(h) else ():
                    last = first + int(np.searchsorted(text[first:], text[first], side="right"))
                    yield pa.RecordBatch.from_arrays([pa.array([names[code[text[first]]]], pa.string()), pa.array([h[first:last].view(np.int64)]), pa.array([linked[first:last]])], ["lang", "hashes", "linked"])

    table = Stored(docs.mapInArrow(read, "lang string, hashes array<long>, linked array<boolean>").withColumn("stretch", F.monotonically_increasing_id()), "stretches")
    asked = table.df.select("stretch", "lang", F.explode(F.array_distinct("hashes")).alias("hash"))
    found = asked.join(words.select("lang", "hash", "id", "f"), ["lang", "hash"]).groupBy("stretch").agg(F.collect_list(F.struct("hash", "id", "f")).alias("known"))

    def route(batches):
        router = made()
        for batch in batches:
            for hashes, linked, known in zip(*(batch.column(c).to_pylist() for c in ("hashes", "linked", "known")), strict=True):
                own = {x["hash"]: (x["id"], x["f"]) for x in known}
                pairs = np.array([own.get(h, (-1, 0)) for h in hashes], np.int64)
                yield from router.add(pairs[:, 0], np.array(linked), pairs[:, 1])
        yield from router.out()

    return table.df.join(found, "stretch").mapInArrow(route, _ROUTED)


def collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, words_sent: int = WORDS_SENT, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """The `top` phrases of each language: (lang, rank, phrase, a, l, r, n, score, n_words, cut).

    `docs` has lang and text. A-Z is lower-cased; PIECE_ENDS end a piece, BLANKS part words. a is how often the phrase of 2 to
    `max_words` words occurs, overlaps included, at least `min_count` times; n how many words the language has. A cut after
    `cut` words gives l and r, how often the parts occur, and floor(1000 a n / (l r)); the lowest cut is the score, of equal
    ones the earliest. Phrases within a longer one of equal count are left out. Equal scores are ranked by a, then by the
    phrase's bytes. Null text counts as empty, null lang as UNKNOWN; repeated rows count each; a language without a frequent
    phrase has no row, and an empty table gives none. Other columns are not read.
    """
    if not 2 <= max_words <= 7:
        raise ValueError("phrases have 2 to 7 words")
    docs = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    words, totals, base = frequent_words(docs, min_count)
    phrases = Stored(frequent_phrases(docs, words, base, min_count, max_words, words_sent, pivot_rows), "counted").df
    single = words.df.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f", "lang", "word")
    known = single.select("key", "f", "lang").unionByName(phrases.select("key", "f", F.lit(None).cast("string").alias("lang")))
    size = (F.octet_length("key") / 4).cast("int")
    longer = phrases.where(F.octet_length("key") > 8)
    within = longer.select("f", F.explode(F.array(F.expr("substring(key, 1, octet_length(key) - 4)"), F.expr("substring(key, 5)"))).alias("key")).groupBy("key").agg(F.max("f").alias("most"))
    left = phrases.join(within, "key", "left").where("most is null or most < f").select("key", F.col("f").alias("a"), size.alias("n_words"))
    cuts = left.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("cut")).select("*", F.expr("substring(key, 1, 4 * cut)").alias("head"), F.expr("substring(key, 4 * cut + 1)").alias("tail"))
    cuts = cuts.join(known.select(F.col("key").alias("head"), F.col("f").alias("l"), "lang"), "head").join(known.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail")
    whole = cuts.groupBy("key", "a", "n_words").agg(F.max("lang").alias("lang"), F.collect_list(F.struct("cut", "l", "r")).alias("cuts")).join(totals, "lang")
    scored = F.expr("array_min(transform(cuts, x -> struct((1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(x.l as decimal(19,0)) * cast(x.r as decimal(19,0))) as score, x.cut as cut, x.l as l, x.r as r)))")
    best = whole.select("lang", "key", "a", "n", "n_words", scored.alias("best")).select("lang", "key", "a", "n", "n_words", "best.*")
    order = [F.desc("score"), F.desc("a")]
    near = best.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)  # with all ties
    spelled = near.select("key", F.posexplode(F.expr("transform(sequence(0, n_words - 1), i -> substring(key, 4 * i + 1, 4))")).alias("pos", "one"))
    spelled = spelled.join(single.select(F.col("key").alias("one"), "word"), "one").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = near.join(spelled, "key").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "n_words", "cut")
