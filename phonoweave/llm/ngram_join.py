"""Exact n-gram Jaccard join by a token-group matrix.

Documents of equal shingle sets form a class; the rest is done for classes. Shingles are ordered by a frequency sketch, rare
first; a class's prefix is so long that two linked classes share a shingle in both prefixes. Classes that share a prefix
shingle are first compared with the bucket's leader, which groups similar classes in linear work. The token-group matrix
then has, for each prefix shingle and group, what the group's members can still share, and for each group the union of its
members' shingles as a bitmap. A class queries a group other than its own only where the matrix leaves room for a link, and a
group is opened, member by member, only if the query's overlap with the union can reach what a link needs.

Every filter is an upper bound, so no link is lost; every link is verified on the whole sets. Shingles are named by 64-bit
hashes, classes by half of a 128-bit digest; where the other half tells that two classes share a name, all are named anew.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import RepeatFilter, TwiceFilter, build_once, build_repeats
from .common import MIX_2, Stored, frugal, mix64, release, slices, strings, word_hashes
from .components import connected_components

WORDS, PERCENT = 5, 80
#: Counters of the frequency sketch, a fixed size; only the order of shingles depends on it, never a link.
SKETCH_BITS, SKETCH_PARTS = 22, 64
#: Bits of a class's parity signature and of a group's union, in which 16 bits of a shingle are its place.
PARITY_BITS, UNION_BITS = 1024, 1 << 16
#: Rows of one token that meet the token's groups in one task.
TASK_ROWS = 4096


def shingle_sets(at: np.ndarray, data: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text data[at[i]:at[i + 1]]."""
    word, counts = word_hashes(at, data)
    out = [np.zeros(0, np.uint64)] * len(counts)
    n = len(word) - words + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for j in range(words):
            h = h * MIX_2 + word[j : j + n]
        h = mix64(h)
    last = np.cumsum(counts)
    for i, (a, b) in enumerate(zip((last - counts).tolist(), last.tolist(), strict=True)):
        if b - a >= words:
            own = np.sort(h[a : b - words + 1])
            out[i] = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif b > a:
            short = np.uint64(b - a)
            for w in word[a:b]:
                short = np.uint64((int(short) * int(MIX_2) + int(w)) & (1 << 64) - 1)
            out[i] = mix64(np.array([short]))
    return out


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Two linked sets share an element among the first so many of each, in any common order."""
    return n - -(-percent * n // 100) + 1


class _SameName(Exception):
    """Two classes share a name."""


def class_of(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """Two halves of a digest of the set: its class's name, and what tells apart classes of one name."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=seed.to_bytes(4, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parity(s: np.ndarray) -> bytes:
    """Bit b is the parity of the set's hashes that fall on b: two signatures differ in no more bits than the sets in elements."""
    return np.packbits((np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def _sets(batch: pa.RecordBatch, words: int):
    at, data = strings(batch.column("text"))
    for a, b in slices(at):
        yield a, shingle_sets(at[a : b + 1], data, words)


def _ids(column: pa.Array) -> np.ndarray:
    """Hashes of ids."""
    return mix64(column.to_numpy().view(np.uint64))


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def frequency_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each counter of the sketch, about 8 * log2 of how often its shingles occur, over all rows; one byte each."""
    part = (1 << SKETCH_BITS) // SKETCH_PARTS

    @frugal
    def local(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, sets in _sets(batch, words):
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        for i in range(SKETCH_PARTS):
            own = counts[i * part : (i + 1) * part]
            if own.any():
                small = own.astype(np.min_scalar_type(own.max()))
                yield pa.RecordBatch.from_pydict({"part": pa.array([i], pa.int32()), "width": pa.array([small.itemsize], pa.int32()), "counts": pa.array([zlib.compress(small.tobytes(), 1)], pa.binary())})

    def merged(batches):
        now, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"part": pa.array([now], pa.int32()), "levels": pa.array([np.minimum(255, 8 * np.log2(total + 1.0)).astype(np.uint8).tobytes()], pa.binary())})
        for batch in batches:
            for i, width, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i != now:
                    if now is not None:
                        yield out()
                    now, total = i, np.zeros(part, np.int64)
                total += np.frombuffer(zlib.decompress(packed), f"u{width}")
        if now is not None:
            yield out()

    parts = docs.select("text").mapInArrow(local, "part int, width int, counts binary").repartition(SKETCH_PARTS, "part").sortWithinPartitions("part")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in parts.mapInArrow(merged, "part int, levels binary").collect():  # 4 MB in all
        levels[row.part * part : (row.part + 1) * part] = np.frombuffer(row.levels, np.uint8)
    return levels


def prefix(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The set's first elements in the common order: by level, then by hash."""
    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return s[np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]]  # s is sorted by hash


class _Join:
    """One run of the join over `docs` (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int, percent: int, seed: int = 0):
        self.docs, self.words, self.percent, self.seed = docs, words, percent, seed
        self.sc = docs.sparkSession.sparkContext
        self.kept: list[Stored] = []
        self.sent: list = []

    def store(self, df: DataFrame, label: str) -> DataFrame:
        self.kept.append(Stored(df, label))
        return self.kept[-1].df

    def needed(self, a: str, b: str) -> str:
        """SQL: a set of a and one of b elements are linked if they share at least so many."""
        return f"ceil({self.percent} * ({a} + {b}) / {100 + self.percent})"

    def profile(self) -> DataFrame:
        """doc_id, n_shingles, cls, the digest's other half and parity signature of every row; cls is null for empty sets."""
        words, seed = self.words, self.seed

        @frugal
        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for a, sets in _sets(batch, words):
                    rows = [(i, len(s), *(class_of(s, seed) if len(s) else (None, None)), parity(s) if len(s) else None) for i, s in zip(ids[a:], sets, strict=False)]
                    yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), ["doc_id", "n_shingles", "cls", "other", "sig"])

        return self.docs.mapInArrow(run, "doc_id long, n_shingles long, cls long, other long, sig binary")

    def prefix_rows(self, tokens: int) -> DataFrame:
        """(token, cls, size, pos) of prefix shingles that may be in two prefixes."""
        words, percent, seed = self.words, self.percent, self.seed
        levels = self.sc.broadcast(frequency_levels(self.docs, words).tobytes())

        def prefixes(batch):
            known = np.frombuffer(levels.value, np.uint8)
            for a, sets in _sets(batch, words):
                yield a, sets, [prefix(s, known, percent) for s in sets]

        def hashes_of(batch):
            for _, _, own in prefixes(batch):
                yield np.concatenate(own)

        twice = build_repeats(self.docs.select("text"), hashes_of, tokens // 2)
        sent = self.sc.broadcast((twice.bits.tobytes(), twice.log2))
        self.sent += [levels, sent]

        @frugal
        def run(batches):
            filt = RepeatFilter(*sent.value)
            for batch in batches:
                for _, sets, own in prefixes(batch):
                    token = np.concatenate(own)
                    length = np.array([len(p) for p in own])
                    size = np.repeat([len(s) for s in sets], length)
                    cls = np.repeat(np.array([class_of(s, seed)[0] if len(s) else 0 for s in sets], np.int64), length)
                    pos = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
                    keep = np.flatnonzero(filt.suspects(token))
                    yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(cls[keep]), pa.array(size[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], ["token", "cls", "size", "pos"])

        return self.docs.select("text").mapInArrow(run, "token long, cls long, size int, pos int")

    def fetch_sets(self, classes: DataFrame, owners: DataFrame, low: bool = False) -> DataFrame:
        """(cls, set) of the given distinct classes, from the text of one row of each; with `low` the places in a union alone.

        A filter of the owners' ids tells where their texts are; sets are made there, and no text is shuffled.
        """
        words, seed = self.words, self.seed
        wanted = self.store(classes.join(owners, "cls").select("cls", "owner").where("owner is not null"), "wanted")
        once = build_once(wanted.select("owner"), lambda b: iter([_ids(b.column("owner"))]), wanted.count())
        sent = self.sc.broadcast((once.bits.tobytes(), once.log2))
        self.sent.append(sent)

        @frugal
        def run(batches):
            filt = TwiceFilter(*sent.value)
            for batch in batches:
                for _, sets in _sets(batch.take(pa.array(np.flatnonzero(filt.suspects(_ids(batch.column("doc_id")))))), words):
                    yield _batch([(class_of(s, seed)[0], (s.astype(np.uint16) if low else s).tobytes()) for s in sets if len(s)], (pa.int64(), pa.binary()), ["cls", "set"])

        # Written where the texts are; what is joined with them reads the table, so a set is not moved before its first join.
        made = self.store(self.docs.where("doc_id is not null").mapInArrow(run, "cls long, set binary"), "sets")
        return made.join(wanted.select("cls"), "cls").dropDuplicates(["cls"])

    def verify(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that are linked. Signatures rule out most others before sets are fetched."""
        percent = self.percent
        sides = [classes.select(F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab"]

        def near(batches):
            for batch in batches:
                sig = [np.frombuffer(b"".join(batch.column(f"sig_{x}").to_pylist()), np.uint8).reshape(-1, PARITY_BITS // 8) for x in "ab"]
                both = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
                differ = np.bitwise_count(sig[0] ^ sig[1]).sum(axis=1)
                keep = np.flatnonzero(differ <= both - 2 * (-(-percent * both // (100 + percent))))
                yield batch.take(pa.array(keep)).select(["a", "b"])

        some = self.store(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(near, "a long, b long"), "pairs")
        ends = some.select(F.col("a").alias("cls")).union(some.select(F.col("b").alias("cls"))).distinct()
        sets = self.fetch_sets(ends, classes)
        one, two = sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b"))

        @frugal
        def linked(batches):
            for batch in batches:
                rows = []
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b")), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    where = np.searchsorted(y, x)
                    shared = int((y[np.minimum(where, len(y) - 1)] == x).sum())
                    if 100 * shared >= percent * (len(x) + len(y) - shared):
                        rows.append((a, b))
                yield _batch(rows, (pa.int64(), pa.int64()), ["a", "b"])

        return some.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b").mapInArrow(linked, "a long, b long")

    def fits(self, x: str, y: str) -> str:
        """SQL: the sizes allow a link, and so do the elements from this token on (it is the first shared one)."""
        return (
            f"100 * {x}.size >= {self.percent} * {y}.size and 100 * {y}.size >= {self.percent} * {x}.size and "
            f"least({x}.size - {x}.pos, {y}.size - {y}.pos) >= {self.needed(f'{x}.size', f'{y}.size')}"
        )

    def links(self, profile: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(node, component) of the classes linked with leaders, and the same of groups and single classes linked with others.

        The second is None without such links. Both together connect all classes that are connected; what the first has
        connected goes into the second as one node, so that it is not worked out again.
        """
        named = profile.where("cls is not null").groupBy("cls").agg(F.min("n_shingles").alias("size"), F.first("sig").alias("sig"), F.min("doc_id").alias("owner"), (F.min("other") < F.max("other")).alias("same"))
        classes = self.store(named, "classes")
        row = classes.agg(F.sum(F.col("size") * (100 - self.percent) / 100 + 1).alias("n"), F.count_if("same").alias("same")).first()
        if row.same:
            raise _SameName
        total, classes = row.n or 0, classes.drop("same")
        raw = self.store(self.prefix_rows(int(total)).groupBy("token", "cls").agg(F.first("size").alias("size"), F.first("pos").alias("pos")), "prefixes")
        for x in self.sent:
            x.unpersist()
        bucket = raw.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.min("size").alias("least"), F.min(F.struct("pos", "cls", "size")).alias("lead")).where("lo < hi").select("token", "least", "lead")
        room = f"size - pos >= {self.needed('size', f'greatest(least, ceil({self.percent} * size / 100))')}"
        rows = self.store(raw.join(bucket, "token").where(room).select("token", "cls", "size", "pos", "lead"), "rows")
        x, y = "x", "lead"
        led = rows.select(F.struct("cls", "size", "pos").alias("x"), "lead").where(f"x.cls <> lead.cls and {self.fits(x, y)}").select(F.col("x.cls").alias("a"), F.col("lead.cls").alias("b")).distinct()
        first = self.store(self.verify(led, classes), "links")
        groups, stars = connected_components(first, "a", "b")
        self.kept.append(stars)
        rows = rows.drop("lead").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("grp", F.coalesce("component", "cls")).drop("component")
        matrix = rows.groupBy("token", "grp").agg(F.count("*").alias("n"))
        # A token of very many rows is dealt over several tasks, each of which has all its groups.
        mixed = matrix.groupBy("token").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.ceil(F.sum("n") / TASK_ROWS).cast("int").alias("deals")).where("g1 < g2").select("token", "deals")
        rows = self.store(rows.join(mixed, "token"), "rows")
        if rows.isEmpty():
            return groups, None
        matrix = rows.groupBy("token", F.col("grp").alias("other")).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.expr("size - pos")).alias("rest"), F.first("deals").alias("deals"))
        matrix = matrix.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals")
        open_to = (
            f"grp < other and 100 * most >= {self.percent} * size and 100 * size >= {self.percent} * least and "
            f"least(size - pos, rest) >= {self.needed('size', f'greatest(least, ceil({self.percent} * size / 100))')}"
        )
        dealt = rows.withColumn("deal", F.pmod(F.xxhash64("cls"), F.col("deals")).cast("int"))
        asked = self.store(dealt.join(matrix, ["token", "deal"]).where(open_to).groupBy("cls", "other").agg(F.first("size").alias("size"), F.min("least").alias("least")), "asked")
        if asked.isEmpty():
            return groups, None
        asked = self.bounded(asked, rows, classes)
        one = rows.join(asked.select("cls", "other"), "cls").select("token", "other", F.struct("cls", "size", "pos").alias("x"))
        two = rows.select("token", F.col("grp").alias("other"), F.struct("cls", "size", "pos").alias("y"))
        opened = one.join(two, ["token", "other"]).where(self.fits("x", "y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        more = self.store(self.verify(opened, classes), "links")
        if more.isEmpty():
            return groups, None
        for x in "ab":
            own = groups.select(F.col("node").alias(x), "component")
            more = more.join(own, x, "left").withColumn(x, F.coalesce("component", x)).drop("component")
        tops, stars = connected_components(more, "a", "b")
        self.kept.append(stars)
        return groups, tops

    def bounded(self, asked: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """The (cls, other) whose overlap with the union of the group's shingles can reach what a link needs.

        A union is a bitmap of fixed size, so that the group's members are combined before and after the shuffle.
        """
        percent = self.percent
        members = rows.join(asked.select(F.col("other").alias("grp")).distinct(), "grp").select("cls", "grp").distinct()
        ends = asked.select("cls").union(members.select("cls")).distinct()
        sets = self.fetch_sets(ends, classes, low=True)

        def merge(of):
            @frugal
            def run(batches):
                now, bits = None, None
                for batch in batches:
                    for grp, value in zip(batch.column("grp").to_pylist(), batch.column("value").to_pylist(), strict=True):
                        if grp != now:
                            if now is not None:
                                yield _batch([(now, zlib.compress(bits.tobytes(), 1))], (pa.int64(), pa.binary()), ["grp", "value"])
                            now, bits = grp, np.zeros(UNION_BITS // 8, np.uint8)
                        of(bits, value)
                if now is not None:
                    yield _batch([(now, zlib.compress(bits.tobytes(), 1))], (pa.int64(), pa.binary()), ["grp", "value"])

            return run

        def add_set(bits, value):
            at = np.frombuffer(value, np.uint16)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

        def add_bits(bits, value):
            bits |= np.frombuffer(zlib.decompress(value), np.uint8)

        kind = "grp long, value binary"
        parts = members.join(sets, "cls").select("grp", F.col("set").alias("value")).sortWithinPartitions("grp").mapInArrow(merge(add_set), kind)
        unions = parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(merge(add_bits), kind).select(F.col("grp").alias("other"), F.col("value").alias("union"))

        @frugal
        def room(batches):
            for batch in batches:
                rows = []
                for cls, other, least, own, packed in zip(*(batch.column(c).to_pylist() for c in ("cls", "other", "least", "set", "union")), strict=True):
                    at = np.frombuffer(own, np.uint16)
                    n = len(at)
                    bits = np.frombuffer(zlib.decompress(packed), np.uint8)
                    overlap = int(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).sum())
                    least = max(least, -(-percent * n // 100))
                    if overlap >= -(-percent * (n + least) // (100 + percent)):
                        rows.append((cls, other))
                yield _batch(rows, (pa.int64(), pa.int64()), ["cls", "other"])

        met = asked.join(sets, "cls").join(unions, "other").select("cls", "other", "least", "set", "union")
        return self.store(met.mapInArrow(room, "cls long, other long"), "opened")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text).

    A-Z is lower-cased, words are runs of anything but the six ASCII spaces. A set holds the distinct shingles of `words`
    words, or with fewer words the whole sequence. Rows link when 100 * intersection >= percent * union. component_id is the
    least doc_id reachable by links, itself included. Null and empty texts and those without words have an empty set, link
    with nothing and are their own component. Repeated rows are linked with each other. Rows without an id are linked with
    rows of equal sets, but no other. Other columns are not looked at; an empty table gives an empty result.
    """
    for seed in range(8):
        join = _Join(docs.select("doc_id", "text"), words, percent, seed)
        profile = join.store(join.profile(), "profile")
        try:
            groups, tops = join.links(profile)
            break
        except _SameName:
            for x in join.kept:
                x.drop()
    else:
        raise RuntimeError("classes could not be told apart")
    # What many rows share is settled for classes and written, so that the joins on it read tables and skew can be split.
    owners = profile.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("owner"))
    grouped = join.store(owners.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "owner", F.coalesce("component", "cls").alias("grp")), "grouped")
    heads = grouped.groupBy("grp").agg(F.min("owner").alias("component_id"))
    if tops is not None:
        tied = join.store(heads.join(tops.withColumnRenamed("node", "grp"), "grp", "left").select("grp", "component_id", F.coalesce("component", "grp").alias("top")), "tied")
        heads = tied.select("grp", "top").join(tied.groupBy("top").agg(F.min("component_id").alias("component_id")), "top").select("grp", "component_id")
    heads = join.store(heads, "heads")
    named = join.store(grouped.join(heads, "grp").select("cls", "component_id"), "named")
    out = profile.select("doc_id", "n_shingles", "cls").join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    for x in join.sent:
        x.unpersist()
    for x in join.kept[1:-1]:  # the result reads the first and the last
        x.drop()
    release(docs.sparkSession)
    return out
