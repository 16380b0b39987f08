"""Exact top-k inner products over a bit-sliced index.

A block of rows stores, for each component, one bitmap for each bit of the quantised value. A query's scores over the
block are sums of such bitmaps with weights, added by carry-save bitmap arithmetic; the highest are selected from the
most significant slice of the sum downward, and rows that tie at the boundary are resolved by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored

SCALE = 1024
#: Rows in a block of the index, and queries in a block: what a task holds at once.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 13, 256
#: Blocks of the index that one merge brings together, and that at most are in one group that queries are dealt to.
MERGE_BLOCKS = 64
#: Bytes of the queries that a group of the index meets at once; more are dealt to several cells.
CELL_BYTES = 1 << 25


def quantise(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def to_bitmaps(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bitmaps by component and bit, offset of each component, number of rows) of quantised vectors.

    A component's slices hold value - offset, where the offset is its least value in the block.
    """
    n, dims = values.shape
    offset = values.min(axis=0)
    shifted = (values - offset).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    words = -(-n // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((shifted >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        out[:, b, : packed.shape[0]] = packed.T
    return out.view(np.uint64), offset, n


def add_slices(planes: np.ndarray, dims: int, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices of the sum, lowest first; what to add to it) of the slices weighted by |q|.

    `planes` are the bitmaps by component and bit, then their complements, which a negative weight takes. By powers of two,
    all bitmaps of one weight are reduced by full adders, which turn three into a sum and a carry of the next weight.
    """
    bits = len(planes) // (2 * dims)
    weight = np.abs(query)
    extra = -int(weight[query < 0].sum()) * ((1 << bits) - 1)  # q * v = |q| * (ones - v) - |q| * ones for q < 0
    first = np.arange(dims) * bits + np.where(query < 0, dims * bits, 0)
    width = int(weight.max()).bit_length()
    chosen = [first[(weight >> p & 1) == 1] for p in range(width)]
    out, carries, i = [], [], 0
    while i < width + bits - 1 or carries:
        index = [chosen[i - b] + b for b in range(bits) if 0 <= i - b < width]
        stack = np.concatenate([planes[np.concatenate(index)] if index else planes[:0], *carries])
        carries = []
        while len(stack) > 1:
            t = len(stack) // 3
            if not t:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
                break
            x, y, z, rest = stack[:t], stack[t : 2 * t], stack[2 * t : 3 * t], stack[3 * t :]
            half = x ^ y
            carries.append((x & y) | (half & z))
            stack = np.concatenate([half ^ z, rest]) if len(rest) else half ^ z
        out.append(stack[0] if len(stack) else np.zeros(planes.shape[1], np.uint64))
        i += 1
    return out, extra


def top_rows(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the valid rows with the k highest sums, from the most significant slice down; ties to earlier rows."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    count = lambda x: int(np.bitwise_count(x).sum())
    left = k
    for plane in reversed(total):
        high = open_ & plane
        n = count(high)
        if n > left:
            open_ = high
        else:
            sure |= high
            left -= n
            open_ &= ~plane
            if not left:
                return sure
    rows = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))[:left]
    tied = np.zeros(len(open_) * 8, np.uint8)
    np.bitwise_or.at(tied, rows >> 3, np.uint8(1) << (rows & 7).astype(np.uint8))
    return sure | tied.view(np.uint64)


def read_sums(total: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    for i, plane in enumerate(total):
        out += ((plane[word] >> bit) & np.uint64(1)).astype(np.int64) << i
    return out


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1)


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector: array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    # the greatest square of a component, times their number, bounds every score of two such vectors
    most = F.sqrt(F.lit(float(1 << 62)) / F.size(v)) / SCALE - 2
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > most))
    return table.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("vector"))


def top_k(table: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id_col, score: for every query row its k highest integer inner products over `table`.

    Components become floor(1024 * x). A row is no candidate for a query of its own id. Ties go to the smaller id, and
    repeated rows of one id count once for each row, in any order. Fewer candidates than k give fewer rows. Vectors that are
    null, empty, or hold null or non-finite components take no part, nor do those with a component so great that a score of two
    such vectors of that length might leave 64 bits (beyond sqrt(2^62 / length) / 1024 - 2, some 260,000 at 64 components);
    vectors of another length than the query's are no
    candidates for it. Blocks of queries meet those of the index by a join on cells, each a group of the index's parts and one
    of the queries, so the work is split over both and nothing is broadcast; a cell streams its part of the index past at most
    about CELL_BYTES of queries. Each pair of blocks emits at most k rows a query, which are merged in groups of parts and
    then in full.
    """
    data = usable(table, id_col, vector_col).where(F.size("vector") > 0)
    # Rows in order of id within a block let ties be resolved by position.
    parts = max(1, -(-data.count() // BLOCK_ROWS))
    blocks = Stored(data.withColumn("dims", F.size("vector")).repartitionByRange(parts, F.col("dims"), F.col("id")).sortWithinPartitions("dims", "id").mapInArrow(_index, INDEX), "bit-slices", "none")
    asked = Stored(usable(queries, id_col, vector_col).where(F.size("vector") > 0).mapInArrow(_ask, ASKED), "queries")
    met = _meet(blocks.df, asked.df)
    hits = met.select("part", "ids", "slices", "offsets", "q_ids", "q_vectors", "dims").mapInArrow(_search(k), "query_id long, id long, score long, part int")
    order = [F.desc("score"), F.asc("id")]
    some = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _meet(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """Every block of the index beside every block of queries of its length.

    A group of the index is a cell's width, one of the queries its height. Both sides are dealt by shuffles that spill:
    copies of the queries would be broadcast whole by their size before they are multiplied.
    """
    last = blocks.agg(F.max("part")).first()[0]
    size = asked.agg(F.sum(F.octet_length("q_vectors"))).first()[0]
    if last is None or size is None:
        across, down = 0, 0
    else:
        across = min(last + 1, max(4 * blocks.sparkSession.sparkContext.defaultParallelism, last // MERGE_BLOCKS + 1))
        down = -(-size // CELL_BYTES)
    numbers = lambda n: F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
    left = blocks.withColumn("across", F.pmod("part", F.lit(max(1, across)))).withColumn("down", F.explode(numbers(down)))
    right = asked.withColumn("down", F.pmod(F.hash("q"), F.lit(max(1, down)))).withColumn("across", F.explode(numbers(across)))
    cells = 2 * max(1, across * down)  # a number that is given is kept, however few bytes there are to so much work
    return left.repartition(cells, "across", "down").join(right.repartition(cells, "across", "down").hint("merge"), ["across", "down"]).where("dims = q_dims")


INDEX = "part int, dims int, ids binary, slices binary, offsets binary"
ASKED = "q string, q_dims int, q_ids binary, q_vectors binary"


def _runs(batches, limit: int):
    """(dims, ids, quantised vectors) of up to `limit` rows of one length, in the order of arrival."""
    held: dict[int, list] = {}
    for batch in batches:
        lengths = np.diff(batch.column("vector").offsets.to_numpy())
        ids = batch.column("id").to_numpy()
        for dims in np.unique(lengths):
            take = np.flatnonzero(lengths == dims)
            sub = batch.take(pa.array(take))
            part = held.setdefault(int(dims), [[], [], 0])
            part[0].append(ids[take])
            part[1].append(quantise(_vectors(sub)))
            part[2] += len(take)
            while part[2] >= limit:
                i, v = np.concatenate(part[0]), np.concatenate(part[1])
                yield int(dims), i[:limit], v[:limit]
                held[int(dims)] = part = [[i[limit:]], [v[limit:]], len(i) - limit]
    for dims, (i, v, n) in held.items():
        if n:
            yield dims, np.concatenate(i), np.concatenate(v)


def _index(batches):
    part = TaskContext.get().partitionId()
    for dims, ids, values in _runs(batches, BLOCK_ROWS):
        maps, offset, _ = to_bitmaps(values)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "slices": [maps.tobytes()], "offsets": [offset.tobytes()]})


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values in the narrowest integers of 2, 4 or 8 bytes that hold them."""
    for kind in (np.int16, np.int32):
        if len(values) and np.iinfo(kind).min <= values.min() and values.max() <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def _ask(batches):
    part = TaskContext.get().partitionId()
    for n, (dims, ids, values) in enumerate(_runs(batches, BLOCK_QUERIES)):
        yield pa.RecordBatch.from_pydict({"q": [f"{part}.{n}"], "q_dims": pa.array([dims], pa.int32()), "q_ids": [ids.astype(np.int64).tobytes()], "q_vectors": [_narrow(values).tobytes()]})


def _search(k: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, dims = np.frombuffer(row["ids"], np.int64), row["dims"]
                words = -(-len(ids) // 64)
                maps = np.frombuffer(row["slices"], np.uint64).reshape(-1, words)
                planes = np.concatenate([maps, ~maps])
                offset = np.frombuffer(row["offsets"], np.int64)
                valid = np.zeros(words * 64, np.uint8)
                valid[: len(ids)] = 1
                valid = np.packbits(valid, bitorder="little").view(np.uint64)
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                width = len(row["q_vectors"]) // (len(q_ids) * dims)
                asked = np.frombuffer(row["q_vectors"], f"i{width}").astype(np.int64).reshape(-1, dims)
                out = []
                for query_id, q in zip(q_ids.tolist(), asked, strict=True):
                    total, extra = add_slices(planes, dims, q)
                    mine = valid.copy()
                    a, b = np.searchsorted(ids, query_id, "left"), np.searchsorted(ids, query_id, "right")
                    for i in range(a, b):
                        mine[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
                    rows = np.flatnonzero(np.unpackbits(top_rows(total, mine, k).view(np.uint8), bitorder="little"))
                    scores = read_sums(total, rows) + (extra + int(q @ offset))
                    out += zip([query_id] * len(rows), ids[rows].tolist(), scores.tolist(), strict=True)
                part = row["part"] // MERGE_BLOCKS
                cols = list(zip(*out, strict=True)) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([part] * len(out), pa.int32())], ["query_id", "id", "score", "part"])

    return search
