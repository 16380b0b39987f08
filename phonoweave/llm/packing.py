"""Optimal length buckets: boundaries of least padding by dynamic programming, token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stored
from .token_counts import count_tokens

BUCKETS, BUDGET = 12, 16_384
#: Rows that one sort brings together, and equal rows that are dealt together.
SLOT_ROWS, ALIKE_ROWS = 20_000, 1000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper boundaries of at most `buckets` buckets with the least sum of boundary * count.

    `lengths` ascend and have `counts` rows each. best(j) = min over i of best'(i) + length(j) * rows
    between; as the cost is of Monge type, the best i does not fall with j, and each layer is solved by halving.
    """
    n = len(lengths)
    if n <= buckets:
        return lengths.copy()
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    best = lengths[np.arange(n)] * rows[1:]
    best = np.concatenate([[0.0], best])  # the first j bins in one bucket
    choice = []
    for _ in range(1, buckets):
        new, pick = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            end = min(b, j - 1) + 1
            cost = best[a:end] + lengths[j - 1] * (rows[j] - rows[a:end])
            k = int(cost.argmin())
            new[j], pick[j] = cost[k], a + k
            todo += [(lo, j - 1, a, a + k), (j + 1, hi, a + k, b)]
        choice.append(pick)
        best = new
    out, j = [], n
    for pick in reversed(choice):
        if j:
            out.append(lengths[j - 1])
            j = int(pick[j])
    if j:
        out.append(lengths[j - 1])
    return np.array(sorted(set(out)))


def token_lengths(docs: DataFrame, tokenizer_path: str, key: str | None = None) -> DataFrame:
    """doc_id and n_tokens of the whole text, by the tokenizer; null has none. With `key` a column of that name tells the texts
    of one id apart: their MD5 digest, null for null."""
    counted = count_tokens(docs.select("doc_id", "text"), tokenizer_path)
    return counted.select("doc_id", *([F.md5(F.encode("text", "UTF-8")).alias(key)] if key else []), "n_tokens")


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """The columns of `lengths` (doc_id, n_tokens, ...), and bucket (from 0), bucket_len, batch_id, for every row.

    The histogram of lengths over all rows is what the driver gets; it has at most as many entries as the longest row has
    tokens, each length has its own, and so the boundaries are optimal. A batch holds at most budget // bucket_len rows, so
    that padded to bucket_len it keeps the budget; a row longer than the budget is a batch of its own. Equal rows are counted,
    and dealt ALIKE_ROWS at a time. Within a bucket, what is dealt goes by a hash into slots of about SLOT_ROWS rows, each of
    which forms its batches in order of its columns, so that no bucket or id is sorted in one task and a lost task is made
    again as it was. A null length counts as 0, and a row of length 0 takes a place like any other. Rows without an id are
    dealt like others. An empty table gives an empty result. Columns named like the new ones are replaced.
    """
    names = [c for c in lengths.columns if c not in ("bucket", "bucket_len", "batch_id")]
    rows = lengths.select(*names).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)).cast("long"))
    histogram = sorted(rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect())
    if not histogram:
        return rows.select(*names, F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("bucket_len"), F.lit("").alias("batch_id"))
    tops, counts = np.array([r.n_tokens for r in histogram], np.int64), np.array([r.n for r in histogram], np.int64)
    ends = boundaries(tops, counts, buckets)
    bucket = slots = capacity = end_of = None
    for i, end in reversed([*enumerate(ends.tolist())]):
        inside = (tops <= end) & (tops > (ends[i - 1] if i else -1))
        values = (i, max(1, -(-int(counts[inside].sum()) // SLOT_ROWS)), max(1, budget // max(1, end)), end)
        here = F.col("n_tokens") <= end
        bucket, slots, capacity, end_of = (F.lit(v) if x is None else F.when(here, v).otherwise(x) for v, x in zip(values, (bucket, slots, capacity, end_of), strict=True))
    alike = rows.groupBy(*names).agg(F.count("*").alias("_n"))
    dealt = alike.select("*", F.explode(F.expr(f"sequence(0, (_n - 1) div {ALIKE_ROWS})")).alias("_deal")).withColumn("_copies", F.least(F.lit(ALIKE_ROWS), F.col("_n") - F.col("_deal") * ALIKE_ROWS))
    spread = F.xxhash64(*(x for c in names for x in (F.col(c).isNull(), F.col(c))), F.col("_deal"))
    placed = dealt.withColumns({"bucket": bucket, "bucket_len": end_of.cast("long"), "_room": capacity, "_slot": F.pmod(spread, slots.cast("long"))})
    before = F.sum("_copies").over(Window.partitionBy("bucket", "_slot").orderBy(*names, "_deal").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_copies")
    each = placed.withColumn("_before", before).withColumn("_i", F.explode(F.expr("sequence(0, _copies - 1)")))
    return each.select(*names, "bucket", "bucket_len", F.concat_ws("-", "bucket", "_slot", F.floor((F.col("_before") + F.col("_i")) / F.col("_room"))).alias("batch_id"))


def pack_documents(docs: DataFrame, tokenizer_path: str, buckets: int = BUCKETS, budget: int = BUDGET, key: str | None = None) -> DataFrame:
    """pack() of the token counts of `docs` (doc_id, text); the counts are written once, as two steps read them."""
    return pack(Stored(token_lengths(docs, tokenizer_path, key), "lengths").df, buckets, budget)
