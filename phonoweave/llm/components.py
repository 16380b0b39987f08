"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> tuple[DataFrame, Stored | None]:
    """(node, component) for every node that has an edge to another node; the component is its least node.

    Alternating large-star and small-star rounds: each is one aggregation and one join, so a hub is combined before
    the shuffle and a skewed join can be split. Each round is written to the shared folder. Null ends and self-loops
    are no edges; an empty input gives an empty result. The second value is what the result reads.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")  # a null end gives u = v
    now = Stored(pairs.distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row.n, row.h

    last = mark(now.df)
    for _ in range(max_rounds if last[0] else 0):
        step = Stored(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now = step
        new = mark(now.df)
        if new == last:
            break
        last = new
    else:
        if last[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    release(edges.sparkSession)
    star = now.df
    heads = star.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(heads), now
