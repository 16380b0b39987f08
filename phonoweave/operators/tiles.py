"""Sheets that are too wide for a pivot, in tiles of columns; and rows laid out so that one word reads one row group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phonoweave.sources.shared import stored

#: Bytes of a row group of a file that is looked up by key.
GROUP_BYTES = 8 << 20


def dense_numbers(df: DataFrame, key: str) -> DataFrame:
    """(key, number): the distinct keys in order, from 0. Ranges of keys are counted, then numbered among themselves."""
    parts = stored(df.select(key).distinct().repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = parts.groupBy("_part").agg(F.count("*").alias("n"))
    ahead = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("ahead"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return parts.withColumn("own", own).join(F.broadcast(ahead), "_part").select(key, (F.col("ahead") + F.col("own")).alias("number"))


def rule_tiles(steps: DataFrame, width: int = 256, key: str = "etym_id") -> DataFrame:
    """(tile, rule_idx, c0, c1, ...): the sheet of rules by words, of `steps` (key, rule_idx, after), `width` words a tile.

    All the words that some rule changes have a column, in order of the key: tile * width + its number. A cell is null where the
    rule leaves the word as it is; rules that change no word of a tile have no row in it.
    """
    placed = steps.join(dense_numbers(steps, key), key)
    cells = placed.select(F.floor(F.col("number") / width).alias("tile"), "rule_idx", F.struct((F.col("number") % width).cast("int").alias("k"), F.col("after").alias("v")).alias("cell"))
    rows = cells.groupBy("tile", "rule_idx").agg(F.map_from_entries(F.collect_list("cell")).alias("cells"))  # `width` at most
    return rows.select("tile", "rule_idx", *(F.try_element_at("cells", F.lit(i)).alias(f"c{i}") for i in range(width)))


def tile_words(steps: DataFrame, width: int = 256, key: str = "etym_id") -> DataFrame:
    """(tile, place, key): which word a tile's column is."""
    return dense_numbers(steps, key).select(F.floor(F.col("number") / width).alias("tile"), (F.col("number") % width).cast("int").alias("place"), key)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """Parquet files in ranges of the key, each sorted by it, with small row groups and a filter of keys for each.

    A reader that asks for one key is told by the files' statistics which row groups may have it; the rest is not read.
    """
    out = df.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", str(GROUP_BYTES))
    out.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one key of what write_by_key() wrote."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(value))
