"""Lines of text files with their numbers, without bringing them anywhere: counts by split, and prefix sums of these.

Spark reads a file in splits, each from its first whole line on. The number of a line is that of the lines in the files and
splits before it, and its place in its own split. Only a row a split is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from phonoweave.functions.features import norm

from .shared import stored

#: Splits up to this many are sent to all executors; beyond, lines are joined with them.
SPLITS_SENT = 100_000


def _split_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, split, at, value): at rises with the lines of a split, without gaps."""
    read = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], count: Column | None = None) -> DataFrame:
    """(line_no, value) of every line of the files, from 0, in order of the files' paths and the lines in them.

    With `count` (of the column value) only lines of which it holds are numbered, the others have null. A line ends with \\n;
    what follows a file's last \\n is a line if it is not empty. No file, or empty ones, give no row.
    """
    lines = _split_lines(spark, paths)
    counts = F.lit(True) if count is None else count
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("least"), F.count_if(counts).alias("n"))
    in_file = Window.partitionBy("file").orderBy("split")
    splits = splits.withColumn("ahead", F.sum("n").over(in_file) - F.col("n"))
    files = splits.groupBy("file").agg(F.sum("n").alias("all"))
    files = files.select("file", (F.sum("all").over(Window.orderBy("file")) - F.col("all")).alias("files_ahead"))  # a row a file
    starts = stored(splits.join(files, "file").select("file", "split", "least", (F.col("ahead") + F.col("files_ahead")).alias("start")), "splits")
    own = F.broadcast(starts) if starts.count() <= SPLITS_SENT else starts
    found = lines.join(own, ["file", "split"])
    if count is None:
        return found.select((F.col("start") + F.col("at") - F.col("least")).alias("line_no"), "value")
    placed = _placed(found.select("file", "split", "start", "value", counts.alias("counts")))
    return placed.select(F.when(F.col("counts"), F.col("start") + F.col("place")).alias("line_no"), "value")


def _placed(lines: DataFrame) -> DataFrame:
    """`lines` with place: how many lines that count are before each in its split. A task has a split's lines in order."""

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            files, splits = batch.column("file").dictionary_encode(), batch.column("split").to_numpy()
            code, counts = files.indices.to_numpy(), batch.column("counts").to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(counts) - counts
            new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(splits, prepend=-1) != 0))
            names = files.dictionary.to_pylist()
            for a, b in zip(new, [*new[1:], len(code)], strict=True):
                key = (names[code[a]], splits[a])
                carry = seen if key == last else 0
                seen, last = carry + int(counts[a:b].sum()), key
                before[a:b] += carry - before[a]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "place"])

    return lines.mapInArrow(run, T.StructType([*lines.schema.fields, T.StructField("place", T.LongType())]))


def first_line(spark: SparkSession, paths: str | Sequence[str], that: Column) -> str | None:
    """The first line of which `that` holds: only the least of each task moves."""
    row = _split_lines(spark, paths).where(that).agg(F.min(F.struct("file", "split", "at", "value")).alias("x")).first()
    return row.x.value if row.x is not None else None


@F.pandas_udf(T.StringType())
def _decomposed(lines: pd.Series) -> pd.Series:
    return lines.map(norm, na_action="ignore")


def decomposed(lines: DataFrame) -> DataFrame:
    """`lines` (value, ...) canonically decomposed."""
    return lines.withColumn("value", _decomposed("value"))
