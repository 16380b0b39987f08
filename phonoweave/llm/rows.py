"""Whole rows kept beside what an operator adds: stages of a pipeline return the columns that they got, whatever their names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import TwiceFilter, build_once
from .common import Stored, frugal, mix64
from .ngram_join import near_duplicates

#: How often rows are named anew before it is an error that two still share a name.
NAMINGS = 8


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def held(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own` as they are, and all others as one struct `row`, in which no name can clash with what is added."""
    rest = [quoted(c) for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*rest).alias("row") if rest else F.struct(F.lit(None).alias("_")).alias("row"))


def given_back(rows: DataFrame, docs: DataFrame, **own: Column) -> DataFrame:
    """The columns of `docs` in their order: those named from `own`, the others from `row`."""
    return rows.select(*((own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns))


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (c.isNull(), c)))


def _hashable(field: T.StructField) -> bool:
    return "map<" not in field.dataType.simpleString() and "variant" not in field.dataType.simpleString()


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates of `docs` (doc_id, text, ...), all its columns.

    It is that of least doc_id, one without an id only if none has one. Rows equal in id and text are one document, of which
    the row stays whose other columns have the least hash. Rows are named by a hash of id and text, so differing texts of one
    id and texts without an id are compared like any others; a second hash tells whether two share a name, and then all are
    named anew. Rows that stay as they are stay where they are: a filter tells which may go, and only these are joined.
    """
    first, second, rest = quoted("doc_id"), quoted("text"), [quoted(f.name) for f in docs.schema.fields if _hashable(f)]
    for seed in range(NAMINGS):
        name = _hash(seed, first, second)
        named = Stored(docs.select(name.alias("r"), _hash(seed + NAMINGS, second, first).alias("o"), "doc_id").groupBy("r").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), (F.min("o") < F.max("o")).alias("same")), "named")
        if not named.df.where("same").isEmpty():
            named.drop()
            continue
        break
    else:
        raise RuntimeError("rows could not be told apart")
    found = near_duplicates(docs.select(name.alias("doc_id"), "text"), words=words, percent=percent)
    groups = found.select(F.col("doc_id").alias("r"), "component_id").distinct()
    heads = named.df.join(groups, "r").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r", "n")).alias("head"))
    heads = Stored(heads.select("head.r", "head.n"), "heads")
    moved = Stored(named.df.join(heads.df.where("n = 1").select("r"), "r", "left_anti").select("r"), "moved")
    filt = build_once(moved.df, lambda b: iter([_scrambled(b.column("r"))]), moved.df.count())
    sent = docs.sparkSession.sparkContext.broadcast((filt.bits.tobytes(), filt.log2))
    rows = docs.select(name.alias("r"), _hash(seed, *rest).alias("w"), F.struct(*map(quoted, docs.columns)).alias("row"))

    def those(suspected: bool) -> DataFrame:
        @frugal
        def run(batches):
            own = TwiceFilter(*sent.value)
            for batch in batches:
                yield batch.take(pa.array(np.flatnonzero(own.suspects(_scrambled(batch.column("r"))) == suspected)))

        return rows.mapInArrow(run, rows.schema)

    chosen = those(True).join(heads.df.select("r"), "r", "left_semi").groupBy("r").agg(F.min_by("row", "w").alias("row"))
    return those(False).select("row").unionByName(chosen.select("row")).select("row.*")


def _scrambled(names: pa.Array) -> np.ndarray:
    return mix64(names.to_numpy().view(np.uint64))
