"""Forms that are kept: at instants of a cascade, so that runs begin near where they are asked about, and dealt by key.

A kept table is bucketed by the key, one file a bucket. Tables of one key and number of buckets are joined one to one without
a shuffle: results with golds and pivots, a run with an earlier one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoweave.sources.readers import Cascade
from phonoweave.sources.shared import new_path

from . import whatif
from .engine import apply_cascade


@dataclass(frozen=True)
class Kept:
    """A bucketed table. drop() takes it away; its files go with the application at the latest."""

    name: str
    key: str
    buckets: int
    spark: object

    @property
    def df(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def keep(df: DataFrame, key: str, label: str, buckets: int | None = None) -> Kept:
    """`df` bucketed by its key: as many buckets as shuffle partitions by default. Rows without a key stay together in one."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").option("path", new_path(spark, label)).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return Kept(name, key, buckets, spark)


def side_by_side(tables: Sequence[Kept], how: str = "inner") -> DataFrame:
    """Kept tables of one key joined one to one, where they are. A key that a table has twice would multiply rows."""
    first, *rest = tables
    if any((t.key, t.buckets) != (first.key, first.buckets) for t in rest):
        raise ValueError("the tables are not dealt alike")
    out = first.df.hint("merge")
    for t in rest:
        out = out.join(t.df.hint("merge"), first.key, how)
    return out


@dataclass(frozen=True)
class Snapshots:
    """Forms of words at instants of a cascade (0: before the first rule), a column for each, in one kept table."""

    table: Kept
    cascade: Cascade
    instants: tuple[int, ...]

    @staticmethod
    def build(words: DataFrame, cascade: Cascade, every: int = 100, key: str = "word", form: str = "form", buckets: int | None = None) -> Snapshots:
        """From `words` (key, form), by one run: at each stage's instant, at every so many rules, and at the end."""
        n = len(cascade.rules)
        instants = sorted({0, n, *range(0, n, every), *(s.instant for s in cascade.stages)})
        run = apply_cascade(words.select(key, form), cascade, form, stops=instants)
        return Snapshots(keep(run.select(key, *(F.get("snaps", i).alias(f"f{x}") for i, x in enumerate(instants))), key, "snapshots", buckets), cascade, tuple(instants))

    def nearest(self, instant: int) -> int:
        """The last kept instant at or before."""
        if not 0 <= instant <= len(self.cascade.rules):
            raise ValueError(f"no instant {instant}")
        return max(x for x in self.instants if x <= instant)

    def kept(self, instant: int, name: str = "form") -> DataFrame:
        """(key, form) at a kept instant: one column is read and nothing is run."""
        return self.table.df.select(self.table.key, F.col(f"f{instant}").alias(name))

    def at(self, instant: int, tried: Accumulator | None = None) -> DataFrame:
        """(key, form) at any instant, by the rules since the nearest kept one alone. `tried` counts rules times forms."""
        near = self.nearest(instant)
        if near == instant:
            return self.kept(instant)
        out = apply_cascade(self.kept(near, "near"), self.cascade, "near", rules=(near, instant), tried=tried)
        return out.select(self.table.key, F.col("outcome").alias("form"))

    def run_both(self, h: whatif.Hypothesis, tried: Accumulator | None = None) -> DataFrame:
        """whatif.run_both() of a hypothesis about this cascade, from the nearest instant before the cascades part."""
        if h.base.rules != self.cascade.rules:
            raise ValueError("the hypothesis is about another cascade")
        near = self.nearest(h.fork())
        return whatif.run_both(self.kept(near), h, start=near, tried=tried)

    def drop(self) -> None:
        self.table.drop()


def form_at_rule(instant: int, cascade: Cascade) -> Column:
    """The form of a simulated word when so many rules have run, from its log and stages alone; null where it is absent.

    What comes next tells: the form before the next change, up to the next stage; else the form at that stage, or at the end.
    """
    after = [(i, s.instant) for i, s in enumerate(cascade.stages) if s.instant > instant]
    until = after[0][1] if after else len(cascade.rules)
    change = F.get(F.filter("log", lambda x: (x["rule_idx"] >= instant) & (x["rule_idx"] < until)), 0)
    return F.coalesce(change["before"], F.get(F.col("stages"), after[0][0])["form"] if after else F.col("outcome"))
