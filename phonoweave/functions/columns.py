"""Matrices and vectors as DataFrame columns, and the symbol tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.plans.rules import Matrix

from .features import DIGIT_OF, MARK_OF, SymbolTable


def features_df(spark: SparkSession, table: SymbolTable) -> DataFrame:
    weights = table.weights or [None] * len(table.features)
    return spark.createDataFrame([(i, f, w) for i, (f, w) in enumerate(zip(table.features, weights, strict=True))], "idx int, name string, weight double")


def symbols_df(spark: SparkSession, table: SymbolTable) -> DataFrame:
    return spark.createDataFrame([(s, v, i) for i, (s, v) in enumerate(table.vectors.items())], "symbol string, fv string, ord int")


def implications_df(spark: SparkSession, table: SymbolTable) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in table.implications.items()], "key string, implied array<string>")


def diacritics_df(spark: SparkSession, table: SymbolTable) -> DataFrame:
    return spark.createDataFrame([(i, m, s) for i, (m, s) in enumerate(table.diacritics.items())], "ord int, mark string, specs array<string>")


def matches_matrix(fv: Column, matrix: Matrix, n_features: int) -> Column:
    """Whether a vector has the matrix's values; alpha specs are passed over, as they are before a letter is bound."""
    want = dict(matrix.specs)
    return fv.rlike("^" + "".join({"9": "1"}.get(want.get(i, "."), want.get(i, ".")) for i in range(n_features)) + "$")


def imposed(fv: Column, matrix: Matrix) -> Column:
    """The vector with the matrix's values; 9 takes a value away."""
    for i, v in matrix.specs:
        fv = F.overlay(fv, F.lit("1" if v == "9" else v), i + 1, 1)
    return fv


def feature_value(fv: Column, table: SymbolTable, name: str) -> Column:
    """+, - or 0."""
    return F.translate(F.substring(fv, table.features.index(name) + 1, 1), "".join(MARK_OF), "".join(MARK_OF.values()))


def with_feature(fv: Column, table: SymbolTable, name: str, mark: str) -> Column:
    return F.overlay(fv, F.lit(DIGIT_OF[mark]), table.features.index(name) + 1, 1)


def spelled(fv: Column, table: SymbolTable) -> Column:
    """`+syl -cons ...` without what is unspecified."""
    return F.concat_ws(" ", *(F.when(F.substring(fv, i + 1, 1) == "2", f"+{f}").when(F.substring(fv, i + 1, 1) == "0", f"-{f}") for i, f in enumerate(table.features)))


def printed(fv: Column, table: SymbolTable) -> Column:
    """The known symbol of a vector, or `?`."""
    known = F.create_map(*(F.lit(x) for v, s in table.symbols.items() for x in (v, s)))
    return F.coalesce(F.element_at(known, fv), F.lit("?"))


def morph_spec(specs: Column, name: str) -> Column:
    """A word's value of a morphological feature, from a column map<string,string>; null without one."""
    return F.try_element_at(specs, F.lit(name))


def in_domain(domains: Column, name: str) -> Column:
    """Whether a word is in a domain, from a column array<string>; false for null."""
    return F.coalesce(F.array_contains(domains, name), F.lit(False))
