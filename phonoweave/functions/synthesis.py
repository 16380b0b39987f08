"""Symbols for vectors as a set operation: all the distinct vectors of a run are named at once, by joins.

A vector without a symbol of its own is a known symbol with marks. Which marks agree with the vector is a filter of the
marks; each set of these leaves the features that it does not touch, and on these the base must be the vector. So vectors are
joined with bases on the touched features and on what the others hold. Of all that meet, the fewest marks, then their order
of precedence, then the order of the table decide: the same in every task, as nothing is named there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import DIGIT_OF, MAX_DIACRITICS, SymbolTable, parse_spec

UNNAMED = "?"
_FRONT = "ˈˌ"
#: Features that a 64-bit set can hold.
_BITS = 63


def _sets(vec: str) -> tuple[int, int]:
    """(features of +, features of -) as bits."""
    return tuple(sum(1 << i for i, v in enumerate(vec) if v == want) for want in "20")


def _bits(fv: Column, digit: str, n: int) -> Column:
    return sum((F.when(F.substring(fv, i + 1, 1) == digit, F.lit(1 << i)).otherwise(0).cast("long") for i in range(n)), F.lit(0).cast("long"))


def _marks(table: SymbolTable) -> list[tuple[str, int, int, int]]:
    """(mark, features it touches, those it makes +, those it makes -); one that takes a value away touches alone."""
    out = []
    for mark, specs in table.diacritics.items():
        values = {table.features.index(parse_spec(s)[1]): DIGIT_OF[parse_spec(s)[0]] for s in specs}
        out.append((mark, sum(1 << i for i in values), *(sum(1 << i for i, v in values.items() if v == want) for want in "20")))
    return out


def mark_sets(vectors: DataFrame, table: SymbolTable) -> DataFrame:
    """(fv, plus, minus, marks, mask): each set of up to MAX_DIACRITICS marks, all of which agree with the vector."""
    marks = _marks(table)
    column = lambda k: F.array(*(F.lit(m[k]).cast("long") for m in marks)) if marks else F.array().cast("array<bigint>")
    masks, plus, minus = (column(k) for k in (1, 2, 3))
    agree = lambda i: (F.col("plus").bitwiseAND(F.get(masks, i)) == F.get(plus, i)) & (F.col("minus").bitwiseAND(F.get(masks, i)) == F.get(minus, i))
    numbers = F.array(*(F.lit(i) for i in range(len(marks)))) if marks else F.array().cast("array<int>")
    rows = vectors.select("fv", _bits(F.col("fv"), "2", len(table.features)).alias("plus"), _bits(F.col("fv"), "0", len(table.features)).alias("minus"))
    rows = rows.withColumn("usable", F.filter(numbers, agree)).withColumn("s1", F.transform("usable", lambda i: F.array(i)))
    for n in range(2, MAX_DIACRITICS + 1):
        longer = F.flatten(F.transform(f"s{n - 1}", lambda s: F.transform(F.filter("usable", lambda i: i > F.element_at(s, -1)), lambda i: F.concat(s, F.array(i)))))
        rows = rows.withColumn(f"s{n}", longer)
    each = rows.select("fv", "plus", "minus", F.explode(F.concat(*(f"s{n}" for n in range(1, MAX_DIACRITICS + 1)))).alias("marks"))
    return each.withColumn("mask", F.aggregate("marks", F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.get(masks, i))))


def name_vectors(vectors: DataFrame, table: SymbolTable) -> DataFrame:
    """(fv, symbol) of the distinct vectors of `vectors` (fv): known, or a known symbol with as few marks as give it, or UNNAMED.

    Every mark of a name changes something in its base. The inventory is in the plan; only vectors and their sets of marks
    are rows. Null has no name.
    """
    if len(table.features) > _BITS:
        raise ValueError(f"more than {_BITS} features")
    own = vectors.select("fv").where("fv is not null").distinct()
    known = F.create_map(*(F.lit(x) for kv in table.symbols.items() for x in kv))
    own = own.withColumn("known", F.element_at(known, F.col("fv")))
    sets = mark_sets(own.where("known is null"), table)
    marks = _marks(table)
    plain = [(s, *_sets(v), i) for i, (s, v) in enumerate(table.vectors.items()) if not any(m in s for m in table.diacritics)]
    bases = F.array(*(F.struct(F.lit(s).alias("base"), F.lit(p).cast("long").alias("base_plus"), F.lit(m).cast("long").alias("base_minus"), F.lit(i).alias("place")) for s, p, m, i in plain))
    rest = lambda bits: F.col(bits).bitwiseAND(F.bitwise_not(F.col("mask")))
    left = sets.select("*", rest("plus").alias("rest_plus"), rest("minus").alias("rest_minus"))
    right = sets.select("mask").distinct().select("mask", F.explode(bases).alias("b")).select("mask", "b.*")  # as many masks as sets of marks
    right = right.select("*", rest("base_plus").alias("rest_plus"), rest("base_minus").alias("rest_minus"))
    column = lambda k: F.array(*(F.lit(m[k]).cast("long") for m in marks)) if marks else F.array().cast("array<bigint>")
    masks, plus, minus = (column(k) for k in (1, 2, 3))
    changes = lambda i: (F.col("base_plus").bitwiseAND(F.get(masks, i)) != F.get(plus, i)) | (F.col("base_minus").bitwiseAND(F.get(masks, i)) != F.get(minus, i))
    met = left.join(right, ["mask", "rest_plus", "rest_minus"]).where(F.forall("marks", changes))
    best = met.groupBy("fv").agg(F.min(F.struct(F.size("marks").alias("n"), "marks", "place", "base")).alias("best"))
    signs = F.array(*(F.lit(m[0]) for m in marks)) if marks else F.array().cast("array<string>")
    front = F.array(*map(F.lit, _FRONT))
    side = lambda before: F.array_join(F.filter(F.transform("best.marks", lambda i: F.get(signs, i)), lambda m: F.array_contains(front, m) == before), "")
    named = best.select("fv", F.concat(side(True), F.col("best.base"), side(False)).alias("made"))
    return own.join(named, "fv", "left").select("fv", F.coalesce("known", "made", F.lit(UNNAMED)).alias("symbol"))
