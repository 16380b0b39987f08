"""Where errors come from: confusions, contexts of a filter's matches, and what predicts a miss."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phonoweave.functions.features import MARK_OF, MORPH, WORD, SymbolTable

from .engine import matches

#: Floors of counts and denominators, share that stops the scope, its greatest radius, the score to be exceeded.
PHI_FLOOR, F_FLOOR = 0.5, 0.25
SCOPE_SHARE, MAX_RADIUS, MIN_SCORE = 0.32, 3, 0.1
#: Fixed value: the share of boundaries above which a place is reported to be often at an edge.
EDGE_SHARE = 0.2


def confusions(aligned: DataFrame) -> DataFrame:
    """(res_sym, gold_sym, n): unequal aligned pairs of mismatched words."""
    pairs = aligned.where("ld > 0").select(F.explode("alignment").alias("x")).select("x.res_sym", "x.gold_sym")
    return pairs.where("res_sym <> gold_sym").groupBy("res_sym", "gold_sym").agg(F.count("*").alias("n"))


def top_confusions(counts: DataFrame, k: int = 5) -> DataFrame:
    return counts.orderBy(F.desc("n"), "res_sym", "gold_sym").limit(k)


def confusion_matrix(counts: DataFrame, golds: list[str]) -> DataFrame:
    return counts.groupBy("res_sym").pivot("gold_sym", golds).agg(F.first("n")).na.fill(0)


def confusion_contexts(aligned: DataFrame, res: str, gold: str) -> DataFrame:
    """(offset, sym, n): gold symbols two before to two after a confusion, # beyond the word."""
    golds = F.transform("alignment", lambda x: x["gold_sym"])
    at = aligned.where("ld > 0").select(golds.alias("g"), F.explode("alignment").alias("x")).where((F.col("x.res_sym") == res) & (F.col("x.gold_sym") == gold))
    each = at.select(F.explode(F.array(*(F.struct(F.lit(o).alias("offset"), F.when(F.col("x.pos") + o < 0, "#").otherwise(F.coalesce(F.get("g", F.col("x.pos") + o), F.lit("#"))).alias("sym")) for o in (-2, -1, 1, 2)))).alias("c"))
    return each.select("c.*").groupBy("offset", "sym").agg(F.count("*").alias("n"))


def feature_columns(table: SymbolTable):
    """A map column's entries: symbol to its specs `+f`, `-f`."""
    rows = {s: [MARK_OF[v] + f for f, v in zip(table.features, vec, strict=True) if v in "02"] for s, vec in table.vectors.items()}
    return F.create_map(*(x for s, specs in rows.items() for x in (F.lit(s), F.array(*map(F.lit, specs)) if specs else F.array().cast("array<string>"))))


def constant_features(symbols: DataFrame, table: SymbolTable) -> DataFrame:
    """(spec): the values that every symbol of (sym) has. One aggregation over distinct symbols."""
    each = symbols.select("sym").distinct().withColumn("specs", F.element_at(feature_columns(table), F.col("sym")))
    total = each.agg(F.count("*").alias("total"))
    counted = each.select(F.explode("specs").alias("spec")).groupBy("spec").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(total), F.col("n") == F.col("total")).select("spec")


inactive_features = constant_features


def prognosis(around: DataFrame, table: SymbolTable, share: float = 0.2, suppress: DataFrame | None = None) -> DataFrame:
    """(offset, kind, value, share): what the places around a confusion have in common, of confusion_contexts().

    kind `boundary`: the share of word boundaries, if above EDGE_SHARE; `phone`: symbols of a share above `share`; `constant`:
    the values that all phones of a place have, without those of `suppress` (spec), such as inactive_features() of all words.
    """
    total = Window.partitionBy("offset")  # as many rows as symbols
    own = around.withColumn("share", F.col("n") / F.sum("n").over(total))
    edges = own.where((F.col("sym") == WORD) & (F.col("share") > EDGE_SHARE)).select("offset", F.lit("boundary").alias("kind"), F.col("sym").alias("value"), "share")
    phones = own.where(~F.col("sym").isin(WORD, MORPH, "∅"))
    often = phones.where(F.col("share") > share).select("offset", F.lit("phone").alias("kind"), F.col("sym").alias("value"), "share")
    specs = phones.withColumn("of", F.count("*").over(total)).select("offset", "of", F.explode(F.element_at(feature_columns(table), F.col("sym"))).alias("value"))
    constant = specs.groupBy("offset", "of", "value").agg(F.count("*").alias("n")).where("n = of")
    if suppress is not None:
        constant = constant.join(F.broadcast(suppress.select(F.col("spec").alias("value"))), "value", "left_anti")  # as many as features at most
    return edges.unionByName(often).unionByName(constant.select("offset", F.lit("constant").alias("kind"), "value", F.lit(1.0).alias("share")))


def without_active(specs: list[str], symbols: DataFrame, table: SymbolTable) -> DataFrame:
    """(spec): those of the given specs that no symbol of (sym) has."""
    given = symbols.sparkSession.createDataFrame([(x,) for x in specs], "spec string")
    active = symbols.select("sym").distinct().select(F.explode(F.element_at(feature_columns(table), F.col("sym"))).alias("spec"))
    return given.join(active, "spec", "left_anti")


def subsample(pairs: DataFrame, pivots: DataFrame | None, table: SymbolTable, items: tuple, key: str = "etym_id") -> DataFrame:
    """Rows of `pairs` (key, ld, ...) whose form has a match: with form, bounds and miss (ld > 0).

    The form is that of `pivots` (key, form), or a column of the rows themselves, which then stay where they are. Rows without
    a distance are neither hits nor misses and stay out.
    """
    rows = pairs.where("ld is not null")
    if pivots is None:
        return matches(rows.drop("bounds"), table, items).where("size(bounds) > 0").withColumn("miss", F.col("ld") > 0)
    found = matches(pivots.select(key, "form"), table, items).where("size(bounds) > 0")
    return rows.drop("form", "bounds").join(found, key).withColumn("miss", F.col("ld") > 0)


def contexts(matched: DataFrame, table: SymbolTable, offsets: list[int], form: str = "form", weight: str | None = None) -> DataFrame:
    """(miss, rel_pos, sym, preds, n): what stands at each relative place of the matches, counted.

    Offset -1 is the element before a match, 1 the one after. Predictors are `±f` and the symbol of a phone, or a boundary.
    Places beyond the word are left out. `matched` has miss (boolean) and bounds; a row counts once, or `weight` times.
    """
    each = F.filter(F.split(form, r"\s+"), lambda x: x != "")
    edge = F.array(F.lit(WORD))
    inner = F.when(F.get(each, 0) == WORD, each).otherwise(F.concat(edge, each))
    word = F.when((F.get(inner, F.size(inner) - 1) == WORD) & (F.size(inner) > 1), inner).otherwise(F.concat(inner, edge))
    own = matched.where("size(bounds) > 0").select("miss", (F.col(weight) if weight else F.lit(1)).cast("long").alias("n"), word.alias("word"), "bounds")
    place = lambda b, o: F.struct(F.lit(o).alias("rel_pos"), ((b["start"] if o < 0 else b["end"] - 1) + o).alias("at"))
    places = F.flatten(F.transform("bounds", lambda b: F.array(*(place(b, o) for o in offsets))))
    near = own.select("miss", "n", "word", F.explode(F.filter(places, lambda x: (x["at"] >= 0) & (x["at"] < F.size("word")))).alias("x"))
    counted = near.groupBy("miss", F.col("x.rel_pos").alias("rel_pos"), F.get("word", F.col("x.at")).alias("sym")).agg(F.sum("n").alias("n"))
    specs = F.coalesce(F.element_at(feature_columns(table), F.col("sym")), F.array().cast("array<string>"))
    return counted.select("miss", "rel_pos", "sym", F.concat(F.array("sym"), specs).alias("preds"), "n")


def contingency(ctx: DataFrame) -> DataFrame:
    """(rel_pos, predictor, n11, n10, n01, n00): the first figure says whether the predictor holds, the second whether it is a miss.

    Symbols are added up first, so that what is spread over predictors has a row for each symbol of the inventory. A place's
    totals are a window over these rows: joined to them, they would have the matches found and counted a second time.
    """
    miss, hit = F.sum(F.when(F.col("miss"), F.col("n")).otherwise(0)), F.sum(F.when(~F.col("miss"), F.col("n")).otherwise(0))
    by_sym = ctx.groupBy("rel_pos", "sym", "preds").agg(miss.alias("m"), hit.alias("h"))
    place = Window.partitionBy("rel_pos")  # as many rows as symbols
    of_all = by_sym.select("rel_pos", "preds", "m", "h", F.sum("m").over(place).alias("misses"), F.sum("h").over(place).alias("hits"))
    each = of_all.select("rel_pos", "m", "h", "misses", "hits", F.explode("preds").alias("predictor"))
    held = each.groupBy("rel_pos", "predictor", "misses", "hits").agg(F.sum("m").alias("n11"), F.sum("h").alias("n10"))
    return held.select("rel_pos", "predictor", "n11", "n10", F.expr("misses - n11").alias("n01"), F.expr("hits - n10").alias("n00"))


def phi(n00: Column, n10: Column, n01: Column, n11: Column, floor: float = PHI_FLOOR) -> Column:
    """Matthews' correlation of a 2 by 2 table. All counts but n11 are at least the floor."""
    a, b, c, d = F.greatest(n00.cast("double"), F.lit(floor)), F.greatest(n10.cast("double"), F.lit(floor)), F.greatest(n01.cast("double"), F.lit(floor)), n11.cast("double")
    under = F.sqrt((d + b) * (d + c) * (a + b) * (a + c))
    return F.when(under > 0, (d * a - b * c) / under).otherwise(0.0)


def f_beta(n10: Column, n01: Column, n11: Column, beta: float = 1.0, floor: float = F_FLOOR) -> Column:
    """F-beta of a predictor for misses, 0 where precision and recall are."""
    d = n11.cast("double")
    p, r = d / F.greatest((n10 + n11).cast("double"), F.lit(floor)), d / F.greatest((n01 + n11).cast("double"), F.lit(floor))
    return F.when(p + r == 0, 0.0).otherwise((1 + beta * beta) * p * r / (beta * beta * p + r))


def scored(table: DataFrame, mode: str = "phi") -> DataFrame:
    """contingency() with score: phi, f, or f and a beta as in f2 or f0.5."""
    n = {k: F.col(k) for k in ("n11", "n10", "n01", "n00")}
    if mode == "phi":
        return table.withColumn("score", phi(n["n00"], n["n10"], n["n01"], n["n11"]))
    if not mode.startswith("f"):
        raise ValueError(f"no score {mode!r}")
    return table.withColumn("score", f_beta(n["n10"], n["n01"], n["n11"], float(mode[1:] or 1)))


def predictor_kind(predictor: Column) -> Column:
    return F.when(predictor.isin(WORD, MORPH), "bound").when(predictor.rlike(r"^[+-]\w"), "feature").otherwise("phone")


def top_predictors(scores: DataFrame, n: int = 5) -> DataFrame:
    """For each place, the n best predictors and the best of each kind, all of a score above MIN_SCORE."""
    kind = scores.withColumn("kind", predictor_kind(F.col("predictor")))
    order = [F.desc("score"), F.asc("predictor")]
    ranked = kind.withColumn("rank", F.row_number().over(Window.partitionBy("rel_pos").orderBy(*order))).withColumn("kind_rank", F.row_number().over(Window.partitionBy("rel_pos", "kind").orderBy(*order)))
    return ranked.where((F.col("score") > MIN_SCORE) & ((F.col("rank") <= n) | (F.col("kind_rank") == 1)))


def scope(matched: DataFrame, lengths: str = "length", by: Sequence[str] = ()) -> DataFrame:
    """(by..., side, radius): how far to look on each side (s before a match, e after it), for each group, in one job.

    A side is widened from 1 until over SCOPE_SHARE of the rows have a match that begins (ends) so near the word's edge, or
    else to MAX_RADIUS + 1. Counts by radius are summed up by a running window; rows without a
    match count among the rows.
    """
    def near(side: str, place: Callable[[Column], Column]) -> Column:
        places = F.transform("bounds", place)
        return F.array(*(F.struct(F.lit(side).alias("side"), F.lit(r).alias("r"), F.size(F.filter(places, lambda x: x == F.lit(r))).cast("long").alias("n")) for r in range(MAX_RADIUS + 1)))  # noqa: B023

    each = F.concat(near("s", lambda b: b["start"]), near("e", lambda b: F.col(lengths) - b["end"]))
    counts = matched.select(*by, F.explode(each).alias("x")).groupBy(*by, "x.side", "x.r").agg(F.sum("x.n").alias("n"), F.count("*").alias("total"))
    running = Window.partitionBy(*by, "side").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)  # a row a radius
    reached = counts.withColumn("seen", F.sum("n").over(running)).withColumn("enough", (F.col("r") > 0) & (F.col("seen") / F.col("total") > SCOPE_SHARE))
    return reached.groupBy(*by, "side").agg(F.coalesce(F.min(F.when(F.col("enough"), F.col("r"))), F.lit(MAX_RADIUS + 1)).alias("radius"))


def autopsy_scope(matched: DataFrame, lengths: str = "length") -> tuple[int, int]:
    """scope() without groups as relative places (before, after); (-1, 1) without rows."""
    found = {r.side: r.radius for r in scope(matched, lengths).collect()}  # two rows
    return -found.get("s", 1), found.get("e", 1)


def contexts_in_scope(matched: DataFrame, table: SymbolTable, lengths: str = "length", form: str = "form") -> DataFrame:
    """contexts() as far as scope() reaches on each side, planned in one: the scope is a join of two rows, not a number."""
    ctx = contexts(matched, table, [o for o in range(-MAX_RADIUS - 1, MAX_RADIUS + 2) if o], form)
    side = F.when(F.col("rel_pos") < 0, "s").otherwise("e")
    return ctx.withColumn("side", side).join(F.broadcast(scope(matched, lengths)), "side").where("abs(rel_pos) <= radius").drop("side", "radius")


def subset_shares(df: DataFrame, inside: Column, miss: Column) -> DataFrame:
    """Share of the rows that are inside, and of the misses that are."""
    both = df.agg(F.count("*").alias("n"), F.count_if(inside).alias("n_in"), F.count_if(miss).alias("n_miss"), F.count_if(inside & miss).alias("n_in_miss"))
    return both.select("*", F.when(F.col("n") > 0, F.col("n_in") / F.col("n")).alias("share"), F.when(F.col("n_miss") > 0, F.col("n_in_miss") / F.col("n_miss")).alias("error_share"))
