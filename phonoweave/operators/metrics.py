"""Scores of predicted against observed forms, counts of phones, errors by phone. DataFrame operations, but for FED."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from phonoweave.functions.distance import FeatureDistance, levenshtein, phone_count, symbol_vectors
from phonoweave.functions.features import SymbolTable

from .engine import find_sequence


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def pair_distances(pairs: DataFrame, codes: dict[str, str], pred: str = "pred", gold: str = "gold") -> DataFrame:
    """`pairs` with ld, pred_len, gold_len and ped = ld / gold_len. Rows without both forms have null distances."""
    out = pairs.withColumns({"ld": levenshtein(F.col(pred), F.col(gold), codes), "pred_len": phone_count(F.col(pred), codes), "gold_len": phone_count(F.col(gold), codes)})
    return out.withColumn("ped", ratio(F.col("ld").cast("double"), F.col("gold_len")))


def accuracy(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, acc, acc1, acc2 (distance 0, at most 1, at most 2), avg_ped, and avg_fed if there is fed; over rows with both forms."""
    share = lambda k: F.avg((F.col("ld") <= k).cast("double"))
    more = [F.avg("fed").alias("avg_fed")] if "fed" in pairs.columns else []
    return pairs.where("ld is not null").groupBy(*by).agg(F.count("*").alias("n"), share(0).alias("acc"), share(1).alias("acc1"), share(2).alias("acc2"), F.avg("ped").alias("avg_ped"), *more)


def accuracy_text(row: DataFrame, fed: bool = False) -> DataFrame:
    """(text): the columns of accuracy() in one line with tabs between, eight places each."""
    names = ["acc", "acc1", "acc2", "avg_ped", *(["avg_fed"] if fed else [])]
    return row.select(F.format_string("\t".join(["%.8f"] * len(names)), *names).alias("text"))


_TITLES = {"acc": "exact", "acc1": "within one phone", "acc2": "within two phones", "avg_ped": "mean phone distance", "avg_fed": "mean feature distance"}


def accuracy_report(row: DataFrame) -> DataFrame:
    """(text): one line for each score of an accuracy() table without groups."""
    names = [n for n in _TITLES if n in row.columns]
    return row.select(F.format_string("\n".join(f"{_TITLES[n]:<24}%.8f" for n in names), *names).alias("text"))


def paired_accuracy(pairs: DataFrame, codes: dict[str, str], base: str = "pred", hyp: str = "hyp", gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """accuracy() of two predictions of the same golds in one pass: base_acc, hyp_acc, delta_acc, and so on; n for each side."""
    sides = {"base": base, "hyp": hyp}
    cols = {f"{s}_ld": levenshtein(F.col(c), F.col(gold), codes) for s, c in sides.items()}
    rows = pairs.withColumns(cols).withColumns({f"{s}_ped": ratio(F.col(f"{s}_ld").cast("double"), phone_count(F.col(gold), codes)) for s in sides})
    share = lambda s, k: F.avg((F.col(f"{s}_ld") <= k).cast("double"))
    out = rows.groupBy(*by).agg(*(x for s in sides for x in (F.count(f"{s}_ld").alias(f"{s}_n"), share(s, 0).alias(f"{s}_acc"), share(s, 1).alias(f"{s}_acc1"), share(s, 2).alias(f"{s}_acc2"), F.avg(f"{s}_ped").alias(f"{s}_avg_ped"))))
    return out.withColumns({f"delta_{n}": F.col(f"hyp_{n}") - F.col(f"base_{n}") for n in ("acc", "acc1", "acc2", "avg_ped")})


def comparative(base: DataFrame, hyp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Differences hyp - base of two accuracy() tables. Where both predictions are in one table, paired_accuracy() needs one pass."""
    names = [c for c in base.columns if c in hyp.columns and c not in by and c != "n"]
    b = base.select(*by, *(F.col(c).alias(f"base_{c}") for c in names), F.lit(1).alias("_k"))
    h = hyp.select(*by, *(F.col(c).alias(f"hyp_{c}") for c in names), F.lit(1).alias("_k"))
    return b.join(h, [*by, "_k"]).select(*by, *(F.expr(f"hyp_{c} - base_{c}").alias(f"delta_{c}") for c in names))


def comparative_report(paired: DataFrame) -> DataFrame:
    """(text): one line `score base -> hyp` for each score of a paired_accuracy() table without groups."""
    names = [n for n in _TITLES if f"base_{n}" in paired.columns]
    return paired.select(F.format_string("\n".join(f"{_TITLES[n]:<24}%.8f -> %.8f" for n in names), *(f"{s}_{n}" for n in names for s in ("base", "hyp"))).alias("text"))


def _bare(form: str) -> list[str]:
    return [s for s in form.split() if s not in ("#", "+")]


def with_fed(pairs: DataFrame, table: SymbolTable, distance: FeatureDistance, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """`pairs` with fed alone. Equal forms have 0; others are compared once in a batch, without an alignment."""

    def run(batches):
        for batch in batches:
            keys = [*zip(batch.column(pred).to_pylist(), batch.column(gold).to_pylist(), strict=True)]
            distinct = [k for k in dict.fromkeys(keys) if None not in k and k[0] != k[1]]
            found = dict(zip(distinct, distance.distances([(symbol_vectors(table, a), symbol_vectors(table, b)) for a, b in distinct]).tolist(), strict=True))
            out = [found.get(k, None if None in k else 0.0) for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "fed"])

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("fed", T.DoubleType())]))


def with_alignment(pairs: DataFrame, table: SymbolTable, distance: FeatureDistance, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """`pairs` with fed and alignment: pos, res_sym, gold_sym in order, ∅ for a gap. A form is aligned with itself place by place;
    other pairs are aligned once in a batch."""
    item = pa.struct([("pos", pa.int32()), ("res_sym", pa.string()), ("gold_sym", pa.string())])

    def run(batches):
        for batch in batches:
            keys = [*zip(batch.column(pred).to_pylist(), batch.column(gold).to_pylist(), strict=True)]
            distinct = [k for k in dict.fromkeys(keys) if None not in k and k[0] != k[1]]
            found = {(a, b): (0.0, [{"pos": k, "res_sym": x, "gold_sym": x} for k, x in enumerate(_bare(a))]) for a, b in dict.fromkeys(keys) if a is not None and a == b}
            for (a, b), (d, steps) in zip(distinct, distance.align_many([(symbol_vectors(table, a), symbol_vectors(table, b)) for a, b in distinct]), strict=True):
                x, y = _bare(a), _bare(b)
                found[a, b] = (d, [{"pos": k, "res_sym": x[i] if i >= 0 else "∅", "gold_sym": y[j] if j >= 0 else "∅"} for k, (i, j) in enumerate(steps)])
            out = [found.get(k, (None, None)) for k in keys]
            arrays = [pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "fed", "alignment"])

    kind = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("res_sym", T.StringType()), T.StructField("gold_sym", T.StringType())]))
    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("fed", T.DoubleType()), T.StructField("alignment", kind)]))


def alignments(aligned: DataFrame, key: str = "etym_id") -> DataFrame:
    return aligned.select(key, F.explode("alignment").alias("x")).select(key, "x.*")


# --- phones ------------------------------------------------------------------------------------------------------------------


def phones(df: DataFrame, form: str = "form", *keep: str) -> DataFrame:
    """(keep..., pos, sym): a row for each phone."""
    parts = F.filter(F.split(form, " "), lambda x: ~x.isin("#", "+", ""))
    return df.select(*keep, F.posexplode(parts).alias("pos", "sym"))


def phone_counts(df: DataFrame, form: str = "form") -> DataFrame:
    return phones(df, form).groupBy("sym").agg(F.count("*").alias("n"))


def phone_docfreq(df: DataFrame, form: str = "form") -> DataFrame:
    """In how many words a phone is."""
    parts = F.array_distinct(F.filter(F.split(form, " "), lambda x: ~x.isin("#", "+", "")))
    return df.select(F.explode(parts).alias("sym")).groupBy("sym").agg(F.count("*").alias("n_words"))


def vector_docfreq(df: DataFrame, table: SymbolTable, form: str = "form") -> DataFrame:
    """(fv, n_words): in how many words a phone of a vector is, whatever its symbols; a word counts once for a vector."""
    vectors = F.create_map(*(F.lit(x) for kv in table.vectors.items() for x in kv))
    parts = F.filter(F.split(form, " "), lambda x: ~x.isin("#", "+", ""))
    own = F.array_distinct(F.transform(parts, lambda x: F.element_at(vectors, x)))
    return df.select(F.explode(own).alias("fv")).where("fv is not null").groupBy("fv").agg(F.count("*").alias("n_words"))


def inventory(df: DataFrame, key: str, form: str = "form") -> DataFrame:
    """(sym, rank): phones in the order in which they are first met, by key and position."""
    first = phones(df, form, key).groupBy("sym").agg(F.min(F.struct(key, "pos")).alias("at"))
    return first.select("sym", F.row_number().over(Window.orderBy("at")).alias("rank"))  # as many rows as phones


def has_phone(df: DataFrame, sym: str, form: str = "form") -> DataFrame:
    return df.withColumn("has", F.array_contains(F.split(form, " "), sym))


def sequence_frequency(df: DataFrame, sequence: Sequence[str], form: str = "form") -> DataFrame:
    """How often a run of phones occurs in all words."""
    n, parts = len(sequence), F.filter(F.split(form, " "), lambda x: ~x.isin("#", "+", ""))
    wanted = F.array(*map(F.lit, sequence))
    places = F.when(F.size(parts) >= n, F.size(F.filter(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.slice(parts, i, n) == wanted))).otherwise(0)
    return df.agg(F.sum(places).cast("long").alias("n"))


def errors_by_phone(pairs: DataFrame, side: str) -> DataFrame:
    """For each phone of one side's forms: words, tokens, words in error (ld > 0) and both error rates.

    error_rate is words in error with the phone, of the words with the phone; token_rate of its tokens.
    """
    tokens = F.filter(F.split(side, " "), lambda x: ~x.isin("#", "+", ""))
    counted = F.transform(F.array_distinct(tokens), lambda s: F.struct(s.alias("sym"), F.size(F.filter(tokens, lambda x: x == s)).alias("n")))
    each = pairs.where("ld is not null").select((F.col("ld") > 0).cast("int").alias("bad"), F.explode(counted).alias("x")).select("bad", "x.sym", "x.n")
    out = each.groupBy("sym").agg(F.count("*").alias("n_words"), F.sum("n").cast("long").alias("n_tokens"), F.sum("bad").cast("long").alias("n_errors"))
    return out.withColumn("error_rate", F.col("n_errors") / F.col("n_words")).withColumn("token_rate", F.col("n_errors") / F.col("n_tokens"))


def top_error_phones(errors: DataFrame, k: int = 4) -> DataFrame:
    """The k phones of highest error rate; ties by symbol."""
    return errors.orderBy(F.desc("error_rate"), "sym").limit(k)


def mismatches(pairs: DataFrame, sequence: Sequence[str] = (), side: str = "gold") -> DataFrame:
    """The pairs that differ; with a sequence of symbols, those of which one side's form holds it."""
    out = pairs.where("ld > 0")
    return out.where(find_sequence(F.col(side), sequence) >= 0) if sequence else out


def analysis_file(pairs: DataFrame, side: str = "gold") -> DataFrame:
    """For each phone: error rate, mean distances (raw, by gold length, and of features if there is fed) of the words that have it."""
    syms = F.array_distinct(F.filter(F.split(side, " "), lambda x: ~x.isin("#", "+", "")))
    fed = [F.avg("fed").alias("mean_fed")] if "fed" in pairs.columns else []
    each = pairs.where("ld is not null").select("ld", "ped", *(["fed"] if fed else []), F.explode(syms).alias("sym"))
    return each.groupBy("sym").agg(F.avg((F.col("ld") > 0).cast("double")).alias("error_rate"), F.avg("ld").alias("mean_ld"), F.avg("ped").alias("mean_ped"), *fed)


def etymon_distances(pairs: DataFrame, key: str = "etym_id") -> DataFrame:
    """The eight columns of the table of distances by word."""
    return pairs.select(key, "pred", "gold", "ld", "ped", "fed", "pred_len", "gold_len")
