"""Runs a cascade over tables of words: one narrow Arrow stage, whatever the number of rules.

Equal forms are rewritten once in a task; the compiled cascade goes to the executors with the stage. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoweave.functions.features import WORD, Seg, SymbolTable, show
from phonoweave.plans.bounds import bounds, bounds_regex, codes_of, whole
from phonoweave.plans.kernel import Kernel
from phonoweave.plans.rules import Group, Rule, match_bounds
from phonoweave.sources.readers import ABSENT, ABSENT_S, BLACK, GOLD, PRESENT_S, UNATTESTED, UNATTESTED_S, Cascade

#: Forms that a task remembers, as many as a batch has rows; when there are more, all are forgotten. Longer ones are not kept.
CACHE, CACHE_CHARS = 10_000, 256
STEP = T.StructType([T.StructField("rule_idx", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("after", T.StringType())])
STAGE = T.StructType([T.StructField(n, t) for n, t in (("seq", T.IntegerType()), ("stage", T.StringType()), ("type", T.StringType()), ("form", T.StringType()), ("status", T.StringType()))])
_STEP_PA = pa.struct([("rule_idx", pa.int32()), ("before", pa.string()), ("after", pa.string())])
_STAGE_PA = pa.struct([("seq", pa.int32()), ("stage", pa.string()), ("type", pa.string()), ("form", pa.string()), ("status", pa.string())])


def bare(word: Sequence[Seg]) -> str:
    """The form without the word boundaries at its ends."""
    return show(word[1:-1] if len(word) > 1 and word[0].sym == word[-1].sym == WORD else word)


def letters(column):
    """The form of a plain word: its characters, with blanks between."""
    return F.array_join(F.split(column, ""), " ")


def _appended(batch: pa.RecordBatch, arrays: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])


def _each_form(made):
    """`made` of each form, once for equal forms while they are remembered; null stays null."""
    seen: dict = {}

    def of(forms: pa.Array) -> list:
        nonlocal seen
        out = []
        for f in forms.to_pylist():
            got = None if f is None else seen.get(f)
            if got is None and f is not None:
                got = made(f)
                if len(f) <= CACHE_CHARS:
                    if len(seen) >= CACHE:
                        seen = {}
                    seen[f] = got
            out.append(got)
        return out

    return of


def apply_cascade(df: DataFrame, cascade: Cascade, form: str = "form", rules: tuple[int, int] | None = None, stops: Sequence[int] = (), log: bool = False, tried: Accumulator | None = None) -> DataFrame:
    """`df` with outcome, and snaps (forms before the rules in `stops`) and log (steps that changed the form) if asked for.

    `rules` is the range [lo, hi) to run; all by default. Null stays null. A symbol that the table cannot read is an error.
    `tried` counts the rules of each form that is run.
    """
    lo, hi = rules or (0, len(cascade.rules))
    own, table, places = cascade.rules[lo:hi], cascade.table, [s - lo for s in stops]
    fields = [T.StructField("outcome", T.StringType())]
    fields += [T.StructField("snaps", T.ArrayType(T.StringType()))] if places else []
    fields += [T.StructField("log", T.ArrayType(STEP))] if log else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(table)

        def made(f: str) -> tuple:
            word, steps, snaps = kernel.run(own, table.word(f), places)
            if tried is not None:
                tried.add(len(own))
            return bare(word), [bare(s) for s in snaps], steps_of(steps, lo) if log else None

        of = _each_form(made)
        for batch in batches:
            out = [(None, None, None) if o is None else o for o in of(batch.column(form))]
            arrays = [pa.array([o[0] for o in out], pa.string())]
            arrays += [pa.array([o[1] for o in out], pa.list_(pa.string()))] if places else []
            arrays += [pa.array([o[2] for o in out], pa.list_(_STEP_PA))] if log else []
            yield _appended(batch, arrays, [x.name for x in fields])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def steps_of(steps: list, lo: int = 0) -> list[dict]:
    """The kernel's steps as rows of STEP; `lo` is the number of its first rule."""
    return [{"rule_idx": k + lo, "before": bare(a), "after": bare(b)} for k, a, b in steps]


def apply_many(df: DataFrame, cascades: dict[str, Cascade], form: str = "form") -> DataFrame:
    """`df` with the outcome of each cascade, in a column of its name: one Arrow stage for all. Their tables must be one."""
    table, own = next(iter(cascades.values())).table, [c.rules for c in cascades.values()]

    def run(batches):
        kernel = Kernel(table)

        def made(f: str) -> list[str]:
            word = table.word(f)
            return [bare(kernel.run(rules, word)[0]) for rules in own]

        of = _each_form(made)
        for batch in batches:
            out = of(batch.column(form))
            yield _appended(batch, [pa.array([None if o is None else o[i] for o in out], pa.string()) for i in range(len(own))], [*cascades])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, T.StringType()) for n in cascades)]))


def simulate_lexicon(lexicon: DataFrame, cascade: Cascade, gold_columns: Sequence[int] = ()) -> DataFrame:
    """`lexicon` (etym_id, cells, ...) with outcome, status, stages (a form for each stage) and log.

    The first cell is the input. At a gold stage with a column, a word that is absent comes in with the gold form, and a word
    whose gold is absent goes; unattested golds change nothing. Stages at one place keep their order. An absent word has
    no form and no steps.
    """
    rules, table, stages = cascade.rules, cascade.table, cascade.stages
    golds = iter(gold_columns)
    columns = [next(golds, None) if s.kind == "g" else None for s in stages]
    bounds = [0, *(s.instant for s in stages), len(rules)]
    parts = [rules[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]  # between stages

    def one(kernel: Kernel, cells: list[str]) -> dict:
        word = None if cells[0] in (*ABSENT, *UNATTESTED) else table.word(cells[0])
        at, log, out = 0, [], []
        for seq, (stage, column) in enumerate(zip(stages, columns, strict=True)):
            if word is not None:
                word, steps, _ = kernel.run(parts[seq], word)
                log += [(k + at, a, b) for k, a, b in steps]
            at = stage.instant
            out.append({"seq": seq, "stage": stage.name, "type": stage.kind, "form": None if word is None else bare(word), "status": ABSENT_S if word is None else PRESENT_S})
            if column is not None:
                gold = cells[column]
                if gold in ABSENT:
                    word = None
                elif word is None and gold not in UNATTESTED:
                    word = table.word(gold)
        if word is not None:
            word, steps, _ = kernel.run(parts[-1], word)
            log += [(k + at, a, b) for k, a, b in steps]
        return {"outcome": None if word is None else bare(word), "status": ABSENT_S if word is None else PRESENT_S, "stages": out, "log": steps_of(log)}

    def run(batches):
        kernel = Kernel(table)
        for batch in batches:
            got = [one(kernel, c) for c in batch.column("cells").to_pylist()]
            kinds = (("outcome", pa.string()), ("status", pa.string()), ("stages", pa.list_(_STAGE_PA)), ("log", pa.list_(_STEP_PA)))
            yield _appended(batch, [pa.array([g[n] for g in got], t) for n, t in kinds], [n for n, _ in kinds])

    added = [T.StructField("outcome", T.StringType()), T.StructField("status", T.StringType()), T.StructField("stages", T.ArrayType(STAGE)), T.StructField("log", T.ArrayType(STEP))]
    return lexicon.mapInArrow(run, T.StructType([*lexicon.schema.fields, *added]))


def gold_status(cell):
    return F.when(cell.isin(*ABSENT), ABSENT_S).when(cell.isin(*UNATTESTED), UNATTESTED_S).otherwise(PRESENT_S)


def derivation(run: DataFrame, key: str = "etym_id") -> DataFrame:
    """(key, rule_idx, before, after): a row for each change."""
    return run.select(key, F.explode("log").alias("x")).select(key, "x.*")


def snapshots(run: DataFrame, key: str = "etym_id") -> DataFrame:
    """(key, seq, stage, type, form, status)."""
    return run.select(key, F.explode("stages").alias("x")).select(key, "x.*")


def with_stage(steps: DataFrame, cascade: Cascade) -> DataFrame:
    """`steps` with stage: the name of the last stage at or before the rule, or Input. The stages are in the plan; nothing is joined."""
    stages = F.array(*(F.struct(F.lit(s.instant).alias("instant"), F.lit(s.name).alias("name")) for s in cascade.stages))
    if not cascade.stages:
        return steps.withColumn("stage", F.lit("Input"))
    before = F.filter(stages, lambda s: s["instant"] <= F.col("rule_idx"))
    return steps.withColumn("stage", F.coalesce(F.get(before, F.size(before) - 1)["name"], F.lit("Input")))


def rule_effects(steps: DataFrame, key: str = "etym_id") -> DataFrame:
    """For each rule that changed something: the number of words changed, the least changed word's key."""
    return steps.groupBy("rule_idx").agg(F.countDistinct(key).alias("n_changed"), F.min(key).alias("first_key"))


def derivation_text(run: DataFrame, cascade: Cascade, key: str = "etym_id", start=None) -> DataFrame:
    """(key, derivation): the input, a line `form | rule : its text` for each change, `stage : form` for each stage, the result.

    `start` is the column of input forms, the first cell by default. An absent word's form is the mark of absence. Lines of
    one instant stay in order: a stage comes after the rule before it.
    """
    start = F.col("cells")[0] if start is None else start
    texts = F.array(*(F.lit(str(r)) for r in cascade.rules))
    instants = F.array(*(F.lit(s.instant) for s in cascade.stages))
    line = lambda at, kind, seq, text: F.struct(at.alias("at"), F.lit(kind).alias("kind"), seq.alias("seq"), text.alias("line"))
    form = lambda c: F.coalesce(c, F.lit(ABSENT[0]))
    rules = F.transform("log", lambda x: line(x["rule_idx"] + 1, 0, x["rule_idx"], F.concat(x["after"], F.lit(" | "), x["rule_idx"].cast("string"), F.lit(" : "), F.get(texts, x["rule_idx"]))))
    stages = F.transform("stages", lambda x: line(F.get(instants, x["seq"]), 1, x["seq"], F.concat(x["stage"], F.lit(" : "), form(x["form"]))))
    lines = F.transform(F.array_sort(F.concat(rules, stages)), lambda x: x["line"])
    return run.select(key, F.array_join(F.concat(F.array(form(start)), lines, F.array(form(F.col("outcome")))), "\n").alias("derivation"))


def stage_graph(run: DataFrame, cascade: Cascade, key: str = "etym_id") -> DataFrame:
    """One row for each word of simulate_lexicon(), one column for each stage: where the row is, without a shuffle."""
    return run.select(key, *(F.col("stages")[i]["form"].alias(s.name) for i, s in enumerate(cascade.stages)))


def stage_report(run: DataFrame, cascade: Cascade, gold_columns: Sequence[int] = (), output: int | None = None, key: str = "etym_id") -> DataFrame:
    """(key, Input, a column for each stage, Output); beside a form that is compared, its gold as `form {GOLD: gold}`. No shuffle."""
    golds = iter(gold_columns)
    form = lambda c: F.coalesce(c, F.lit(ABSENT[0]))
    beside = lambda c, at: form(c) if at is None else F.concat(form(c), F.lit(" {GOLD: "), F.col("cells")[at], F.lit("}"))
    columns = [beside(F.col("stages")[i]["form"], next(golds, None) if s.kind == "g" else None).alias(s.name) for i, s in enumerate(cascade.stages)]
    return run.select(key, F.col("cells")[0].alias("Input"), *columns, beside(F.col("outcome"), output).alias("Output"))


def rule_graph(steps: DataFrame, keys: Sequence[int], key: str = "etym_id") -> DataFrame:
    """One row for each rule, one column for each of the given words, empty where a word is unchanged."""
    return steps.where(F.col(key).isin(*keys)).groupBy("rule_idx").pivot(key, list(keys)).agg(F.first("after"))


def rule_report(run: DataFrame, cascade: Cascade, key: str = "etym_id") -> DataFrame:
    """(ord, label, key, form): the input, what each rule makes of a word, and each stage, in order; no row for a word that a
    rule leaves as it is. Labels are INPUT, R and the rule's number, and a stage's flag and name; pivot() on the key of a few
    words makes columns of them. A word that comes in at a stage has `+ ` before its form."""
    n = len(cascade.stages)
    instants, flags = F.array(*(F.lit(s.instant) for s in cascade.stages)), F.array(*(F.lit((GOLD if s.kind == "g" else BLACK) + s.name) for s in cascade.stages))
    place = lambda instant, seq: (instant * (n + 1) + seq).cast("int")  # noqa: E731  rules of an instant, then its stages
    row = lambda at, label, form: F.struct(at.alias("ord"), label.alias("label"), form.alias("form"))
    form = lambda c: F.coalesce(c, F.lit(ABSENT[0]))
    first = F.array(row(F.lit(-1), F.lit("INPUT"), F.col("cells")[0]))
    rules = F.transform("log", lambda x: row(place(x["rule_idx"] + 1, F.lit(0)), F.concat(F.lit("R"), x["rule_idx"].cast("string")), x["after"]))
    came = lambda x: (x["seq"] > 0) & F.get(F.col("stages"), x["seq"] - 1)["form"].isNull() & x["form"].isNotNull()
    stages = F.transform("stages", lambda x: row(place(F.get(instants, x["seq"]), x["seq"] + 1), F.get(flags, x["seq"]), F.concat(F.when(came(x), "+ ").otherwise(""), form(x["form"]))))
    return run.select(key, F.explode(F.concat(first, rules, stages)).alias("x")).select("x.ord", "x.label", key, "x.form")


def changed_words(steps: DataFrame, rule: int, key: str = "etym_id") -> DataFrame:
    """(key, before, after) of the words that one rule changed."""
    return steps.where(F.col("rule_idx") == rule).select(key, "before", "after")


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """`df` with a column that is made here, once a row, however often it is used: it comes out of a generator.

    A condition on a column of a projection is moved down with what the column is made of, through a grouping by the words to
    all the places that they stand at, and is worked out there again.
    """
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def matches(df: DataFrame, table: SymbolTable, items: tuple, form: str = "form") -> DataFrame:
    """`df` with bounds: [start, end) of each match of the context elements in the form with its word boundaries.

    Columns only: the elements become one regular expression. The few patterns that none can express go to the matcher. Null
    has no bounds; symbols of the forms must be in the table. A form is coded and searched once for each row of `df`.
    """
    codes = codes_of(table)
    if (regex := bounds_regex(items, table, codes)) is not None:
        coded = _once(df, "_coded", whole(F.col(form), codes))
        return _once(coded, "bounds", bounds(F.col("_coded"), regex)).drop("_coded")
    return matches_by_walking(df, table, items, form)


def matches_by_walking(df: DataFrame, table: SymbolTable, items: tuple, form: str = "form") -> DataFrame:
    """matches() by the matcher of rules, element by element, in Python."""

    def run(batches):
        for batch in batches:
            out = [None if f is None else [{"start": a, "end": b} for a, b in match_bounds(items, table.word(f))] for f in batch.column(form).to_pylist()]
            yield _appended(batch, [pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], ["bounds"])

    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("bounds", kind)]))


def filter_words(df: DataFrame, table: SymbolTable, items: tuple, form: str = "form") -> DataFrame:
    """The rows whose form has a match, which is never empty."""
    codes = codes_of(table)
    regex = bounds_regex(items, table, codes)
    if regex is not None and not all(isinstance(x, Group) for x in items):
        return _once(df, "_coded", whole(F.col(form), codes)).where(F.col("_coded").rlike(regex)).drop("_coded")
    return matches(df, table, items, form).where(F.size("bounds") > 0).drop("bounds")


def find_sequence(form, sequence: Sequence[str], last: bool = False):
    """Index of the first (last) place of a run of symbols in a space-delimited form, or -1."""
    parts, n = F.split(form, " "), len(sequence)
    wanted = F.array(*map(F.lit, sequence))
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - n, F.lit(0))), lambda i: F.slice(parts, i + 1, n) == wanted)
    return F.coalesce(F.get(places, F.size(places) - 1 if last else F.lit(0)), F.lit(-1))


def word_lookup(df: DataFrame, form: str, query: str, key: str = "etym_id") -> DataFrame:
    """(key): a row for each row of a form."""
    return df.where(F.col(form) == query).select(key)


def kernel_once(rule: Rule, table: SymbolTable, text: str) -> str:
    """One rule on one word, for trying things out."""
    return show(Kernel(table).apply(rule, tuple(table.phone(s) for s in text.split())))
