"""Queries over the driver's tables, and the same in SQL. Letters of plain words stand in for phones."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions import columns
from phonoweave.functions.distance import FeatureDistance, symbol_codes
from phonoweave.functions.inventory import letter_table, phonetic_table
from phonoweave.functions.synthesis import name_vectors
from phonoweave.operators import bitmaps, diagnose, engine, metrics, stages, tiles, whatif
from phonoweave.plans.rules import RuleParser
from phonoweave.sources import lines
from phonoweave.sources.readers import Cascade, read_cascade, read_lexicon
from phonoweave.sources.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
#: A rule, and what does the same in SQL: (pattern, replacement) pairs, one after the other.
Step = tuple[str, list[tuple[str, str]]]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_WORDS_SQL = "words AS (SELECT DISTINCT unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS word FROM documents), w AS (SELECT word FROM words WHERE word <> '')"
def _split_words(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """A row for each word of a text. Only A-Z are lower-cased: words have no other letters, so that it is done to them, not to the text."""
    found = df.select(*keep, F.explode(F.split(column, "[^A-Za-z]+")).alias("word")).where("word <> ''")
    return found.withColumn("word", F.lower("word"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, form): the distinct plain words of all documents."""
    return _split_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text").distinct().withColumn("form", engine.letters(F.col("word")))


def _plain(column: str):
    return F.replace(F.col(column), F.lit(" "), F.lit(""))


@lru_cache
def cascade(*lines: str) -> Cascade:
    return read_cascade(list(lines), letter_table())


def _sql_of(expr: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, new in pairs:
        expr = f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"
    return expr


def _chain(steps: list[Step], source: str = "w", column: str = "word") -> str:
    """CTEs c0, c1, ...: each step's form, all kept: f0 is the word, f1 what the first rule makes of it, and so on."""
    out = [f"c0 AS (SELECT {column} AS word, {column} AS f0 FROM {source})"]
    for i, (_, pairs) in enumerate(steps):
        out.append(f"c{i + 1} AS (SELECT *, {_sql_of(f'f{i}', pairs)} AS f{i + 1} FROM c{i})")
    return ", ".join(out)


def _register_cascade(name: str, steps: list[Step]) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine.apply_cascade(words(spark, sf_dir), cascade(*(s for s, _ in steps)))
        return out.select("word", _plain("outcome").alias("outcome"))

    QUERIES[name] = query
    SQL[name] = f"WITH {_WORDS_SQL}, {_chain(steps)} SELECT word, f{len(steps)} AS outcome FROM c{len(steps)}"


def _each(chars: str, to: str) -> list[tuple[str, str]]:
    return list(zip(chars, to, strict=True))


LITERAL: list[Step] = [
    ("p h > f", [("ph", "f")]),
    ("q u > k w", [("qu", "kw")]),
    ("c > k / __ a", [("c(a)", r"k\1")]),
    ("t h > d", [("th", "d")]),
    ("s > z / n __", [("(n)s", r"\1z")]),
]
INSERT: list[Step] = [("∅ > e / # __ s t", [("^(st)", r"e\1")]), ("∅ > b / m __ r", [("m(r)", r"mb\1")])]
DELETE: list[Step] = [("h > ∅", [("h", "")]), ("e > ∅ / __ #", [("e$", "")])]
FEATURES: list[Step] = [
    ("[-voi,+cor] > [+voi]", [("t", "d"), ("s", "z"), ("c", "j")]),
    ("[-voi,+lab] > [+voi] / __ [+syl]", [("p([aeiou])", r"b\1"), ("f([aeiou])", r"v\1")]),
]
STAR: list[Step] = [("a > e / __ ( [-syl] )* i", [("a([^aeiou]*i)", r"e\1")])]
OPTIONAL: list[Step] = [("a > o / __ ( r ) t", [("a(r?t)", r"o\1")])]
PLUS: list[Step] = [("o > u / # ( [-syl] )+ __", [("^([^aeiou]+)o", r"\1u")])]
ALPHA: list[Step] = [("[+nas] > [αlab,βcor] / __ [-son,-dor,-lo,αlab,βcor]", [("[mn]([pbfv])", r"m\1"), ("[mn]([tdszcj])", r"n\1")])]
CONTEXTS: list[Step] = [("e > i / {r;l} __ {n;t}", [("(r)e(n)", r"\1i\2"), ("(r)e(t)", r"\1i\2"), ("(l)e(n)", r"\1i\2"), ("(l)e(t)", r"\1i\2")])]
SWAP: list[Step] = [("{t;d;k} > {d;t;g}", [("t", "0"), ("d", "t"), ("0", "d"), ("k", "g")])]
RUN: list[Step] = [("[+nas] [+nas] > n", [("[mn][mn]", "n")])]
EACH: list[Step] = [("[-voi,+lab] t > ∅ [+voi]", [("[pf]t", "d")])]

for _name, _steps in {
    "cascade_literal": LITERAL,
    "cascade_insert": INSERT,
    "cascade_delete": DELETE,
    "cascade_disjunct": SWAP,
    "cascade_feature_class": FEATURES,
    "cascade_star_context": STAR,
    "cascade_plus_context": PLUS,
    "cascade_optional_context": OPTIONAL,
    "cascade_context_disjunction": CONTEXTS,
    "cascade_alpha": ALPHA,
    "cascade_matrix_run": RUN,
    "cascade_slotwise": EACH,
}.items():
    _register_cascade(_name, _steps)


FOLDED: list[Step] = [("{t;k} > [+voi] / [+nas] __", [("([mn])t", r"\1d"), ("([mn])k", r"\1g")])]
RUN_ALPHA: list[Step] = [("[-son,αvoi] [-son,αvoi] > x", [("[bdgvzj][bdgvzj]|[ptkfschqx][ptkfschqx]", "x")])]
EACH_ALPHA: list[Step] = [("[-son,+cor,-cont,-strid,αvoi] [+nas] > [!αvoi] [+nas]", [("t([mn])", r"0\1"), ("d([mn])", r"t\1"), ("0", "d")])]

for _name, _steps in {"cascade_folded": FOLDED, "cascade_matrix_run_alpha": RUN_ALPHA, "cascade_slotwise_alpha": EACH_ALPHA}.items():
    _register_cascade(_name, _steps)


def register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def long_steps(n: int) -> list[Step]:
    """As many rules of one phone after another as are asked for, made by a fixed rule: what a long cascade costs."""
    abc, out = "abcdefghijklmnopqrstuvwxyz", []
    for i in range(n):
        source, context, dest = (abc[(k * i + i // 26 + k) % 26] for k in (7, 11, 5))
        context = context if context != source else abc[(abc.index(source) + 1) % 26]
        dest = dest if dest != source else abc[(abc.index(source) + 2) % 26]
        out.append((f"{source} > {dest} / {context} __", [(f"({context}){source}", rf"\1{dest}")]))
    return out


def _long_sql(n: int) -> str:
    steps = ", ".join(f"c{i + 1} AS (SELECT word, {_sql_of('f', p)} AS f FROM c{i})" for i, (_, p) in enumerate(long_steps(n)))
    return f"WITH {_WORDS_SQL}, c0 AS (SELECT word, word AS f FROM w), {steps} SELECT word, f AS outcome FROM c{n}"


@register("cascade_100", _long_sql(100))
def cascade_100(spark, sf_dir):
    out = engine.apply_cascade(words(spark, sf_dir), cascade(*(s for s, _ in long_steps(100))))
    return out.select("word", _plain("outcome").alias("outcome"))


_VOICED, _VOICELESS = "bdgjlmnrvwyz", "cfhkpqstx"


@register(
    "cascade_phone_alpha",
    f"WITH {_WORDS_SQL}, c AS (SELECT word, translate(word, '{_VOICED}{_VOICELESS}aeiou', '{'v' * len(_VOICED)}{'u' * len(_VOICELESS)}-----') AS k FROM w) "
    "SELECT word, array_to_string(list_transform(range(1, length(word) + 1), lambda i: CASE WHEN substr(word, i, 1) = 'a' AND i > 1 AND substr(k, i - 1, 1) = substr(k, i + 1, 1) AND substr(k, i + 1, 1) IN ('v', 'u') THEN 'e' ELSE substr(word, i, 1) END), '') AS outcome FROM c",
)
def cascade_phone_alpha(spark, sf_dir):
    """A phone between consonants that agree in voice."""
    out = engine.apply_cascade(words(spark, sf_dir), cascade("a > e / [αvoi,-syl] __ [αvoi,-syl]"))
    return out.select("word", _plain("outcome").alias("outcome"))


_COMPOUND = "CASE WHEN length(word) > 4 THEN substr(word, 1, 3) || '+' || substr(word, 4) ELSE word END"


@register("cascade_boundary", f"WITH {_WORDS_SQL}, c AS (SELECT word, {_COMPOUND} AS f FROM w) SELECT word, " + _sql_of("f", [(r"(n\+?)t", r"\1d"), (r"s\+", "z+")]) + " AS outcome FROM c")
def cascade_boundary(spark, sf_dir):
    """A boundary that a context does not name is passed over; one that it names must be there."""
    df = words(spark, sf_dir).withColumn("form", F.expr(f"array_join(split({_COMPOUND}, ''), ' ')"))
    return engine.apply_cascade(df, cascade("t > d / n __", "s > z / __ +")).select("word", _plain("outcome").alias("outcome"))


# --- simulation ----------------------------------------------------------------------------------------------------------------

_STAGED_LINES = ("o > u", "e > i / __ n", "~Middle", "s > z / __ #", "=Late", "r > l")
_STAGED: list[Step] = [("", [("o", "u")]), ("", [("e(n)", r"i\1")]), ("", [("s$", "z")]), ("", [("r", "l")])]


def _staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = words(spark, sf_dir).withColumn("cells", F.array("form"))
    return engine.simulate_lexicon(lexicon, cascade(*_STAGED_LINES))


@register("stage_snapshots", f"WITH {_WORDS_SQL}, {_chain(_STAGED)} SELECT word, 0 AS seq, 'Middle' AS stage, 'g' AS type, f2 AS form FROM c4 UNION ALL SELECT word, 1, 'Late', 'b', f3 FROM c4")
def stage_snapshots(spark, sf_dir):
    return engine.snapshots(_staged_run(spark, sf_dir), "word").select("word", "seq", "stage", "type", _plain("form").alias("form"))


_LOG_SQL = "log AS (" + " UNION ALL ".join(f"SELECT word, {i} AS rule_idx, f{i} AS before, f{i + 1} AS after FROM c4 WHERE f{i} <> f{i + 1}" for i in range(4)) + ")"


def _log(spark, sf_dir):
    return engine.derivation(_staged_run(spark, sf_dir), "word")


@register("derivation_log", f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, {_LOG_SQL} SELECT * FROM log")
def derivation_log(spark, sf_dir):
    return _log(spark, sf_dir).select("word", "rule_idx", _plain("before").alias("before"), _plain("after").alias("after"))


@register("step_stages", f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, {_LOG_SQL} SELECT CASE WHEN rule_idx >= 3 THEN 'Late' WHEN rule_idx >= 2 THEN 'Middle' ELSE 'Input' END AS stage, count(*) AS n FROM log GROUP BY 1")
def step_stages(spark, sf_dir):
    """How many changes there are after each stage."""
    return engine.with_stage(_log(spark, sf_dir), cascade(*_STAGED_LINES)).groupBy("stage").agg(F.count("*").alias("n"))


def _implications_sql() -> str:
    t = phonetic_table()
    rows = ", ".join(f"('{k}', '{x}')" for k, implied in t.implications.items() for x in implied)
    specs = ", ".join(f"('{s}', '{m}{f}')" for s, vec in t.vectors.items() for f, v in zip(t.features, vec, strict=True) if (m := {"2": "+", "0": "-"}.get(v)))
    return (
        f"WITH RECURSIVE {_WORDS_SQL}, own(sym, spec) AS (VALUES {specs}), l AS (SELECT DISTINCT unnest(string_split(word, '')) AS sym FROM w), starts AS (SELECT spec, count(*) AS n_phones FROM own JOIN l USING (sym) GROUP BY spec), "
        f"imp(key, spec) AS (VALUES {rows}), c(start, spec) AS (SELECT spec AS start, spec FROM starts UNION "
        "SELECT c.start, imp.spec FROM c JOIN imp ON imp.key = c.spec OR (imp.key = substr(c.spec, 2) AND substr(c.spec, 1, 1) IN ('+', '-')) WHERE substr(imp.spec, 2) <> substr(c.start, 2)) "
        "SELECT c.start, n_phones, c.spec FROM c JOIN starts ON starts.spec = c.start"
    )


@register("implication_closure", _implications_sql())
def implication_closure(spark, sf_dir):
    """What each value of a feature that phones of the words have implies, itself included, and how many phones have it."""
    t = phonetic_table()
    closed = {m + f: t.close([m + f]) for f in t.features for m in "+-"}
    implied = F.create_map(*(x for k, v in closed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    letters = words(spark, sf_dir).select(F.explode(F.split("word", "")).alias("sym")).distinct()
    starts = letters.select(F.explode(F.element_at(diagnose.feature_columns(t), F.col("sym"))).alias("start")).groupBy("start").agg(F.count("*").alias("n_phones"))
    return starts.select("start", "n_phones", F.explode(F.element_at(implied, F.col("start"))).alias("spec"))


@register("rule_effects", f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, {_LOG_SQL} SELECT rule_idx, count(DISTINCT word) AS n_changed, min(word) AS first_key FROM log GROUP BY rule_idx")
def rule_effects(spark, sf_dir):
    return engine.rule_effects(_log(spark, sf_dir), "word")


def _spaced(f: str) -> str:
    return f"array_to_string(regexp_extract_all({f}, '.'), ' ')"


_STAGED_RULES = ["o > u", "e > i / __ n", "s > z / __ #", "r > l"]


def _derivation_sql() -> str:
    change = lambda i: f"CASE WHEN f{i} <> f{i + 1} THEN {_spaced(f'f{i + 1}')} || ' | {i} : {_STAGED_RULES[i]}' || chr(10) ELSE '' END"
    stage = lambda name, i: f"'{name} : ' || {_spaced(f'f{i}')} || chr(10)"
    parts = [f"{_spaced('f0')} || chr(10)", change(0), change(1), stage("Middle", 2), change(2), stage("Late", 3), change(3), _spaced("f4")]
    return f"WITH {_WORDS_SQL}, {_chain(_STAGED)} SELECT word, {' || '.join(parts)} AS derivation FROM c4"


@register("derivation_text", _derivation_sql())
def derivation_text(spark, sf_dir):
    return engine.derivation_text(_staged_run(spark, sf_dir), cascade(*_STAGED_LINES), "word")


@register("stage_report", f"WITH {_WORDS_SQL}, {_chain(_STAGED)} SELECT word, {_spaced('f0')} AS \"Input\", {_spaced('f2')} || ' {{GOLD: ' || {_spaced('f0')} || '}}' AS \"Middle\", {_spaced('f3')} AS \"Late\", {_spaced('f4')} || ' {{GOLD: ' || {_spaced('f0')} || '}}' AS \"Output\" FROM c4")
def stage_report(spark, sf_dir):
    """Each word at each stage, beside what is attested: here the word itself."""
    return engine.stage_report(_staged_run(spark, sf_dir), cascade(*_STAGED_LINES), [0], 0, "word")


@register(
    "rule_report",
    f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, r AS (SELECT word, -1 AS ord, 'INPUT' AS label, f0 AS f FROM c4 UNION ALL SELECT word, 7, '~Middle', f2 FROM c4 UNION ALL SELECT word, 11, '=Late', f3 FROM c4 UNION ALL "
    + " UNION ALL ".join(f"SELECT word, {3 * (i + 1)}, 'R{i}', f{i + 1} FROM c4 WHERE f{i} <> f{i + 1}" for i in range(4))
    + f") SELECT ord, label, word, {_spaced('f')} AS form FROM r",
)
def rule_report(spark, sf_dir):
    return engine.rule_report(_staged_run(spark, sf_dir), cascade(*_STAGED_LINES), "word")


@register("stage_graph", f"WITH {_WORDS_SQL}, {_chain(_STAGED)} SELECT word, f2 AS \"Middle\", f3 AS \"Late\" FROM c4")
def stage_graph(spark, sf_dir):
    found = engine.stage_graph(_staged_run(spark, sf_dir), cascade(*_STAGED_LINES), "word")
    return found.select("word", _plain("Middle").alias("Middle"), _plain("Late").alias("Late"))


@register("rule_graph", f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, {_LOG_SQL} SELECT rule_idx, max(after) FILTER (WHERE word = 'los') AS los, max(after) FILTER (WHERE word = 'on') AS \"on\" FROM log WHERE word IN ('los', 'on') GROUP BY rule_idx")
def rule_graph(spark, sf_dir):
    return engine.rule_graph(derivation_log(spark, sf_dir), ["los", "on"], "word")


@register("changed_words", f"WITH {_WORDS_SQL}, {_chain(_STAGED)} SELECT word, f3 AS before, f4 AS after FROM c4 WHERE f3 <> f4")
def changed_words(spark, sf_dir):
    return engine.changed_words(derivation_log(spark, sf_dir), 3, "word")


@register("rule_range", f"WITH {_WORDS_SQL}, {_chain(LITERAL)} SELECT word, f3 AS outcome FROM c5")
def rule_range(spark, sf_dir):
    out = engine.apply_cascade(words(spark, sf_dir), cascade(*(s for s, _ in LITERAL)), rules=(0, 3))
    return out.select("word", _plain("outcome").alias("outcome"))


_PRESENCE = """
WITH c AS (
  SELECT c_custkey AS k, regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g') AS s, c_custkey % 3 = 0 AS no_input, c_custkey % 5 = 0 AS gold_absent, c_custkey % 7 = 0 AS gold_unknown FROM customer),
m AS (SELECT *, CASE WHEN no_input THEN NULL ELSE replace(s, 'u', 'o') END AS before FROM c),
n AS (SELECT *, CASE WHEN gold_absent THEN NULL WHEN before IS NULL AND NOT gold_unknown THEN s ELSE before END AS later FROM m)
SELECT k AS etym_id, before AS at_stage, replace(later, 'i', 'e') AS outcome, CASE WHEN later IS NULL THEN 'absent' ELSE 'present' END AS status FROM n
"""


@register("presence_update", _PRESENCE)
def presence_update(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    form = engine.letters(F.regexp_replace(F.lower("c_mktsegment"), "[^a-z]", ""))
    key = F.col("c_custkey")
    gold = F.when(key % 5 == 0, "--").when(key % 7 == 0, ">*").otherwise(form)
    lexicon = customers.select(key.alias("etym_id"), F.array(F.when(key % 3 == 0, "--").otherwise(form), gold).alias("cells"))
    run = engine.simulate_lexicon(lexicon, cascade("u > o", "~Gold", "i > e"), [1])
    return run.select("etym_id", F.replace(F.col("stages")[0]["form"], F.lit(" "), F.lit("")).alias("at_stage"), _plain("outcome").alias("outcome"), "status")


_FOUND = [i for i, (rule, _) in enumerate(LITERAL) if "h >" in rule]


@register("rule_lookup", f"WITH {_WORDS_SQL}, {_chain(LITERAL)}, n AS (" + " UNION ALL ".join(f"SELECT {i} AS rule_idx, '{LITERAL[i][0]}' AS canonical, count(*) FILTER (WHERE f{i} <> f{i + 1}) AS n_words FROM c{len(LITERAL)}" for i in _FOUND) + ") SELECT * FROM n")
def rule_lookup(spark, sf_dir):
    """The rules whose text holds `h >`, and how many words each changes."""
    c = cascade(*(s for s, _ in LITERAL))
    log = engine.apply_cascade(words(spark, sf_dir), c, log=True).select(F.explode("log").alias("x")).groupBy("x.rule_idx").agg(F.count("*").alias("n"))
    found = c.rules_df(spark).where(F.col("canonical").contains("h >"))
    return found.join(log, "rule_idx", "left").select("rule_idx", "canonical", F.coalesce("n", F.lit(0)).alias("n_words"))


@register("word_lookup", "SELECT p_partkey FROM part WHERE p_name = (SELECT min(p_name) FROM part)")
def word_lookup(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    least = part.agg(F.min("p_name")).first()[0]
    return engine.word_lookup(part, "p_name", least, "p_partkey")


@register("lexicon_read", "SELECT CAST(p_partkey - 1 AS BIGINT) AS etym_id, CAST(p_partkey AS VARCHAR) AS form_id, array_to_string(regexp_extract_all(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), '.'), ' ') AS input, CASE WHEN p_partkey % 3 = 0 THEN '--' ELSE array_to_string(regexp_extract_all(regexp_replace(lower(p_type), '[^a-z]', '', 'g'), '.'), ' ') END AS gold FROM part")
def lexicon_read(spark, sf_dir):
    """Lines of a lexicon with blanks, marks, form ids and comments, read as a table."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    spaced = lambda c: F.array_join(F.split(F.regexp_replace(F.lower(c), "[^a-z]", ""), ""), "  ")
    line = F.concat(F.lit("  "), spaced("p_name"), F.lit(" , "), F.when(F.col("p_partkey") % 3 == 0, "--").otherwise(spaced("p_type")), F.lit(" ɸ"), F.col("p_partkey").cast("string"), F.lit(" $ a comment, with a comma"))
    lines = part.select((F.col("p_partkey") - 1).cast("long").alias("line_no"), line.alias("value"))
    return read_lexicon(spark, lines, use_form_id=True).select("etym_id", "form_id", F.col("cells")[0].alias("input"), F.col("cells")[1].alias("gold"))


def text_export(spark: SparkSession, sf_dir: str) -> str:
    """The lines of all documents as text files, in order of doc_id and of the lines; the files' paths are in that order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    path = new_path(spark, "text-export")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "pos").select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "line").alias("value")).write.option("lineSep", "\n").text(path)
    return path


_EXPORT_SQL = "l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))"


@register("numbered_lines", f"WITH {_EXPORT_SQL} SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no, doc_id, strlen(line) AS n_bytes, md5(line) AS digest FROM l")
def numbered_lines(spark, sf_dir):
    """Every line of an export of the documents into many files, with its number in all of them."""
    found = lines.numbered_lines(spark, text_export(spark, sf_dir))
    line = F.expr("substring(value, instr(value, '\t') + 1)")
    return found.select("line_no", F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.octet_length(line).cast("long").alias("n_bytes"), F.md5(line).alias("digest"))


@register("numbered_words", f"WITH {_EXPORT_SQL} SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS etym_id, doc_id, md5(line) AS digest FROM l WHERE contains(line, ' ')")
def numbered_words(spark, sf_dir):
    """Lines that count (here those with a blank) are numbered among themselves, as words of a lexicon are."""
    line = F.expr("substring(value, instr(value, '\t') + 1)")
    found = lines.numbered_lines(spark, text_export(spark, sf_dir), line.contains(" ")).where("line_no is not null")
    return found.select(F.col("line_no").alias("etym_id"), F.substring_index("value", "\t", 1).cast("long").alias("doc_id"), F.md5(line).alias("digest"))


# --- filters -------------------------------------------------------------------------------------------------------------------


@lru_cache
def pattern(text: str):
    return RuleParser(letter_table()).context(text).items


@register("filter_subset", f"WITH {_WORDS_SQL} SELECT word FROM w WHERE regexp_matches(word, '[aeiou]r?t')")
def filter_subset(spark, sf_dir):
    return engine.filter_words(words(spark, sf_dir), letter_table(), pattern("[+syl] ( r ) t")).select("word")


@register("match_bounds", f"WITH {_WORDS_SQL}, p AS (SELECT word, unnest(range(1, length(word))) AS i FROM w) SELECT word, i AS start, i + 2 AS \"end\" FROM p WHERE substr(word, i, 2) = 'th'")
def match_bounds(spark, sf_dir):
    found = engine.matches(words(spark, sf_dir), letter_table(), pattern("t h"))
    return found.select("word", F.explode("bounds").alias("b")).select("word", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


_VOICES = "bdgjlmnrvwyz", "cfhkpqstx"


def _bounds_sql(regex: str, word: str = "word") -> str:
    """The places of what an expression finds, from what stands before each: #, the word and # are marked and split at the marks."""
    return (
        f"WITH {_WORDS_SQL}, p AS (SELECT word, regexp_split_to_array(regexp_replace('#' || {word} || '#', '({regex})', '<\\1>', 'g'), '[<>]') AS parts FROM w), k AS (SELECT word, parts, unnest(range(1, len(parts) // 2 + 1)) AS k FROM p) "
        "SELECT word, CAST(list_sum(list_transform(parts[1:2 * k - 1], lambda x: length(x))) AS BIGINT) AS start, CAST(list_sum(list_transform(parts[1:2 * k], lambda x: length(x))) AS BIGINT) AS \"end\" FROM k"
    )


def _bounds(df: DataFrame, elements: str) -> DataFrame:
    found = engine.matches(df, letter_table(), pattern(elements)).select("word", F.explode("bounds").alias("b"))
    return found.select("word", F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("end"))


def compounds(df: DataFrame) -> DataFrame:
    """`df` (word) with form: a morph boundary after the third letter of longer words."""
    return df.withColumn("form", F.expr(f"array_join(split({_COMPOUND}, ''), ' ')"))


@register("match_bounds_edge", _bounds_sql("#[^aeiou]*?[aeiou]|[aeiou][^aeiou#]*#"))
def match_bounds_edge(spark, sf_dir):
    """The first syllable's onset and nucleus, and the last one's nucleus and coda, each with its end of the word."""
    df = words(spark, sf_dir)
    first, last = _bounds(df, "# ( [-syl] )* [+syl]"), _bounds(df, "[+syl] ( [-syl] )* #")
    taken = first.select("word", F.col("end").alias("from"))
    return first.union(last.join(taken, "word", "left").where("start >= coalesce(from, 0)").select("word", "start", "end"))


@register("match_bounds_alpha", _bounds_sql(f"[{_VOICES[0]}][aeiou]?[{_VOICES[0]}]|[{_VOICES[1]}][aeiou]?[{_VOICES[1]}]".replace("?", "??")))
def match_bounds_alpha(spark, sf_dir):
    """Two consonants that agree in voice, with or without a vowel between."""
    return _bounds(words(spark, sf_dir), "[αvoi,-syl] ( [+syl] ) [αvoi,-syl]")


@register("match_bounds_morph", _bounds_sql(r"[^#]\+(?:[^aeiou#]+?)??[aeiou]", _COMPOUND))
def match_bounds_morph(spark, sf_dir):
    """Any segment before a morph boundary, and what is after it up to a vowel."""
    return _bounds(compounds(words(spark, sf_dir)), "@ + ( [-syl] )* [+syl]")


@register("find_sequence", f"WITH {_WORDS_SQL} SELECT word, CAST(instr(word, 'er') - 1 AS INTEGER) AS first_at, CAST(CASE WHEN instr(word, 'er') = 0 THEN -1 ELSE length(word) - instr(reverse(word), 're') - 1 END AS INTEGER) AS last_at FROM w")
def find_sequence(spark, sf_dir):
    df = words(spark, sf_dir)
    return df.select("word", engine.find_sequence(F.col("form"), ["e", "r"]).alias("first_at"), engine.find_sequence(F.col("form"), ["e", "r"], last=True).alias("last_at"))


# --- scores --------------------------------------------------------------------------------------------------------------------

GOLD: list[Step] = [("t h > d", [("th", "d")]), ("e > i / __ n", [("e(n)", r"i\1")]), ("h > ∅", [("h", "")])]
PRED: list[Step] = [("t h > t", [("th", "t")]), ("e > i / __ n", [("e(n)", r"i\1")])]
CODES = symbol_codes("abcdefghijklmnopqrstuvwxyz")


def pairs(df: DataFrame) -> DataFrame:
    """`df` with pred and gold, and their distances."""
    out = engine.apply_many(df, {"pred": cascade(*(s for s, _ in PRED)), "gold": cascade(*(s for s, _ in GOLD))})
    return metrics.pair_distances(out, CODES)


def _pairs_sql(source: str, keep: str = "word") -> str:
    pred = gold = "word"
    for _, p in PRED:
        pred = _sql_of(pred, p)
    for _, p in GOLD:
        gold = _sql_of(gold, p)
    return (
        f"d AS (SELECT {keep}, {pred} AS pred, {gold} AS gold FROM {source}), "
        "p AS (SELECT *, levenshtein(pred, gold) AS ld, length(pred) AS pred_len, length(gold) AS gold_len, CASE WHEN length(gold) > 0 THEN levenshtein(pred, gold) / CAST(length(gold) AS DOUBLE) END AS ped FROM d)"
    )


_ACC_SQL = "count(*) AS n, round(avg(CASE WHEN ld <= 0 THEN 1.0 ELSE 0 END), 8) AS acc, round(avg(CASE WHEN ld <= 1 THEN 1.0 ELSE 0 END), 8) AS acc1, round(avg(CASE WHEN ld <= 2 THEN 1.0 ELSE 0 END), 8) AS acc2, round(avg(ped), 8) AS avg_ped"


def _rounded(df: DataFrame, *columns: str, scale: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, scale) for c in columns})


@register("pair_distances", f"WITH {_WORDS_SQL}, {_pairs_sql('w')} SELECT word, pred, gold, CAST(ld AS INTEGER) AS ld, CAST(pred_len AS INTEGER) AS pred_len, CAST(gold_len AS INTEGER) AS gold_len, round(ped, 8) AS ped FROM p")
def pair_distances(spark, sf_dir):
    return _rounded(pairs(words(spark, sf_dir)), "ped").select("word", _plain("pred").alias("pred"), _plain("gold").alias("gold"), "ld", "pred_len", "gold_len", "ped")


@register("accuracy_metrics", f"WITH {_WORDS_SQL}, {_pairs_sql('w')} SELECT {_ACC_SQL} FROM p")
def accuracy_metrics(spark, sf_dir):
    return _rounded(metrics.accuracy(pairs(words(spark, sf_dir))), "acc", "acc1", "acc2", "avg_ped")


_DOC_WORDS_SQL = "dw AS (SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS word FROM documents), lw AS (SELECT DISTINCT lang, word FROM dw WHERE word <> '')"


@register("accuracy_by_group", f"WITH {_DOC_WORDS_SQL}, {_pairs_sql('lw', 'lang, word')} SELECT lang, {_ACC_SQL} FROM p GROUP BY lang")
def accuracy_by_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = _split_words(docs, "text", "lang").distinct().withColumn("form", engine.letters(F.col("word")))
    return _rounded(metrics.accuracy(pairs(df), ["lang"]), "acc", "acc1", "acc2", "avg_ped")


@register("mean_change_by_lang", f"WITH {_DOC_WORDS_SQL}, c0 AS (SELECT lang, word, word AS f0 FROM lw), {_chain(LITERAL, 'lw').split('), ', 1)[1]} SELECT lang, count(*) AS n, round(avg(levenshtein(word, f5)), 8) AS mean_ld FROM c5 GROUP BY lang")
def mean_change_by_lang(spark, sf_dir):
    """The flagship: a cascade over all words of all documents, and how far it takes them, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = _split_words(docs, "text", "lang").distinct().withColumn("form", engine.letters(F.col("word")))
    out = metrics.pair_distances(engine.apply_cascade(df, cascade(*(s for s, _ in LITERAL))), CODES, "form", "outcome")
    return _rounded(out.groupBy("lang").agg(F.count("*").alias("n"), F.avg("ld").alias("mean_ld")), "mean_ld")


_BASE_HYP_SQL = f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, h AS (SELECT *, levenshtein({_sql_of('pred', [('h', '')])}, gold) AS hld FROM p) SELECT round(avg(CASE WHEN hld <= 0 THEN 1.0 ELSE 0 END) - avg(CASE WHEN ld <= 0 THEN 1.0 ELSE 0 END), 8) AS delta_acc FROM h"


@register("comparative_accuracy", _BASE_HYP_SQL)
def comparative_accuracy(spark, sf_dir):
    made = {"pred": cascade(*(s for s, _ in PRED)), "hyp": cascade(*(s for s, _ in PRED), "h > ∅"), "gold": cascade(*(s for s, _ in GOLD))}
    return _rounded(metrics.paired_accuracy(engine.apply_many(words(spark, sf_dir), made), CODES), "delta_acc").select("delta_acc")


_DISTANCE = FeatureDistance(len(letter_table().features))


def _fed_sql() -> str:
    """CTEs p (of _pairs_sql) and al: pred, gold, fed, path of each distinct pair; path has two letters for each aligned place, - for a gap.

    The table of costs is filled row by row by recursion, a row from left to right by a fold.
    """
    t = letter_table()
    vectors = ", ".join(f"('{s}', '{v}')" for s, v in [*t.vectors.items(), ("_", "0" * len(t.features))])
    around = lambda w: f"list_transform(range(1, length({w}) + 1), lambda i: 0.5 * (m[substr('_' || {w}, i + 1, 1) || substr('_' || {w}, i, 1)] + m[substr('_' || {w} || '_', i + 1, 1) || substr('_' || {w} || '_', i + 2, 1)]))"
    return (
        f"v(s, d) AS (VALUES {vectors}), "
        f"dm AS (SELECT map_from_entries(list(struct_pack(k := a.s || b.s, v := CAST(list_sum(list_transform(range(1, {len(t.features) + 1}), lambda i: abs(CAST(substr(a.d, i, 1) AS INTEGER) - CAST(substr(b.d, i, 1) AS INTEGER)))) AS DOUBLE)))) AS m FROM v a, v b), "
        f"g AS (SELECT pred, gold, {around('pred')} AS gone, {around('gold')} AS come, m FROM (SELECT DISTINCT pred, gold FROM p WHERE pred <> gold AND pred <> '' AND gold <> ''), dm), "
        "dp(pred, gold, i, r) AS (SELECT pred, gold, CAST(0 AS BIGINT), list_transform(range(0, length(gold) + 1), lambda j: struct_pack(c := coalesce(list_sum(come[1:j]), 0.0), p := array_to_string(list_transform(range(1, j + 1), lambda k: '-' || substr(gold, k, 1)), ''))) FROM g "
        "UNION ALL SELECT dp.pred, dp.gold, dp.i + 1, list_reduce("
        "list_concat([[struct_pack(c := r[1].c + gone[dp.i + 1], p := r[1].p || substr(dp.pred, dp.i + 1, 1) || '-')]], "
        "list_transform(range(1, length(dp.gold) + 1), lambda j: [struct_pack(c := r[j].c + m[substr(dp.pred, dp.i + 1, 1) || substr(dp.gold, j, 1)] / 2, p := r[j].p || substr(dp.pred, dp.i + 1, 1) || substr(dp.gold, j, 1)), "
        "struct_pack(c := r[j + 1].c + gone[dp.i + 1], p := r[j + 1].p || substr(dp.pred, dp.i + 1, 1) || '-'), struct_pack(c := come[j], p := '-' || substr(dp.gold, j, 1))])), "
        "lambda acc, x: list_append(acc, CASE WHEN x[1].c < x[2].c AND x[1].c < acc[-1].c + x[3].c THEN x[1] WHEN x[2].c < acc[-1].c + x[3].c THEN x[2] ELSE struct_pack(c := acc[-1].c + x[3].c, p := acc[-1].p || x[3].p) END)) "
        "FROM dp JOIN g ON dp.pred = g.pred AND dp.gold = g.gold WHERE dp.i < length(dp.pred)), "
        f"al AS (SELECT pred, gold, r[-1].c / {len(t.features)} AS fed, r[-1].p AS path FROM dp WHERE i = length(pred) "
        "UNION ALL SELECT DISTINCT pred, gold, 0.0, array_to_string(list_transform(range(1, length(pred) + 1), lambda i: substr(pred, i, 1) || substr(pred, i, 1)), '') FROM p WHERE pred = gold)"
    )


_ALIGNED_SQL = f"WITH RECURSIVE {_WORDS_SQL}, {_pairs_sql('w')}, {_fed_sql()}, x AS (SELECT p.word, ld, path, unnest(range(0, CAST(length(path) / 2 AS BIGINT))) AS pos FROM p JOIN al USING (pred, gold))"
_SIDES_SQL = "replace(substr(path, 2 * pos + 1, 1), '-', '∅') AS res_sym, replace(substr(path, 2 * pos + 2, 1), '-', '∅') AS gold_sym"


@register("fed_metrics", f"WITH RECURSIVE {_WORDS_SQL}, {_pairs_sql('w')}, {_fed_sql()} SELECT {_ACC_SQL}, round(avg(fed), 8) AS avg_fed FROM p JOIN al USING (pred, gold) WHERE pred <> '' AND gold <> ''")
def fed_metrics(spark, sf_dir):
    rows = metrics.with_fed(pairs(words(spark, sf_dir)).where("pred <> '' and gold <> ''"), letter_table(), _DISTANCE)
    return _rounded(metrics.accuracy(rows), "acc", "acc1", "acc2", "avg_ped", "avg_fed")


def _aligned(spark, sf_dir) -> DataFrame:
    return metrics.with_alignment(pairs(words(spark, sf_dir)).where("pred <> '' and gold <> ''"), letter_table(), _DISTANCE)


@register("fed_alignment", f"{_ALIGNED_SQL} SELECT word, CAST(pos AS INTEGER) AS pos, {_SIDES_SQL} FROM x")
def fed_alignment(spark, sf_dir):
    return metrics.alignments(_aligned(spark, sf_dir), "word")


def _mismatched(spark, sf_dir) -> DataFrame:
    return metrics.with_alignment(pairs(words(spark, sf_dir)).where("ld > 0 and pred <> '' and gold <> ''"), letter_table(), _DISTANCE)


@register("confusion_topk", f"{_ALIGNED_SQL}, y AS (SELECT {_SIDES_SQL} FROM x WHERE ld > 0) SELECT res_sym, gold_sym, count(*) AS n FROM y WHERE res_sym <> gold_sym GROUP BY ALL ORDER BY n DESC, res_sym, gold_sym LIMIT 5")
def confusion_topk(spark, sf_dir):
    return diagnose.top_confusions(diagnose.confusions(_mismatched(spark, sf_dir)))


_AROUND_SQL = (
    f"{_ALIGNED_SQL}, y AS (SELECT path, pos FROM x WHERE ld > 0 AND substr(path, 2 * pos + 1, 2) = 'td'), "
    "z AS (SELECT path, pos, unnest([-2, -1, 1, 2]) AS o FROM y), "
    "c AS (SELECT o AS \"offset\", CASE WHEN pos + o < 0 OR 2 * (pos + o) >= length(path) THEN '#' ELSE replace(substr(path, 2 * (pos + o) + 2, 1), '-', '∅') END AS sym, count(*) AS n FROM z GROUP BY 1, 2)"
)


@register("confusion_contexts", f"{_AROUND_SQL} SELECT * FROM c")
def confusion_contexts(spark, sf_dir):
    return diagnose.confusion_contexts(_mismatched(spark, sf_dir), "t", "d")


@register("etymon_distances", f"WITH RECURSIVE {_WORDS_SQL}, {_pairs_sql('w')}, {_fed_sql()} SELECT word, pred, gold, CAST(ld AS INTEGER) AS ld, round(ped, 8) AS ped, round(fed, 8) AS fed, CAST(pred_len AS INTEGER) AS pred_len, CAST(gold_len AS INTEGER) AS gold_len FROM p JOIN al USING (pred, gold) WHERE pred <> '' AND gold <> ''")
def etymon_distances(spark, sf_dir):
    rows = metrics.with_fed(pairs(words(spark, sf_dir)).where("pred <> '' and gold <> ''"), letter_table(), _DISTANCE)
    return _rounded(metrics.etymon_distances(rows, "word"), "ped", "fed").withColumns({c: _plain(c) for c in ("pred", "gold")})


@register("accuracy_report", f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, a AS (SELECT {_ACC_SQL} FROM p) SELECT format('{{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', acc, acc1, acc2, avg_ped) AS text FROM a")
def accuracy_report(spark, sf_dir):
    """The scores of the report, its words left out, six places each."""
    text = metrics.accuracy_text(metrics.accuracy(pairs(words(spark, sf_dir))))
    return text.select(F.array_join(F.transform(F.split("text", "\t"), lambda x: F.format_string("%.6f", x.cast("double"))), " ").alias("text"))


@register("mismatch_list", f"WITH {_WORDS_SQL}, {_pairs_sql('w')} SELECT word, pred, gold FROM p WHERE ld > 0 AND contains(gold, 'in')")
def mismatch_list(spark, sf_dir):
    found = metrics.mismatches(pairs(words(spark, sf_dir)), ["i", "n"])
    return found.select("word", _plain("pred").alias("pred"), _plain("gold").alias("gold"))


# --- phones --------------------------------------------------------------------------------------------------------------------


_CHARS = "c AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)"


@register("phone_counts", f"WITH {_WORDS_SQL}, {_CHARS} SELECT substr(word, i, 1) AS sym, count(*) AS n FROM c GROUP BY 1")
def phone_counts(spark, sf_dir):
    return metrics.phone_counts(words(spark, sf_dir))


@register("phone_docfreq", f"WITH {_WORDS_SQL}, {_CHARS} SELECT substr(word, i, 1) AS sym, count(DISTINCT word) AS n_words FROM c GROUP BY 1")
def phone_docfreq(spark, sf_dir):
    return metrics.phone_docfreq(words(spark, sf_dir))


@register("inventory", f"WITH {_WORDS_SQL}, {_CHARS}, f AS (SELECT substr(word, i, 1) AS sym, min((word, i)) AS place FROM c GROUP BY 1) SELECT sym, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS rank FROM f")
def inventory(spark, sf_dir):
    return metrics.inventory(words(spark, sf_dir), "word")


@register("has_phone", f"WITH {_WORDS_SQL} SELECT word, contains(word, 'q') AS has FROM w")
def has_phone(spark, sf_dir):
    return metrics.has_phone(words(spark, sf_dir), "q").select("word", "has")


@register("sequence_frequency", f"WITH {_WORDS_SQL}, {_CHARS} SELECT CAST(count(*) AS BIGINT) AS n FROM c WHERE substr(word, i, 3) = 'the'")
def sequence_frequency(spark, sf_dir):
    return metrics.sequence_frequency(words(spark, sf_dir), ["t", "h", "e"])


_ERRORS_SQL = f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, c AS (SELECT word, gold, ld, unnest(range(1, length(gold) + 1)) AS i FROM p), e AS (SELECT word, substr(gold, i, 1) AS sym, count(*) AS t, max(CASE WHEN ld > 0 THEN 1 ELSE 0 END) AS bad FROM c GROUP BY 1, 2), s AS (SELECT sym, count(*) AS n_words, CAST(sum(t) AS BIGINT) AS n_tokens, CAST(sum(bad) AS BIGINT) AS n_errors FROM e GROUP BY 1)"


@register("errors_by_phone", _ERRORS_SQL + " SELECT *, round(n_errors / n_words, 8) AS error_rate, round(n_errors / n_tokens, 8) AS token_rate FROM s")
def errors_by_phone(spark, sf_dir):
    return _rounded(metrics.errors_by_phone(pairs(words(spark, sf_dir)), "gold"), "error_rate", "token_rate")


@register("top_error_phones", _ERRORS_SQL + " SELECT sym, round(n_errors / n_words, 8) AS error_rate FROM s ORDER BY n_errors / n_words DESC, sym LIMIT 4")
def top_error_phones(spark, sf_dir):
    return _rounded(metrics.top_error_phones(metrics.errors_by_phone(pairs(words(spark, sf_dir)), "gold")), "error_rate").select("sym", "error_rate")


@register("analysis_file", f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, c AS (SELECT word, gold, ld, ped, unnest(range(1, length(gold) + 1)) AS i FROM p), e AS (SELECT DISTINCT word, substr(gold, i, 1) AS sym, ld, ped FROM c) SELECT sym, round(avg(CASE WHEN ld > 0 THEN 1.0 ELSE 0 END), 8) AS error_rate, round(avg(ld), 8) AS mean_ld, round(avg(ped), 8) AS mean_ped FROM e GROUP BY sym")
def analysis_file(spark, sf_dir):
    return _rounded(metrics.analysis_file(pairs(words(spark, sf_dir))), "error_rate", "mean_ld", "mean_ped")


def _specs_sql() -> str:
    rows = ", ".join(f"('{s}', '{'+' if v == '2' else '-'}{f}')" for s, vec in letter_table().vectors.items() for f, v in zip(letter_table().features, vec, strict=True))
    return f"specs(sym, spec) AS (VALUES {rows})"


#: The letters that follow ch or ph in some word.
_AFTER_SQL = "s AS (SELECT DISTINCT sym FROM (SELECT unnest(regexp_extract_all(word, '(ch|ph)([a-z])', 2)) AS sym FROM w))"


def _after(spark, sf_dir) -> DataFrame:
    found = words(spark, sf_dir).select(F.explode(F.regexp_extract_all("word", F.lit("(ch|ph)([a-z])"), F.lit(2))).alias("sym"))
    return found.distinct()


@register("inactive_features", f"WITH {_WORDS_SQL}, {_specs_sql()}, {_AFTER_SQL} SELECT spec FROM specs JOIN s USING (sym) GROUP BY spec HAVING count(*) = (SELECT count(*) FROM s)")
def inactive_features(spark, sf_dir):
    """What all letters after ch or ph have in common."""
    return diagnose.inactive_features(_after(spark, sf_dir), letter_table())


_NAMES_OF_FEATURES = "[" + ", ".join(f"'{f}'" for f in letter_table().features) + "]"
_VOICE = letter_table().features.index("voi")


@register(
    "phone_features",
    f"WITH {_WORDS_SQL}, {_CHARS}, v(sym, d) AS (VALUES {', '.join(f'({s!r}, {v!r})' for s, v in letter_table().vectors.items())}), n AS (SELECT substr(word, i, 1) AS sym, count(*) AS n FROM c GROUP BY 1) "
    f"SELECT sym, n, array_to_string(list_transform(range(1, {len(letter_table().features) + 1}), lambda i: CASE substr(d, i, 1) WHEN '2' THEN '+' ELSE '-' END || {_NAMES_OF_FEATURES}[i]), ' ') AS spelled, "
    f"CASE substr(d, {_VOICE + 1}, 1) WHEN '2' THEN '+' ELSE '-' END AS voi, coalesce((SELECT max(o.sym) FROM v o WHERE o.d = substr(v.d, 1, {_VOICE}) || '2' || substr(v.d, {_VOICE + 2})), '?') AS voiced FROM n JOIN v USING (sym)",
)
def phone_features(spark, sf_dir):
    """Each letter of the words: how often, its features spelled out, its voice, and the letter that it is with voice."""
    t, fv = letter_table(), F.col("fv")
    known = columns.symbols_df(spark, t).select(F.col("symbol").alias("sym"), columns.spelled(fv, t).alias("spelled"), columns.feature_value(fv, t, "voi").alias("voi"), columns.printed(columns.with_feature(fv, t, "voi", "+"), t).alias("voiced"))
    return metrics.phone_counts(words(spark, sf_dir)).join(F.broadcast(known), "sym")


@register("matrix_match", f"WITH {_WORDS_SQL}, {_specs_sql()}, c AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w), s AS (SELECT substr(word, i, 1) AS sym FROM c), m AS (SELECT sym FROM specs WHERE spec IN ('+voi', '-syl', '-lab') GROUP BY sym HAVING count(*) = 3) SELECT sym, count(*) AS n FROM s JOIN m USING (sym) GROUP BY sym")
def matrix_match(spark, sf_dir):
    t = letter_table()
    hits = columns.symbols_df(spark, t).where(columns.matches_matrix(F.col("fv"), RuleParser(t).slot("[+voi,-syl,-lab]"), len(t.features)))
    return metrics.phones(words(spark, sf_dir)).join(F.broadcast(hits.select(F.col("symbol").alias("sym"))), "sym").groupBy("sym").agg(F.count("*").alias("n"))


# --- what predicts a miss --------------------------------------------------------------------------------------------------------

_AUTOPSY_SQL = f"""WITH {_specs_sql()},
l AS (SELECT quality = 0 AS miss, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS word FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
m AS (SELECT miss, '#' || word || '#' AS word, unnest(range(2, length(word) + 2)) AS i FROM l WHERE word <> ''),
o AS (SELECT miss, -1 AS rel_pos, substr(word, i - 1, 1) AS sym FROM m WHERE substr(word, i, 1) = 'e' UNION ALL SELECT miss, 1, substr(word, i + 1, 1) FROM m WHERE substr(word, i, 1) = 'e'),
t AS (SELECT rel_pos, count(*) FILTER (WHERE miss) AS misses, count(*) FILTER (WHERE NOT miss) AS hits FROM o GROUP BY 1),
e AS (SELECT rel_pos, miss, sym AS predictor FROM o UNION ALL SELECT rel_pos, miss, spec FROM o JOIN specs USING (sym)),
n AS (SELECT rel_pos, predictor, count(*) FILTER (WHERE miss) AS n11, count(*) FILTER (WHERE NOT miss) AS n10 FROM e GROUP BY 1, 2),
x AS (SELECT rel_pos, predictor, n11, n10, misses - n11 AS n01, hits - n10 AS n00 FROM n JOIN t USING (rel_pos)),
"""


def autopsy(spark, sf_dir) -> DataFrame:
    """The contingency of each predictor beside every e in words of labelled documents; a miss is a word of low quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null"), "doc_id")
    df = _split_words(docs.withColumn("miss", F.col("quality") == 0), "text", "miss").groupBy("miss", "word").agg(F.count("*").alias("times"))
    found = engine.matches(df.withColumn("form", engine.letters(F.col("word"))), letter_table(), pattern("e"))
    return diagnose.contingency(diagnose.contexts(found, letter_table(), [-1, 1], weight="times"))


_FLOORS = "greatest(CAST(n00 AS DOUBLE), 0.5) AS a, greatest(CAST(n10 AS DOUBLE), 0.5) AS b, greatest(CAST(n01 AS DOUBLE), 0.5) AS c, CAST(n11 AS DOUBLE) AS d"


@register("context_autopsy_phi", _AUTOPSY_SQL + f"y AS (SELECT *, {_FLOORS} FROM x) SELECT rel_pos, predictor, n11, n10, n01, n00, round(coalesce((d * a - b * c) / nullif(sqrt((d + b) * (d + c) * (a + b) * (a + c)), 0), 0), 6) AS score FROM y")
def context_autopsy_phi(spark, sf_dir):
    return _rounded(diagnose.scored(autopsy(spark, sf_dir), "phi"), "score", scale=6)


def _f_sql(beta: float) -> str:
    return _AUTOPSY_SQL + (
        "y AS (SELECT *, n11 / greatest(CAST(n10 + n11 AS DOUBLE), 0.25) AS p, n11 / greatest(CAST(n01 + n11 AS DOUBLE), 0.25) AS r FROM x) "
        f"SELECT rel_pos, predictor, n11, n10, n01, n00, round(CASE WHEN p + r = 0 THEN 0.0 ELSE CAST({1 + beta * beta} AS DOUBLE) * p * r / (CAST({beta * beta} AS DOUBLE) * p + r) END, 6) AS score FROM y"
    )


@register("context_autopsy_f1", _f_sql(1.0))
def context_autopsy_f1(spark, sf_dir):
    return _rounded(diagnose.scored(autopsy(spark, sf_dir), "f"), "score", scale=6)


@register("context_autopsy_fbeta", _f_sql(2.0))
def context_autopsy_fbeta(spark, sf_dir):
    return _rounded(diagnose.scored(autopsy(spark, sf_dir), "f2"), "score", scale=6)


_KIND_SQL = "CASE WHEN predictor = '#' THEN 'bound' WHEN regexp_matches(predictor, '^[+-]\\w') THEN 'feature' ELSE 'phone' END"


@register(
    "top_predictors",
    f"WITH b AS ({_f_sql(1.0).replace(', 6) AS score', ', 9) AS score')}), k AS (SELECT *, {_KIND_SQL} AS kind FROM b), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY rel_pos ORDER BY score DESC, predictor) AS rank, row_number() OVER (PARTITION BY rel_pos, kind ORDER BY score DESC, predictor) AS kr FROM k) "
    "SELECT rel_pos, CAST(rank AS INTEGER) AS rank, kind, predictor, round(score, 6) AS score FROM r WHERE score > 0.1 AND (rank <= 5 OR kr = 1)",
)
def top_predictors(spark, sf_dir):
    scores = _rounded(diagnose.scored(autopsy(spark, sf_dir), "f"), "score", scale=9)  # so that ties are ties in any arithmetic
    return diagnose.top_predictors(scores, 5).select("rel_pos", "rank", "kind", "predictor", F.round("score", 6).alias("score"))


@register("subsample", f"WITH {_WORDS_SQL}, {_pairs_sql('w')} SELECT word, ld > 0 AS miss FROM p WHERE regexp_matches(word, '[aeiou]th')")
def subsample(spark, sf_dir):
    return diagnose.subsample(pairs(words(spark, sf_dir)), None, letter_table(), pattern("[+syl] t h"), "word").select("word", "miss")


@register("without_active", f"WITH {_WORDS_SQL}, {_specs_sql()}, {_AFTER_SQL} SELECT DISTINCT spec FROM specs WHERE spec NOT IN (SELECT spec FROM specs JOIN s USING (sym))")
def without_active(spark, sf_dir):
    """The specs that no letter after ch or ph has."""
    t = letter_table()
    specs = sorted({("+" if v == "2" else "-") + f for vec in t.vectors.values() for f, v in zip(t.features, vec, strict=True)})
    return diagnose.without_active(specs, _after(spark, sf_dir), t)


@register(
    "confusion_prognosis",
    f"{_AROUND_SQL}, {_specs_sql()}, h AS (SELECT *, n / sum(n) OVER (PARTITION BY \"offset\") AS share FROM c), f AS (SELECT *, count(*) OVER (PARTITION BY \"offset\") AS k FROM h WHERE sym NOT IN ('#', '∅')) "
    "SELECT \"offset\", 'boundary' AS kind, sym AS value, round(share, 8) AS share FROM h WHERE sym = '#' AND share > 0.2 UNION ALL SELECT \"offset\", 'phone', sym, round(share, 8) FROM f WHERE share > 0.1 "
    "UNION ALL SELECT \"offset\", 'constant', spec, 1.0 FROM f JOIN specs USING (sym) GROUP BY \"offset\", k, spec HAVING count(*) = k",
)
def confusion_prognosis(spark, sf_dir):
    return _rounded(diagnose.prognosis(confusion_contexts(spark, sf_dir), letter_table(), 0.1), "share")


@register("subset_shares", f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, s AS (SELECT contains(word, 'th') AS i, ld > 0 AS m FROM p), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE i) AS n_in, count(*) FILTER (WHERE m) AS n_miss, count(*) FILTER (WHERE i AND m) AS n_in_miss FROM s) SELECT *, round(n_in / n, 8) AS share, round(n_in_miss / n_miss, 8) AS error_share FROM t")
def subset_shares(spark, sf_dir):
    return _rounded(diagnose.subset_shares(pairs(words(spark, sf_dir)), F.col("word").contains("th"), F.col("ld") > 0), "share", "error_share")


# --- what if -------------------------------------------------------------------------------------------------------------------

_BASE: list[Step] = [("c > s / __ e", [("c(e)", r"s\1")]), ("s > z / __ e", [("s(e)", r"z\1")]), ("z > r", [("z", "r")]), ("r > l / __ e", [("r(e)", r"l\1")])]
Pairs = list[tuple[str, str]]


@lru_cache
def hypothesis(kind: str = "delete") -> whatif.Hypothesis:
    """The base with one edit."""
    edit = {
        "delete": whatif.Edit("delete", 1),
        "insert": whatif.Edit("insert", 2, law="l > r / __ a"),
        "modify": whatif.Edit("modify", 1, law="s > t / __ e"),
        "relocate": whatif.Edit("relocate", 0, to=4),
    }[kind]
    return whatif.propose(cascade(*(s for s, _ in _BASE)), [edit])


#: What the hypotheses' rules do in SQL: (uid, place in the order of both cascades, pairs).
_L0, _L1, _L2, _L3 = ((f"L{i}.0", p) for i, (_, p) in enumerate(_BASE))
_HYPS: dict[str, tuple[list[tuple[str, Pairs]], list[str]]] = {
    "delete": ([_L0, _L2, _L3], ["L0.0", "L1.0", "L2.0", "L3.0"]),
    "insert": ([_L0, _L1, ("E0.0", [("l(a)", r"r\1")]), _L2, _L3], ["L0.0", "L1.0", "E0.0", "L2.0", "L3.0"]),
    "modify": ([_L0, ("L1.0", [("s(e)", r"t\1")]), _L2, _L3], ["L0.0", "L1.0", "L2.0", "L3.0"]),
    "relocate": ([_L1, _L2, _L3, _L0], ["L1.0", "L2.0", "L3.0", "L0.0"]),
}


def _whatif_sql(kind: str = "delete") -> str:
    hyp, order = _HYPS[kind]
    side = lambda x, rules: f"{x}0 AS (SELECT word, word AS f0 FROM w), " + ", ".join(f"{x}{i + 1} AS (SELECT *, {_sql_of(f'f{i}', p)} AS f{i + 1} FROM {x}{i})" for i, (_, p) in enumerate(rules))
    steps = lambda x, name, rules: " UNION ALL ".join(f"SELECT word, '{u}' AS rule_uid, f{i} AS {name}_before, f{i + 1} AS {name}_after FROM {x}{len(rules)} WHERE f{i} <> f{i + 1}" for i, (u, _) in enumerate(rules))
    base = [_L0, _L1, _L2, _L3]
    places = ", ".join(f"('{u}', {i})" for i, u in enumerate(order))
    return (
        f"WITH {_WORDS_SQL}, {side('b', base)}, {side('h', hyp)}, bl AS ({steps('b', 'base', base)}), hl AS ({steps('h', 'hyp', hyp)}), o(rule_uid, global_idx) AS (VALUES {places}), "
        "diff AS (SELECT word, rule_uid, global_idx, base_before, base_after, hyp_before, hyp_after FROM bl FULL JOIN hl USING (word, rule_uid) JOIN o USING (rule_uid) "
        "WHERE base_before IS DISTINCT FROM hyp_before OR base_after IS DISTINCT FROM hyp_after)"
    )


def _both(spark, sf_dir, kind: str = "delete") -> DataFrame:
    return whatif.run_both(words(spark, sf_dir), hypothesis(kind))


def _diff(spark, sf_dir, kind: str = "delete") -> DataFrame:
    diff = whatif.differential(_both(spark, sf_dir, kind), hypothesis(kind), "word")
    return diff.select("word", "rule_uid", "global_idx", *(_plain(c).alias(c) for c in ("base_before", "base_after", "hyp_before", "hyp_after")))


@register("whatif_diff", _whatif_sql() + " SELECT * FROM diff")
def whatif_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


def _register_edit(kind: str) -> None:
    QUERIES[f"whatif_{kind}"] = lambda spark, sf_dir: _diff(spark, sf_dir, kind)
    SQL[f"whatif_{kind}"] = _whatif_sql(kind) + " SELECT * FROM diff"


for _kind in ("insert", "modify", "relocate"):
    _register_edit(_kind)


@register("whatif_fed_bled", _whatif_sql() + " SELECT word, rule_uid, global_idx, CASE WHEN base_after IS NULL THEN 'fed' ELSE 'bled' END AS effect FROM diff WHERE (base_after IS NULL) <> (hyp_after IS NULL) AND rule_uid <> 'L1.0'")
def whatif_fed_bled(spark, sf_dir):
    return whatif.fed_bled(_diff(spark, sf_dir), hypothesis(), "word")


@register("whatif_divergence", _whatif_sql() + " SELECT word, min(global_idx) AS first_idx FROM diff GROUP BY word")
def whatif_divergence(spark, sf_dir):
    return whatif.divergence(_both(spark, sf_dir), hypothesis(), "word")


_DOMINO_SQL = _whatif_sql() + ", f AS (SELECT word, min_by(rule_uid, global_idx) AS rule_uid FROM diff GROUP BY word)"


@register("whatif_dominoes", _DOMINO_SQL + " SELECT rule_uid, count(*) AS n_words, min(word) AS first_key FROM f GROUP BY rule_uid")
def whatif_dominoes(spark, sf_dir):
    return whatif.dominoes(_both(spark, sf_dir), hypothesis(), "word")


@register("whatif_domino_words", _DOMINO_SQL + " SELECT * FROM f")
def whatif_domino_words(spark, sf_dir):
    return whatif.domino_words(_both(spark, sf_dir), hypothesis(), "word")


@register("whatif_affected", _whatif_sql() + " SELECT DISTINCT word FROM diff")
def whatif_affected(spark, sf_dir):
    return whatif.affected(_both(spark, sf_dir), hypothesis(), "word")


def _outcomes_sql() -> str:
    """Both chains over one row, so that nothing is joined."""
    base, hyp = ([pair for _, pairs in rules for pair in pairs] for rules in ([_L0, _L1, _L2, _L3], _HYPS["delete"][0]))
    return f"WITH {_WORDS_SQL}, o AS MATERIALIZED (SELECT word, {_sql_of('word', base)} AS base_outcome, {_sql_of('word', hyp)} AS hyp_outcome FROM w) SELECT * FROM o WHERE base_outcome <> hyp_outcome"


@register("whatif_outcomes", _outcomes_sql())
def whatif_outcomes(spark, sf_dir):
    return whatif.changed_outcomes(_both(spark, sf_dir), "word").select("word", _plain("base_outcome").alias("base_outcome"), _plain("hyp_outcome").alias("hyp_outcome"))


@register(
    "whatif_results",
    _whatif_sql() + " SELECT global_idx, rule_uid, rule_uid = 'L1.0' AS edited, count(*) FILTER (WHERE hyp_after IS NULL) AS n_only_base, count(*) FILTER (WHERE base_after IS NULL) AS n_only_hyp, "
    "count(*) FILTER (WHERE base_after IS NOT NULL AND hyp_after IS NOT NULL) AS n_otherwise, min(word) AS first_key FROM diff GROUP BY ALL",
)
def whatif_results(spark, sf_dir):
    return whatif.basic_results(_both(spark, sf_dir), hypothesis(), "word")


_STOPS_SQL = (
    f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, hyp AS (SELECT word, f0, f2, f4, {_sql_of('f0', [('e(n)', r'i\1')])} AS h2 FROM c4), "
    f"k AS (SELECT *, {_sql_of('h2', [('s$', 'z'), ('r', 'l')])} AS h4, {_sql_of('f0', [('o', 'u')])} AS g FROM hyp), "
    "r AS (SELECT 0 AS seq, 'Middle' AS stage, f2 AS pred, h2 AS hyp, g AS gold FROM k UNION ALL SELECT 1, 'Output', f4, h4, f0 FROM k), "
    "l AS (SELECT seq, stage, levenshtein(pred, gold) AS b, levenshtein(hyp, gold) AS h, length(gold) AS n FROM r) "
    "SELECT seq, stage, count(*) AS n, round(avg(CASE WHEN b = 0 THEN 1.0 ELSE 0 END), 8) AS base_acc, round(avg(CASE WHEN h = 0 THEN 1.0 ELSE 0 END), 8) AS hyp_acc, round(avg(b / n), 8) AS base_avg_ped, round(avg(h / n), 8) AS hyp_avg_ped FROM l GROUP BY seq, stage"
)


@register("whatif_stages", _STOPS_SQL)
def whatif_stages(spark, sf_dir):
    """Without the first rule, at the gold stage (attested: o > u alone) and at the end (attested: the word)."""
    lexicon = words(spark, sf_dir).withColumn("cells", F.array("form", F.replace("form", F.lit("o"), F.lit("u")), "form"))
    h = whatif.propose(cascade(*_STAGED_LINES), [whatif.Edit("delete", 0)])
    out = whatif.stage_results(lexicon, h, CODES, [1], 2)
    return _rounded(out, "base_acc", "hyp_acc", "base_avg_ped", "hyp_avg_ped").select("seq", "stage", F.col("base_n").alias("n"), "base_acc", "hyp_acc", "base_avg_ped", "hyp_avg_ped")


# --- kept forms ------------------------------------------------------------------------------------------------------------------


def _kept_sql(n: int, select: str) -> str:
    steps = ", ".join(f"c{i + 1} AS (SELECT *, {_sql_of(f'f{i}', p)} AS f{i + 1} FROM c{i})" for i, (_, p) in enumerate(long_steps(n)))
    return f"WITH {_WORDS_SQL}, c0 AS (SELECT word, word AS f0 FROM w), {steps} {select}"


def _snapshots(spark, sf_dir, n: int, every: int) -> stages.Snapshots:
    return stages.Snapshots.build(words(spark, sf_dir), cascade(*(rule for rule, _ in long_steps(n))), every)


@register("snapshot_pivot", _kept_sql(60, "SELECT word, f37 AS form FROM c60"))
def snapshot_pivot(spark, sf_dir):
    """Forms when 37 of 60 rules have run, from those kept at 30."""
    return _snapshots(spark, sf_dir, 60, 15).at(37).select("word", _plain("form").alias("form"))


_LATE = [pair for _, pairs in long_steps(60)[51:] for pair in pairs]


@register("snapshot_whatif", _kept_sql(60, f", h AS MATERIALIZED (SELECT word, f60 AS base_outcome, {_sql_of('f50', _LATE)} AS hyp_outcome FROM c60) SELECT * FROM h WHERE base_outcome <> hyp_outcome"))
def snapshot_whatif(spark, sf_dir):
    """Without rule 50 of 60: both runs begin at the forms kept at 45."""
    kept = _snapshots(spark, sf_dir, 60, 15)
    both = kept.run_both(whatif.propose(kept.cascade, [whatif.Edit("delete", 50)]))
    return whatif.changed_outcomes(both, "word").select("word", _plain("base_outcome").alias("base_outcome"), _plain("hyp_outcome").alias("hyp_outcome"))


@register("stages_side_by_side", f"WITH {_WORDS_SQL}, p AS (SELECT word, {_sql_of('word', [x for _, s in PRED for x in s])} AS pred, {_sql_of('word', [x for _, s in GOLD for x in s])} AS gold, {_sql_of('word', PRED[0][1])} AS after_first FROM w) SELECT word, after_first, pred, gold, pred = gold AS hit FROM p")
def stages_side_by_side(spark, sf_dir):
    """Results, golds and forms after the first rule, kept by word and joined without a shuffle."""
    df, pred, gold = words(spark, sf_dir), cascade(*(s for s, _ in PRED)), cascade(*(s for s, _ in GOLD))
    outcome = lambda c, name, rules=None: stages.keep(engine.apply_cascade(df, c, rules=rules).select("word", _plain("outcome").alias(name)), "word", name)
    return stages.side_by_side([outcome(pred, "after_first", (0, 1)), outcome(pred, "pred"), outcome(gold, "gold")]).withColumn("hit", F.col("pred") == F.col("gold"))


# --- rows of one word, sheets of all words -----------------------------------------------------------------------------------------


@register("word_derivation", f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, {_LOG_SQL} SELECT * FROM log WHERE word = (SELECT max(word) FROM log)")
def word_derivation(spark, sf_dir):
    """All steps laid out by word; those of the last word, of which one row group is read."""
    path = new_path(spark, "derivations")
    tiles.write_by_key(derivation_log(spark, sf_dir), path, "word")
    last = spark.read.parquet(path).agg(F.max("word")).first()[0]  # from the files' statistics
    return tiles.lookup(spark, path, "word", last)


_TILE = 8


@register(
    "rule_tiles",
    f"WITH {_WORDS_SQL}, {_chain(_STAGED)}, {_LOG_SQL}, n AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS n FROM (SELECT DISTINCT word FROM log)) "
    f"SELECT n // {_TILE} AS tile, rule_idx, " + ", ".join(f"max(after) FILTER (WHERE n % {_TILE} = {i}) AS c{i}" for i in range(_TILE)) + " FROM log JOIN n USING (word) GROUP BY ALL",
)
def rule_tiles(spark, sf_dir):
    """The sheet of rules by all words that change, eight words a tile."""
    return tiles.rule_tiles(derivation_log(spark, sf_dir), _TILE, "word")


# --- predictors by bitmaps, the scope of an autopsy ----------------------------------------------------------------------------------

_FILTERS: dict[str, tuple[tuple[bitmaps.Holds, ...], str]] = {
    "consonant first": ((bitmaps.Holds(1, "-syl"),), "regexp_matches(word, '^[^aeiou]')"),
    "closed, not after t": ((bitmaps.Holds(-1, "-syl"), bitmaps.Holds(1, "t", absent=True)), "regexp_matches(word, '[^aeiou]$') AND substr(word, 1, 1) <> 't'"),
    "vowel to e": ((bitmaps.Holds(1, "+syl"), bitmaps.Holds(-1, "e")), "regexp_matches(word, '^[aeiou]') AND word LIKE '%e'"),
}
_FILTERED_SQL = " UNION ALL ".join(f"SELECT '{name}' AS filter, word, ld FROM p WHERE {sql}" for name, (_, sql) in _FILTERS.items())


def _index(spark, sf_dir) -> DataFrame:
    return bitmaps.build_index(pairs(words(spark, sf_dir)).select("form", (F.col("ld") > 0).alias("miss")), letter_table())


@register(
    "predictor_bitmaps",
    f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, {_specs_sql()}, f AS ({_FILTERED_SQL}), "
    "t AS (SELECT filter, count(*) AS n, count(*) FILTER (WHERE ld > 0) AS misses FROM f GROUP BY filter), "
    "o AS (SELECT filter, word, ld, unnest([-3, -2, -1, 1, 2, 3]) AS place FROM f), "
    "s AS (SELECT filter, ld, place, CASE WHEN place > 0 THEN substr(word, place, 1) ELSE substr(word, length(word) + 1 + place, 1) END AS sym FROM o WHERE length(word) >= abs(place)), "
    "e AS (SELECT filter, ld, place, sym AS predictor FROM s UNION ALL SELECT filter, ld, place, spec FROM s JOIN specs USING (sym)), "
    "c AS (SELECT filter, place, predictor, count(*) AS have, count(*) FILTER (WHERE ld > 0) AS n11 FROM e GROUP BY ALL) "
    "SELECT filter, CAST(place AS INTEGER) AS place, predictor, n11, have - n11 AS n10, CAST(misses - n11 AS BIGINT) AS n01, n - misses - (have - n11) AS n00 FROM c JOIN t USING (filter)",
)
def predictor_bitmaps(spark, sf_dir):
    """Three filters, one index."""
    index = _index(spark, sf_dir)
    out = [bitmaps.contingency(index, holds).select(F.lit(name).alias("filter"), "*") for name, (holds, _) in _FILTERS.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(
    "subset_bitmaps",
    f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, f AS ({_FILTERED_SQL}), a AS (SELECT count(*) AS n, count(*) FILTER (WHERE ld > 0) AS n_miss FROM p), "
    "s AS (SELECT filter, count(*) AS n_in, count(*) FILTER (WHERE ld > 0) AS n_in_miss FROM f GROUP BY filter) "
    "SELECT filter, n, n_in, n_miss, n_in_miss, round(n_in / n, 8) AS share, round(n_in_miss / n_miss, 8) AS error_share FROM s, a",
)
def subset_bitmaps(spark, sf_dir):
    index = _index(spark, sf_dir)
    out = [bitmaps.subset(index, holds).select(F.lit(name).alias("filter"), "*") for name, (holds, _) in _FILTERS.items()]
    return _rounded(out[0].unionByName(out[1]).unionByName(out[2]), "share", "error_share")


@register(
    "autopsy_scope",
    f"WITH {_WORDS_SQL}, t AS (SELECT substr(word, 1, 1) AS initial, count(*) AS total FROM w GROUP BY 1), m AS (SELECT substr(word, 1, 1) AS initial, length(word) AS l, unnest(range(1, length(word) + 1)) AS i, word FROM w), "
    "e AS (SELECT initial, i, l + 1 - i AS j FROM m WHERE substr(word, i, 1) = 'e'), r AS (SELECT unnest([1, 2, 3]) AS r), sides AS (SELECT unnest(['s', 'e']) AS side), "
    "c AS (SELECT t.initial, side, r, any_value(total) AS total, count(e.initial) FILTER (WHERE CASE WHEN side = 's' THEN i ELSE j END <= r) AS seen FROM t CROSS JOIN sides CROSS JOIN r LEFT JOIN e ON e.initial = t.initial GROUP BY ALL) "
    "SELECT initial, side, CAST(coalesce(min(r) FILTER (WHERE seen / total > 0.32), 4) AS INTEGER) AS radius FROM c GROUP BY ALL",
)
def autopsy_scope(spark, sf_dir):
    """How far to look around every e, for words of each first letter: running counts by radius, for all groups in one job."""
    found = engine.matches(words(spark, sf_dir), letter_table(), pattern("e"))
    rows = found.select(F.substring("word", 1, 1).alias("initial"), "bounds", (F.length("word") + 2).alias("length"))
    return diagnose.scope(rows, by=["initial"])


# --- reports in full ---------------------------------------------------------------------------------------------------------------

_TITLED = [("exact", "acc"), ("within one phone", "acc1"), ("within two phones", "acc2"), ("mean phone distance", "avg_ped")]


def _report_sql(value: str) -> str:
    return " || chr(10) || ".join(f"rpad('{title}', 24, ' ') || {value.replace('@', name)}" for title, name in _TITLED)


@register("accuracy_report_text", f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, a AS (SELECT {_ACC_SQL.replace(', 8)', ', 15)')} FROM p) SELECT {_report_sql("format('{:.8f}', @)")} AS text FROM a")
def accuracy_report_text(spark, sf_dir):
    return metrics.accuracy_report(metrics.accuracy(pairs(words(spark, sf_dir))))


_SIDE_SQL = ", ".join(f"avg(CASE WHEN {s}l <= {k} THEN 1.0 ELSE 0 END) AS {s}_{n}" for s in "bh" for n, k in (("acc", 0), ("acc1", 1), ("acc2", 2))) + ", " + ", ".join(f"avg({s}l / length(gold)) FILTER (WHERE length(gold) > 0) AS {s}_avg_ped" for s in "bh")


@register(
    "comparative_report",
    f"WITH {_WORDS_SQL}, {_pairs_sql('w')}, c AS (SELECT gold, levenshtein(pred, gold) AS bl, levenshtein(replace(pred, 'h', ''), gold) AS hl FROM p), a AS (SELECT {_SIDE_SQL} FROM c) SELECT {_report_sql("format('{:.8f} -> {:.8f}', b_@, h_@)")} AS text FROM a",
)
def comparative_report(spark, sf_dir):
    """All scores of two cascades against the same golds, as text."""
    made = {"pred": cascade(*(s for s, _ in PRED)), "hyp": cascade(*(s for s, _ in PRED), "h > ∅"), "gold": cascade(*(s for s, _ in GOLD))}
    return metrics.comparative_report(metrics.paired_accuracy(engine.apply_many(words(spark, sf_dir), made), CODES))


@register(
    "analysis_file_fed",
    f"WITH RECURSIVE {_WORDS_SQL}, {_pairs_sql('w')}, {_fed_sql()}, c AS (SELECT word, gold, ld, ped, fed, unnest(range(1, length(gold) + 1)) AS i FROM p JOIN al USING (pred, gold) WHERE pred <> '' AND gold <> ''), "
    "e AS (SELECT DISTINCT word, substr(gold, i, 1) AS sym, ld, ped, fed FROM c) SELECT sym, round(avg(CASE WHEN ld > 0 THEN 1.0 ELSE 0 END), 8) AS error_rate, round(avg(ld), 8) AS mean_ld, round(avg(ped), 8) AS mean_ped, round(avg(fed), 8) AS mean_fed FROM e GROUP BY sym",
)
def analysis_file_fed(spark, sf_dir):
    """The analysis file with all of its columns."""
    rows = metrics.with_fed(pairs(words(spark, sf_dir)).where("pred <> '' and gold <> ''"), letter_table(), _DISTANCE)
    return _rounded(metrics.analysis_file(rows), "error_rate", "mean_ld", "mean_ped", "mean_fed")


@register("vector_docfreq", f"WITH {_WORDS_SQL}, {_CHARS}, v(sym, fv) AS (VALUES {', '.join(f"('{s}', '{v}')" for s, v in letter_table().vectors.items())}) SELECT fv, count(DISTINCT word) AS n_words FROM c JOIN v ON sym = substr(word, i, 1) GROUP BY fv")
def vector_docfreq(spark, sf_dir):
    """In how many words a phone of each vector is."""
    return metrics.vector_docfreq(words(spark, sf_dir), letter_table())


# --- symbols of vectors ------------------------------------------------------------------------------------------------------------

#: What a letter takes from the one after it, a doubled one beside: (letters, values).
_TAKES = (("mn", ("+nas",)), ("h", ("+sg",)), ("wuo", ("+lab", "+round")), ("ij", ("+hi", "+front")), ("e", ("+stres", "+prim")), ("z", ("-voi",)), ("x", ("+stres", "-prim", "+long")))


def _set_in(fv: str, spec: str, t) -> str:
    i = t.features.index(spec[1:]) + 1
    return f"substr({fv}, 1, {i - 1}) || '{'2' if spec[0] == '+' else '0'}' || substr({fv}, {i + 1})"


def _vector_expr(join: str) -> str:
    """SQL for the vector of letter x before letter y; `join` is the vector of x alone."""
    t = phonetic_table()
    out = "CASE"
    for letters, specs in _TAKES:
        fv = join
        for spec in specs:
            fv = f"({_set_in(fv, spec, t)})"
        out += f" WHEN y IN ({', '.join(f"'{c}'" for c in letters)}) THEN {fv}"
    return f"{out} WHEN x = y THEN {_set_in(join, '+long', t)} ELSE {join} END"


def _names_sql() -> str:
    t = phonetic_table()
    effect = lambda specs: "".join({f"+{f}": "2", f"-{f}": "0"}.get(next((s for s in specs if s[1:] == f), ""), ".") for f in t.features)
    marks = ", ".join(f"({i}, '{m}', '{effect(specs)}', {m in 'ˈˌ'})" for i, (m, specs) in enumerate(t.diacritics.items()))
    bases = ", ".join(f"({i}, '{s}', '{v}')" for i, (s, v) in enumerate(t.vectors.items()))
    digits = f"range(1, {len(t.features) + 1})"
    return (
        f"WITH RECURSIVE {_WORDS_SQL}, b(place, base, v) AS (VALUES {bases}), m(i, mark, e, front) AS (VALUES {marks}), "
        "k AS (SELECT DISTINCT substr(word, i, 1) AS x, substr(word, i + 1, 1) AS y FROM (SELECT word, unnest(range(1, length(word))) AS i FROM w)), "
        f"f AS (SELECT DISTINCT {_vector_expr('b.v')} AS fv FROM k JOIN b ON b.base = k.x), "
        "known AS (SELECT v, arg_min(base, place) AS base FROM b GROUP BY v), "
        f"u AS (SELECT fv, m.* FROM f JOIN m ON len(list_filter({digits}, lambda p: substr(e, p, 1) <> '.' AND substr(e, p, 1) <> substr(fv, p, 1))) = 0 WHERE fv NOT IN (SELECT v FROM known)), "
        "s(fv, last, idx, es, before, after) AS (SELECT fv, i, [i], [e], CASE WHEN front THEN mark ELSE '' END, CASE WHEN front THEN '' ELSE mark END FROM u UNION ALL "
        "SELECT s.fv, u.i, list_append(idx, u.i), list_append(es, e), before || CASE WHEN front THEN mark ELSE '' END, after || CASE WHEN front THEN '' ELSE mark END FROM s JOIN u ON u.fv = s.fv AND u.i > s.last WHERE len(idx) < 4), "
        f"c AS (SELECT fv, idx, place, before || base || after AS name FROM s JOIN b ON len(list_filter({digits}, lambda p: substr(v, p, 1) <> substr(fv, p, 1) AND len(list_filter(es, lambda e: substr(e, p, 1) = substr(fv, p, 1))) = 0)) = 0 "
        f"AND len(list_filter(es, lambda e: len(list_filter({digits}, lambda p: substr(e, p, 1) <> '.' AND substr(e, p, 1) <> substr(v, p, 1))) = 0)) = 0), "
        "best AS (SELECT fv, arg_min(name, (len(idx), idx, place)) AS name FROM c GROUP BY fv) "
        "SELECT f.fv, coalesce(known.base, best.name, '?') AS symbol FROM f LEFT JOIN known ON known.v = f.fv LEFT JOIN best ON best.fv = f.fv"
    )


@register("vector_names", _names_sql())
def vector_names(spark, sf_dir):
    """Symbols for the vectors of all letters as the letters after them change them."""
    t = phonetic_table()
    pairs_of = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.struct(F.substring("word", i, F.lit(1)).alias("x"), F.substring("word", i + 1, F.lit(1)).alias("y")))
    pairs_in = words(spark, sf_dir).where(F.length("word") > 1).select(F.explode(pairs_of).alias("p")).select("p.*").distinct()
    vector = F.create_map(*(F.lit(x) for kv in t.vectors.items() for x in kv))
    met = pairs_in.withColumn("v", F.element_at(vector, F.col("x"))).where("v is not null")
    return name_vectors(met.select(F.expr(_vector_expr("v")).alias("fv")), t)
