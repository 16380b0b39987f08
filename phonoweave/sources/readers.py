"""Files in and out: cascades, lexicons, their header, and the tables that a run writes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoweave.functions.features import RuleError, SymbolTable, norm
from phonoweave.plans.rules import COMMENT, Rule, RuleParser

GOLD, BLACK = "~", "="
FORM_ID = "ɸ"
ABSENT, UNATTESTED = ("--", "{ABSENT}"), (">*", "{UNATTESTED}")
PRESENT_S, ABSENT_S, UNATTESTED_S = "present", "absent", "unattested"
COMMENT_COLUMN = 150


@dataclass(frozen=True)
class Stage:
    """kind g (gold, compared with observed forms) or b (black); instant: rules before it."""

    name: str
    kind: str
    instant: int


@dataclass(frozen=True)
class Cascade:
    """Rules in order with the stages between them."""

    rules: tuple[Rule, ...]
    stages: tuple[Stage, ...]
    table: SymbolTable
    lines: tuple[str, ...] = ()
    line_rules: tuple[tuple[int, ...], ...] = field(default=())

    def stage_order(self) -> list[str]:
        """g0, b0, g1, ...: kinds in order, each numbered for itself."""
        seen = {"g": 0, "b": 0}
        out = []
        for s in self.stages:
            out.append(f"{s.kind}{seen[s.kind]}")
            seen[s.kind] += 1
        return out

    def stage_at(self, instant: int) -> str:
        """The name of the last stage at or before an instant, or Input."""
        return next((s.name for s in reversed(self.stages) if s.instant <= instant), "Input")

    def golds(self) -> list[Stage]:
        return [s for s in self.stages if s.kind == "g"]

    def blacken(self, name: str) -> Cascade:
        """The gold stage of a name made black."""
        if name not in [s.name for s in self.golds()]:
            raise RuleError(f"no gold stage {name!r}")
        return replace(self, stages=tuple(replace(s, kind="b") if s.name == name else s for s in self.stages))

    def find(self, text: str) -> list[int]:
        """Indexes of the rules whose text or standard form holds the given text."""
        return [i for i, r in enumerate(self.rules) if text in r.text or text in str(r)]

    def rules_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, r.uid, r.text, str(r), r.kind) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_idx int, rule_uid string, orig string, canonical string, kind string")

    def stages_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, s.kind, s.name, s.instant) for i, s in enumerate(self.stages)], "seq int, type string, name string, instant int")


def read_cascade(lines: Sequence[str], table: SymbolTable) -> Cascade:
    """A rule or a stage flag a line; `$` begins a comment; blank lines count only as lines."""
    parser, rules, stages, owners = RuleParser(table), [], [], []
    for n, line in enumerate(lines):
        text = line.split(COMMENT)[0].strip()
        owned: list[int] = []
        if text[:1] in (GOLD, BLACK):
            name = text[1:].strip()
            if not name or name in [s.name for s in stages]:
                raise RuleError(f"line {n + 1}: a stage has a name of its own")
            stages.append(Stage(name, "g" if text[0] == GOLD else "b", len(rules)))
        elif text:
            try:
                made = parser.parse(text, uid=f"L{n}")
            except RuleError as e:
                raise RuleError(f"line {n + 1}: {e}") from None
            owned = [*range(len(rules), len(rules) + len(made))]
            rules += made
        owners.append(tuple(owned))
    return Cascade(tuple(rules), tuple(stages), table, tuple(lines), tuple(owners))


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of one small UTF-8 file in order. A file is read whole, so that its lines stay in order in a cluster."""
    return [x for r in spark.read.text(path, wholetext=True).collect() for x in r.value.split("\n")]


def column_count(line: str) -> int:
    return line.split(COMMENT)[0].count(",") + 1


@dataclass(frozen=True)
class Layout:
    """What the columns of a lexicon are: the input, gold stages in order, and maybe the output."""

    cascade: Cascade
    golds: tuple[int, ...]  # column of each gold stage
    output: int | None
    header: bool


def resolve_header(first: str, cascade: Cascade) -> Layout:
    """Columns by the header `=Input, Stage, ...` if there is one, else by number. Gold stages without a column go black.

    With a header, a column named as a gold stage is that stage; a last column of another name, or named modern or output,
    is the output. Without one, as many columns as gold stages and one are the golds; one more is the output; two columns
    are input and output; other numbers are errors.
    """
    cells = [c.strip() for c in first.split(COMMENT)[0].split(",")]
    golds = cascade.golds()
    if cells[0].startswith(BLACK):
        at = {name.lower(): i for i, name in enumerate(cells) if i}
        for g in golds:
            if g.name.lower() not in at:
                cascade = cascade.blacken(g.name)
        columns = tuple(at[g.name.lower()] for g in cascade.golds())
        if sorted(columns) != list(columns):
            raise RuleError("columns are not in the order of their stages")
        rest = [i for i in range(1, len(cells)) if i not in columns]
        if len(rest) > 1 or (rest and rest[0] != len(cells) - 1):
            raise RuleError(f"no gold stage is named {cells[rest[0]]!r}")
        return Layout(cascade, columns, rest[0] if rest else None, True)
    n = len(cells)
    if n in (len(golds) + 1, len(golds) + 2):
        return Layout(cascade, tuple(range(1, len(golds) + 1)), n - 1 if n == len(golds) + 2 else None, False)
    if n <= 2:
        for g in golds:
            cascade = cascade.blacken(g.name)
        return Layout(cascade, (), 1 if n == 2 else None, False)
    raise RuleError(f"{n} columns for {len(golds)} gold stages, and no header")


LEXICON = "etym_id long, form_id string, cells array<string>"


def read_lexicon(spark: SparkSession, lines: Sequence[str] | DataFrame, use_form_id: bool = False, header: bool = False) -> DataFrame:
    """etym_id (line number without blank lines and header), form_id, cells (forms with single blanks).

    `lines` is a list, or a DataFrame (line_no, value) of canonically decomposed text for large files. Lines of another number of columns are an error,
    raised when the rows are read. The form id is what follows the last ɸ, if it is asked for.
    """
    if not isinstance(lines, DataFrame):
        lines = spark.createDataFrame([(i, norm(x)) for i, x in enumerate(lines)], "line_no long, value string")
    text = F.trim(F.substring_index("value", COMMENT, 1))
    form_id = F.when(F.instr(text, FORM_ID) > 0, F.trim(F.substring_index(text, FORM_ID, -1))) if use_form_id else F.lit(None).cast("string")
    rows = lines.select("line_no", form_id.alias("form_id"), (F.substring_index(text, FORM_ID, 1) if use_form_id else text).alias("text")).where("text <> ''")
    if header:
        rows = rows.where(~F.col("text").startswith(BLACK))
    cells = F.transform(F.split("text", ","), lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    return rows.select(F.col("line_no").alias("etym_id"), "form_id", cells.alias("cells"))


def check_columns(lexicon: DataFrame) -> int:
    """The number of columns of all rows; an error if they differ."""
    row = lexicon.agg(F.min(F.size("cells")).alias("lo"), F.max(F.size("cells")).alias("hi")).first()
    if row.lo != row.hi:
        raise RuleError(f"rows of {row.lo} and of {row.hi} columns")
    return row.lo or 0


def status(cell):
    """present, absent or unattested, by the mark in a cell."""
    return F.when(cell.isin(*ABSENT), ABSENT_S).when(cell.isin(*UNATTESTED), UNATTESTED_S).otherwise(PRESENT_S)


def distinct_symbols(lexicon: DataFrame, column: str = "cells") -> list[str]:
    """All symbols of all cells but marks and boundaries. Their number is that of an inventory, not of the words."""
    cells = F.col(column) if dict(lexicon.dtypes)[column].startswith("array") else F.array(column)
    symbols = lexicon.select(F.explode(F.filter(cells, lambda c: status(c) == PRESENT_S)).alias("c")).select(F.explode(F.split("c", " ")).alias("s"))
    return sorted(r.s for r in symbols.where("s not in ('', '#', '+')").distinct().collect())


# --- sinks -------------------------------------------------------------------------------------------------------------------


def write_rules_log(spark: SparkSession, cascade: Cascade, path: str) -> None:
    """Standard texts of the rules, one a line, in one file: a cascade is small."""
    cascade.rules_df(spark).orderBy("rule_idx").select("canonical").coalesce(1).write.text(path)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("errorifexists").option("header", True).format(form).save(path)


def diff_lines(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, line_no, line of what only one of two (line_no, line) tables has."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))


def standard_comment(text: str, width: int = COMMENT_COLUMN) -> str:
    """A comment in `$` lines of at most `width` code points, cut at blanks."""
    words, out = re.sub(r"^\s*\$\s*", "", text).replace("\n", " ").split(), []
    line = COMMENT
    for w in words:
        if len(line) + len(w) + 1 > width and line != COMMENT:
            out.append(line)
            line = COMMENT
        line += (" " if line != COMMENT else " ") + w
    return "\n".join([*out, line])


def is_standard_comment(text: str, width: int = COMMENT_COLUMN) -> bool:
    return all(x.startswith(COMMENT) and len(x) <= width for x in text.split("\n"))


FORMS = T.StructType([T.StructField("etym_id", T.LongType()), T.StructField("cells", T.ArrayType(T.StringType()))])


def forms(rows: Iterable[tuple[int, list[str]]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rows), FORMS)
