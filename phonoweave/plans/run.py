"""A whole run from files: what a command line takes, as one object; and a session that looks at a run."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.functions.distance import FeatureDistance, symbol_codes
from phonoweave.functions.features import SymbolTable
from phonoweave.operators import diagnose, engine, metrics, stages, whatif
from phonoweave.plans.rules import RuleParser
from phonoweave.sources import lines, readers
from phonoweave.sources.readers import Cascade, Layout


@dataclass(frozen=True)
class RunConfig:
    """Paths of the files, and how distances are taken. Diacritics are off unless a file is named.

    `explicit` leaves implications out, `ignore_stages` all stages. `changes` writes the words that each rule changed, `halt`
    prints scores at each gold stage, `skip_files` writes nothing. The rest only says more on the way.
    """

    symbols: str = "symbols.csv"
    cascade: str = "cascade.txt"
    lexicon: str = "lexicon.txt"
    implications: str | None = None
    diacritics: str | None = None
    out: str | None = None
    id_cost: float = 0.5
    simple_fed: bool = False
    use_form_id: bool = False
    explicit: bool = False
    ignore_stages: bool = False
    changes: bool = False
    halt: bool = False
    skip_files: bool = False
    verbose: bool = False
    debug_stages: bool = False
    debug_rules: bool = False


_VALUES = {"-lex": "lexicon", "-rules": "cascade", "-out": "out", "-symbols": "symbols", "-impl": "implications", "-diacrit": "diacritics", "-idcost": "id_cost"}
_SWITCHES = {"-verbose": "verbose", "-simple_fed": "simple_fed", "-use_form_id": "use_form_id", "-debug_stages": "debug_stages"}
_FLAGS = {"r": "debug_rules", "p": "changes", "e": "explicit", "h": "halt", "i": "ignore_stages", "s": "skip_files"}
#: The files that are read where the option is given without one, or not at all.
_FILES = {"implications": "implications.txt", "diacritics": "diacritics.txt"}


def parse_args(argv: Sequence[str]) -> RunConfig:
    """The configuration of a command line: -lex -rules -out -symbols -impl -diacrit -idcost with a value (-diacrit may stand
    alone), -verbose -simple_FED -use_form_ID -debug_stages, and flags in one word of the letters r p e h i s."""
    found: dict[str, object] = {"implications": _FILES["implications"]}
    at = 0
    while at < len(argv):
        arg = argv[at]
        at += 1
        if (name := _VALUES.get(arg)) is not None:
            if at < len(argv) and not argv[at].startswith("-"):
                found[name] = float(argv[at]) if name == "id_cost" else argv[at]
                at += 1
            elif name == "diacritics":
                found[name] = _FILES[name]
            else:
                raise ValueError(f"{arg} needs a value")
        elif (name := _SWITCHES.get(arg.lower())) is not None:
            found[name] = True
        elif arg.startswith("-") and len(arg) > 1 and all(c in _FLAGS for c in arg[1:]):
            found |= {_FLAGS[c]: True for c in arg[1:]}
        else:
            raise ValueError(f"no option {arg!r}")
    return RunConfig(**found)


@dataclass(frozen=True)
class Run:
    """lexicon with the columns of simulate_lexicon(); layout says which cells are gold."""

    lexicon: DataFrame
    cascade: Cascade
    layout: Layout
    distance: FeatureDistance

    @property
    def codes(self) -> dict[str, str]:
        table = self.cascade.table
        return symbol_codes([*table.vectors, *table.symbols.values()])

    def form_at(self, stage: str | None) -> Column:
        """The words' forms at a stage, as `Input`, at R and a number when so many rules have run, or (None) at the end."""
        if stage is None:
            return F.col("outcome")
        if stage == "Input":
            return F.col("cells")[0]
        names = [s.name for s in self.cascade.stages]
        if stage not in names and stage[:1] == "R" and stage[1:].isdecimal() and int(stage[1:]) <= len(self.cascade.rules):
            return stages.form_at_rule(int(stage[1:]), self.cascade)
        if stage not in names:
            raise ValueError(f"no stage {stage!r}")
        return F.col("stages")[names.index(stage)]["form"]

    def rows(self, stage: str | None = None, pivot: str | None = "Input") -> DataFrame:
        """(etym_id, form at the pivot, pred, gold) at a gold stage or (None) at the end. Rows without either form stay out."""
        names = [s.name for s in self.layout.cascade.golds()]
        column = self.layout.output if stage is None else self.layout.golds[names.index(stage)]
        if column is None:
            raise ValueError("the lexicon has no output column")
        rows = self.lexicon.select("etym_id", self.form_at(pivot).alias("form"), self.form_at(stage).alias("pred"), F.col("cells")[column].alias("gold"))
        return rows.where("pred is not null").where(engine.gold_status(F.col("gold")) == readers.PRESENT_S)

    def pairs(self, stage: str | None = None, fed: bool = True) -> DataFrame:
        """Predicted and observed forms, with distances, at a gold stage or (None) at the end."""
        out = metrics.pair_distances(self.rows(stage).drop("form"), self.codes)
        return metrics.with_alignment(out, self.cascade.table, self.distance) if fed else out

    def write(self, path: str, changes: bool = False) -> None:
        """Rules log, derivations, stages, reports by stage and by rule, and outcomes under a folder; scores by word if there are golds."""
        cascade, layout = self.cascade, self.layout
        readers.write_rules_log(self.lexicon.sparkSession, cascade, f"{path}/rules_log")
        readers.write_table(engine.derivation(self.lexicon), f"{path}/derivation")
        readers.write_table(engine.derivation_text(self.lexicon, cascade), f"{path}/derivation_text")
        readers.write_table(engine.snapshots(self.lexicon), f"{path}/stages")
        readers.write_table(engine.stage_report(self.lexicon, cascade, layout.golds, layout.output), f"{path}/stage_report")
        readers.write_table(engine.rule_report(self.lexicon, cascade), f"{path}/rule_report")
        readers.write_table(self.lexicon.select("etym_id", "form_id", "outcome", "status"), f"{path}/outcome")
        if changes:
            readers.write_table(engine.rule_effects(engine.derivation(self.lexicon)), f"{path}/rule_effects")
        if layout.output is not None:
            scored = metrics.with_fed(metrics.pair_distances(self.rows().drop("form"), self.codes), cascade.table, self.distance)
            readers.write_table(metrics.etymon_distances(scored), f"{path}/distances", "csv")
            readers.write_table(metrics.analysis_file(scored), f"{path}/analysis", "csv")

    def stage_scores(self) -> dict[str, DataFrame]:
        """accuracy() at each gold stage, and at the end if there are golds."""
        at = [s.name for s in self.layout.cascade.golds()][: len(self.layout.golds)]
        return {name or "Output": metrics.accuracy(self.pairs(name, fed=False)) for name in (*at, *([None] if self.layout.output is not None else []))}


@dataclass(frozen=True)
class Session:
    """A run looked at: from a stage of evaluation (None: the end), through a filter on the words' forms at a pivot.

    at(), pivoted(), filtered() and unfiltered() give a new session; all else is a table.
    """

    run: Run
    stage: str | None = None
    pivot: str | None = "Input"
    items: tuple | None = None

    def at(self, stage: str | None) -> Session:
        if stage is not None and stage not in [s.name for s in self.run.layout.cascade.golds()]:
            raise ValueError(f"no gold stage {stage!r}")
        return replace(self, stage=stage)

    def pivoted(self, stage: str | None) -> Session:
        self.run.form_at(stage)
        return replace(self, pivot=stage)

    def filtered(self, pattern: str) -> Session:
        """Through the words whose form at the pivot holds a match of context elements."""
        return replace(self, items=RuleParser(self.run.cascade.table).context(pattern).items)

    def unfiltered(self) -> Session:
        return replace(self, items=None)

    def pairs(self) -> DataFrame:
        """(etym_id, form, pred, gold, ld, ...) of the words that pass."""
        rows = self.run.rows(self.stage, self.pivot)
        if self.pivot != "Input":  # rules may have made symbols that no word came with
            self.run.cascade.table.prepare(readers.distinct_symbols(rows.where("form is not null"), "form"))
        if self.items is not None:
            rows = engine.filter_words(rows.where("form is not null"), self.run.cascade.table, self.items)
        return metrics.pair_distances(rows, self.run.codes)

    def accuracy(self, fed: bool = False) -> DataFrame:
        out = self.pairs()
        return metrics.accuracy(metrics.with_fed(out, self.run.cascade.table, self.run.distance) if fed else out)

    def report(self) -> DataFrame:
        return metrics.accuracy_report(self.accuracy(fed=True))

    def errors(self, side: str = "gold") -> DataFrame:
        """errors_by_phone() of pred, gold or form (the pivot)."""
        return metrics.errors_by_phone(self.pairs().where("form is not null"), side)

    def mismatches(self, sequence: Sequence[str] = (), side: str = "gold") -> DataFrame:
        return metrics.mismatches(self.pairs(), sequence, side)

    def aligned(self) -> DataFrame:
        return metrics.with_alignment(self.pairs().where("ld > 0"), self.run.cascade.table, self.run.distance)

    def confusions(self, k: int = 5) -> DataFrame:
        return diagnose.top_confusions(diagnose.confusions(self.aligned()), k)

    def confusion(self, res: str, gold: str, share: float = 0.2) -> DataFrame:
        """prognosis() of the places around a confusion, without what all the golds have in common."""
        table = self.run.cascade.table
        inactive = diagnose.inactive_features(metrics.phones(self.run.rows(self.stage), "gold").select("sym"), table)
        return diagnose.prognosis(diagnose.confusion_contexts(self.aligned(), res, gold), table, share, inactive)

    def autopsy(self, mode: str = "f", n: int = 5) -> DataFrame:
        """top_predictors() of misses around the filter's matches, as far as autopsy_scope() reaches."""
        if self.items is None:
            raise ValueError("set a filter first")
        table = self.run.cascade.table
        found = engine.matches(self.pairs().where("form is not null"), table, self.items).withColumn("miss", F.col("ld") > 0)
        ctx = diagnose.contexts_in_scope(found.withColumn("length", F.size(F.split("form", " ")) + 2), table)
        return diagnose.top_predictors(diagnose.scored(diagnose.contingency(ctx), mode), n)

    def shares(self) -> DataFrame:
        """subset_shares() of the filter among all words of the stage."""
        if self.items is None:
            raise ValueError("set a filter first")
        rows = metrics.pair_distances(self.run.rows(self.stage, self.pivot).where("form is not null"), self.run.codes)
        inside = F.size(F.col("bounds")) > 0
        return diagnose.subset_shares(engine.matches(rows, self.run.cascade.table, self.items), inside, F.col("ld") > 0)

    def word(self, form: str) -> DataFrame:
        """(etym_id, derivation) of the words of an input form."""
        return engine.derivation_text(self.run.lexicon.where(F.col("cells")[0] == form), self.run.cascade)

    def rule(self, text: str) -> dict[int, str]:
        """Numbers and standard texts of the rules that hold a text."""
        return {i: str(self.run.cascade.rules[i]) for i in self.run.cascade.find(text)}

    def changed(self, rule: int) -> DataFrame:
        return engine.changed_words(engine.derivation(self.run.lexicon), rule)

    def propose(self, edits: Sequence[whatif.Edit]) -> tuple[whatif.Hypothesis, DataFrame]:
        """(hypothesis, scores of both cascades at each gold stage and the end)."""
        h, layout = whatif.propose(self.run.cascade, edits), self.run.layout
        return h, whatif.stage_results(self.run.lexicon.select("etym_id", "cells"), h, self.run.codes, layout.golds, layout.output)


def load_table(spark: SparkSession, config: RunConfig) -> SymbolTable:
    table = SymbolTable.from_lines(readers.read_lines(spark, config.symbols))
    if config.implications and not config.explicit:
        table.read_implications(readers.read_lines(spark, config.implications))
    if config.diacritics:
        table.read_diacritics(readers.read_lines(spark, config.diacritics))
    return table


def run(spark: SparkSession, config: RunConfig) -> Run:
    """Reads the files, defines every symbol of the lexicon, and plans the simulation.

    The lexicon may be a file, a folder or a pattern of files, of any size: its words are numbered where they are.
    """
    table = load_table(spark, config)
    cascade = readers.read_cascade(readers.read_lines(spark, config.cascade), table)
    text = F.trim(F.substring_index("value", readers.COMMENT, 1))
    first = lines.first_line(spark, config.lexicon, text != "") or ""
    layout = readers.resolve_header(first, cascade)
    if config.ignore_stages:  # the columns of stages stay unread
        layout = replace(layout, cascade=replace(layout.cascade, stages=()), golds=())
    etyma = (text != "") & ~text.startswith(readers.BLACK) if layout.header else text != ""
    numbered = lines.numbered_lines(spark, config.lexicon, etyma).where("line_no is not null")
    lexicon = readers.read_lexicon(spark, lines.decomposed(numbered), config.use_form_id, layout.header)
    readers.check_columns(lexicon)
    table.prepare(readers.distinct_symbols(lexicon))
    cascade = replace(layout.cascade, table=table)
    weights = tuple(table.weights) if table.weights else None
    out = Run(engine.simulate_lexicon(lexicon, cascade, layout.golds), cascade, layout, FeatureDistance(len(table.features), config.id_cost, weights, config.simple_fed))
    if config.out and not config.skip_files:
        out.write(config.out, config.changes)
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> Run:
    """The command line: runs, writes, and prints the scores."""
    config = parse_args(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("phonoweave").getOrCreate()
    done = run(spark, config)
    if config.verbose or config.debug_stages:
        for s in done.cascade.stages:
            print(f"{s.kind} {s.name}: after {s.instant} rules")
    if config.verbose or config.debug_rules:
        for i, r in enumerate(done.cascade.rules):
            print(f"{i} : {r}")
    scores = done.stage_scores()
    for name, table in scores.items():
        if config.halt or name == "Output":
            print(name, metrics.accuracy_text(table).first().text, sep="\t")
    return done


if __name__ == "__main__":
    main()
