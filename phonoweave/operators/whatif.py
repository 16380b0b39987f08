"""What a change of the cascade would do: edits on an ordered list of rules and stages, and the two runs side by side."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonoweave.functions.features import RuleError
from phonoweave.plans.kernel import Kernel
from phonoweave.plans.rules import COMMENT, Rule, RuleParser
from phonoweave.sources.readers import BLACK, GOLD, PRESENT_S, Cascade, Stage, read_cascade, standard_comment

from .engine import STEP, _appended, _each_form, bare, gold_status, simulate_lexicon, steps_of
from .metrics import paired_accuracy


class MidDisjunctionError(RuleError):
    """A rule that shares its line with others cannot be edited in the file alone."""


@dataclass(frozen=True)
class Edit:
    """op: insert (law before rule `at`), delete, modify (law in place of it) or relocate (to before rule `to`).

    Indexes are those of the cascade as edited so far. An insertion or relocation to where a stage is goes after the stage,
    or before it with `before_stage`.
    """

    op: str
    at: int
    to: int | None = None
    law: str | None = None
    before_stage: bool = False
    comment: str | None = None


@dataclass(frozen=True)
class Hypothesis:
    base: Cascade
    cascade: Cascade
    edits: tuple[Edit, ...]
    touched: frozenset  # uids of rules that an edit made, moved or took away

    def base_to_hyp(self) -> list[int]:
        """For each rule of the base its index in the hypothesis, -1 without one."""
        at = {r.uid: i for i, r in enumerate(self.cascade.rules)}
        return [at.get(r.uid, -1) for r in self.base.rules]

    def hyp_to_base(self) -> list[int]:
        at = {r.uid: i for i, r in enumerate(self.base.rules)}
        return [at.get(r.uid, -1) for r in self.cascade.rules]

    def global_order(self) -> dict[str, int]:
        """One index for every rule of both: rules of the hypothesis in order, a deleted one where it stood.

        A relocated rule has one place, the new one.
        """
        hyp, out = [r.uid for r in self.cascade.rules], []
        have = set(hyp)
        base = [r.uid for r in self.base.rules]
        lost_before: dict[str | None, list[str]] = {}
        waiting: list[str] = []
        for uid in base:
            if uid in have:
                if waiting:
                    lost_before[uid] = waiting
                    waiting = []
            else:
                waiting.append(uid)
        lost_before[None] = waiting
        for uid in hyp:
            out += [*lost_before.get(uid, ()), uid]
        out += lost_before[None]
        return {uid: i for i, uid in enumerate(out)}

    def fork(self) -> int:
        """The first place at which the cascades differ: all before it may be taken from the base run."""
        for i, (a, b) in enumerate(zip(self.base.rules, self.cascade.rules, strict=False)):
            if a.uid != b.uid or str(a) != str(b):
                return i
        return min(len(self.base.rules), len(self.cascade.rules))


def _items(cascade: Cascade) -> list[Rule | Stage]:
    out: list[Rule | Stage] = []
    stages = list(cascade.stages)
    for i, rule in enumerate(cascade.rules):
        while stages and stages[0].instant <= i:
            out.append(stages.pop(0))
        out.append(rule)
    return out + stages


def _cascade(items: Sequence[Rule | Stage], like: Cascade) -> Cascade:
    rules, stages = [], []
    for x in items:
        if isinstance(x, Stage):
            stages.append(replace(x, instant=len(rules)))
        else:
            rules.append(x)
    return replace(like, rules=tuple(rules), stages=tuple(stages), lines=(), line_rules=())


def _with_lines(cascade: Cascade, base: Cascade, edits: Sequence[Edit]) -> Cascade:
    """The edited cascade with its lines; without, where an edit cannot be made in the file, which rewrite() then tells."""
    if base.rules and not base.lines:
        return cascade
    try:
        lines = _edited_lines(base, edits)
    except MidDisjunctionError:
        return cascade
    owners, n = [], 0
    for _, size in lines:
        owners.append(tuple(range(n, n + size)))
        n += size
    return replace(cascade, lines=tuple(x for x, _ in lines), line_rules=tuple(owners))


def _place(items: list, at: int, before_stage: bool) -> int:
    """Where in the list a rule goes to become rule `at`."""
    n = sum(isinstance(x, Rule) for x in items)
    if not 0 <= at <= n:
        raise RuleError(f"no place {at} among {n} rules")
    seen = 0
    for i, x in enumerate(items):
        if isinstance(x, Rule):
            if seen == at:
                return i
            seen += 1
        elif seen == at and before_stage:
            return i
    return len(items)


def propose(base: Cascade, edits: Sequence[Edit]) -> Hypothesis:
    """The cascade with the edits made in order. A rule that an edit has touched cannot be edited again."""
    items, touched, parser = _items(base), set(), RuleParser(base.table)
    for n, e in enumerate(edits):
        if e.op == "insert":
            made = parser.parse(e.law or "", uid=f"E{n}")
            if not made:
                raise RuleError("nothing to insert")
            i = _place(items, e.at, e.before_stage)
            items[i:i] = made
            touched |= {r.uid for r in made}
            continue
        rules = [(i, x) for i, x in enumerate(items) if isinstance(x, Rule)]
        if not 0 <= e.at < len(rules):
            raise RuleError(f"no rule {e.at}")
        i, rule = rules[e.at]
        if rule.uid in touched:
            raise RuleError(f"rule {e.at} has been edited already")
        touched.add(rule.uid)
        if e.op == "delete":
            del items[i]
        elif e.op == "modify":
            made = parser.parse(e.law or "", uid=f"E{n}")
            if not made:
                raise RuleError("nothing in its place; delete the rule instead")
            made[0] = replace(made[0], uid=rule.uid)
            touched |= {r.uid for r in made}
            items[i : i + 1] = made
        elif e.op == "relocate":
            if e.to is None:
                raise RuleError("where to?")
            del items[i]
            items.insert(_place(items, e.to - (e.to > e.at), e.before_stage), rule)
        else:
            raise RuleError(f"no edit {e.op!r}")
    return Hypothesis(base, _with_lines(_cascade(items, base), base, edits), tuple(edits), frozenset(touched))


_LOG = T.ArrayType(STEP)


def run_both(df: DataFrame, h: Hypothesis, form: str = "form", start: int = 0, tried: Accumulator | None = None) -> DataFrame:
    """`df` with fork (the form where the cascades part), base_outcome, base_log, hyp_outcome and hyp_log from there.

    One Arrow stage for both cascades; what they have in common before the fork is run once. The forms are those after `start`
    rules, at most as many as come before the fork. `tried` counts the rules of each form that is run, on either side.
    """
    at, table = h.fork(), h.base.table
    if start > at:
        raise ValueError("the cascades part before the forms' instant")
    common, base, hyp = h.base.rules[start:at], h.base.rules[at:], h.cascade.rules[at:]
    step = pa.list_(pa.struct([("rule_idx", pa.int32()), ("before", pa.string()), ("after", pa.string())]))
    fields = (("fork", pa.string(), T.StringType()), ("base_outcome", pa.string(), T.StringType()), ("base_log", step, _LOG), ("hyp_outcome", pa.string(), T.StringType()), ("hyp_log", step, _LOG))

    def run(batches):
        kernel = Kernel(table)

        def made(f: str) -> tuple:
            word = kernel.run(common, table.word(f))[0]
            if tried is not None:
                tried.add(len(common) + max(len(base), len(hyp)))
            sides = [kernel.run(rules, word) for rules in (base, hyp)]
            return bare(word), *(x for last, steps, _ in sides for x in (bare(last), steps_of(steps, at)))

        of = _each_form(made)
        for batch in batches:
            out = of(batch.column(form))
            yield _appended(batch, [pa.array([None if o is None else o[i] for o in out], t) for i, (_, t, _) in enumerate(fields)], [n for n, _, _ in fields])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, _, t in fields)]))


def _looked_up(log: Column, at: Column) -> Column:
    return F.transform(log, lambda x: F.get(at, x["rule_idx"]))


def with_differences(both: DataFrame, h: Hypothesis) -> DataFrame:
    """`both` with diffs: (global_idx, rule_uid, base_before, base_after, hyp_before, hyp_after) of each step that differs, in order.

    The two logs are compared in the row; nothing is joined or shuffled. A side's forms are null where it has no such step.
    """
    order = h.global_order()
    names = F.array(*(F.lit(u) for u, _ in sorted(order.items(), key=lambda x: x[1])))
    places = {"base": [order[r.uid] for r in h.base.rules], "hyp": [order[r.uid] for r in h.cascade.rules]}
    step = {s: F.col(f"{s}_log") for s in places}
    at = {s: F.array(*map(F.lit, p)).cast("array<int>") for s, p in places.items()}
    globals_ = {s: _looked_up(step[s], at[s]) for s in places}
    keys = F.array_sort(F.array_union(globals_["base"], globals_["hyp"]))

    def of(side: str, g: Column, name: str) -> Column:
        return F.get(step[side], (F.array_position(globals_[side], g) - 1).cast("int"))[name]

    every = F.transform(keys, lambda g: F.struct(g.alias("global_idx"), F.get(names, g).alias("rule_uid"), *(of(s, g, n).alias(f"{s}_{n}") for s in places for n in ("before", "after"))))
    differ = F.filter(every, lambda x: ~(x["base_before"].eqNullSafe(x["hyp_before"]) & x["base_after"].eqNullSafe(x["hyp_after"])))
    return both.withColumn("diffs", differ)


def differential(both: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    """(key, rule_uid, global_idx, base_before, base_after, hyp_before, hyp_after): steps of either run that differ."""
    each = with_differences(both, h).select(key, F.explode("diffs").alias("x"))
    return each.select(key, "x.rule_uid", "x.global_idx", "x.base_before", "x.base_after", "x.hyp_before", "x.hyp_after")


def fed_bled(diff: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    """(key, rule_uid, global_idx, effect): fed where only the hypothesis fires an unedited rule, bled where only the base does."""
    effect = F.when(F.col("base_after").isNull(), "fed").when(F.col("hyp_after").isNull(), "bled")
    kept = diff.where(~F.col("rule_uid").isin(*h.touched)) if h.touched else diff
    return kept.withColumn("effect", effect).where("effect is not null").select(key, "rule_uid", "global_idx", "effect")


def divergence(both: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    """(key, first_idx): where a word's derivations part."""
    return with_differences(both, h).where(F.size("diffs") > 0).select(key, F.col("diffs")[0]["global_idx"].alias("first_idx"))


def domino_words(both: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    """(rule_uid, key): each changed word under the rule at which it parts."""
    return with_differences(both, h).where(F.size("diffs") > 0).select(F.col("diffs")[0]["rule_uid"].alias("rule_uid"), key)


def dominoes(both: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    """(rule_uid, n_words, first_key): how many words part at a rule. Their keys, which may be many, are in domino_words()."""
    return domino_words(both, h, key).groupBy("rule_uid").agg(F.count("*").alias("n_words"), F.min(key).alias("first_key"))


def affected(both: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    return with_differences(both, h).where(F.size("diffs") > 0).select(key).orderBy(key)


def changed_outcomes(both: DataFrame, key: str = "etym_id") -> DataFrame:
    return both.where(~F.col("base_outcome").eqNullSafe(F.col("hyp_outcome"))).select(key, "base_outcome", "hyp_outcome")


def basic_results(both: DataFrame, h: Hypothesis, key: str = "etym_id") -> DataFrame:
    """(global_idx, rule_uid, edited, n_only_base, n_only_hyp, n_otherwise, first_key): what the edits do, by rule.

    Of an edited rule, steps of the base alone are aborted by the edit and steps of the hypothesis alone caused by it; of the
    others they are bled and fed. n_otherwise are steps that both make with other forms. The least global_idx is where the
    cascades' effects part.
    """
    only = lambda a, b: F.count_if(F.col(f"{a}_after").isNotNull() & F.col(f"{b}_after").isNull())
    counts = differential(both, h, key).groupBy("global_idx", "rule_uid").agg(only("base", "hyp").alias("n_only_base"), only("hyp", "base").alias("n_only_hyp"), F.count_if(F.col("base_after").isNotNull() & F.col("hyp_after").isNotNull()).alias("n_otherwise"), F.min(key).alias("first_key"))
    return counts.select("global_idx", "rule_uid", F.col("rule_uid").isin(*h.touched).alias("edited") if h.touched else F.lit(False).alias("edited"), "n_only_base", "n_only_hyp", "n_otherwise", "first_key")


def stage_results(lexicon: DataFrame, h: Hypothesis, codes: dict[str, str], gold_columns: Sequence[int] = (), output: int | None = None) -> DataFrame:
    """(seq, stage, and paired_accuracy() of base and hypothesis) at each gold stage with a column, and at the end.

    Both cascades are run over the lexicon (etym_id, cells) with what comes and goes at gold stages; one aggregation for all
    stages. Words without a form on either side or without an attested gold do not count.
    """
    columns = [*gold_columns]
    golds = [i for i, s in enumerate(h.base.stages) if s.kind == "g"][: len(columns)]
    renamed = {c: f"base_{c}" for c in ("outcome", "status", "stages", "log")}
    both = simulate_lexicon(simulate_lexicon(lexicon, h.base, columns).withColumnsRenamed(renamed), h.cascade, columns)
    hyp_at = [i for i, s in enumerate(h.cascade.stages) if s.kind == "g"]
    at = [F.struct(F.lit(n).alias("seq"), F.lit(h.base.stages[i].name).alias("stage"), F.col("base_stages")[i]["form"].alias("pred"), F.col("stages")[j]["form"].alias("hyp"), F.col("cells")[c].alias("gold")) for n, (i, j, c) in enumerate(zip(golds, hyp_at, columns, strict=False))]
    if output is not None:
        at.append(F.struct(F.lit(len(golds)).alias("seq"), F.lit("Output").alias("stage"), F.col("base_outcome").alias("pred"), F.col("outcome").alias("hyp"), F.col("cells")[output].alias("gold")))
    if not at:
        raise ValueError("no column has golds")
    rows = both.select(F.explode(F.array(*at)).alias("x")).select("x.*").where((gold_status(F.col("gold")) == PRESENT_S) & F.col("pred").isNotNull() & F.col("hyp").isNotNull())
    return paired_accuracy(rows, codes, by=["seq", "stage"])


# --- the file ----------------------------------------------------------------------------------------------------------------


def rewrite(base: Cascade, edits: Sequence[Edit], placeholders: bool = False) -> list[str]:
    """The cascade's lines with the edits made, comments and stages kept. propose() must allow the edits.

    A line that makes several rules can only be edited or parted as a whole, so other edits of it raise MidDisjunctionError;
    so does a cascade that has no lines. With `placeholders` rules stay as they are, and a comment stands where an edit is
    to be made by hand, above the line of its rule.
    """
    h = propose(base, edits)
    if not base.lines and base.rules:
        raise MidDisjunctionError("the cascade has no lines of a file")
    if placeholders:
        return _marked_lines(base, edits)
    if not h.cascade.lines and h.cascade.rules:
        _edited_lines(base, edits)  # raises and tells why
    return list(h.cascade.lines)


def accept(h: Hypothesis) -> Cascade:
    """The hypothesis as the new base: its lines read anew, so that its rules can be edited, and the lines can be written."""
    lines = rewrite(h.base, h.edits)
    out = read_cascade(lines, h.base.table)
    if [str(r) for r in out.rules] != [str(r) for r in h.cascade.rules] or [(s.name, s.instant) for s in out.stages] != [(s.name, s.instant) for s in h.cascade.stages]:
        raise RuleError("the lines do not make the hypothesis")
    blackened = {s.name for s in h.cascade.stages if s.kind == "b"}
    for s in out.golds():
        if s.name in blackened:
            out = out.blacken(s.name)
    return out


def _describe(e: Edit) -> str:
    return e.comment or {"insert": f"insert here: {e.law}", "delete": "delete this rule", "modify": f"in place of this rule: {e.law}", "relocate": f"move this rule to {e.to}"}[e.op]


def _marked_lines(base: Cascade, edits: Sequence[Edit]) -> list[str]:
    notes: dict[int, list[str]] = {}
    index = {r.uid: i for i, r in enumerate(base.rules)}
    for n, e in enumerate(edits):
        now = propose(base, edits[:n]).cascade.rules
        rule = next((index[r.uid] for r in now[e.at :] if r.uid in index), len(base.rules))
        line = next((i for i, own in enumerate(base.line_rules) if rule in own), len(base.lines))
        notes.setdefault(line, []).append(standard_comment(_describe(e)))
    out: list[str] = []
    for i in range(len(base.lines) + 1):
        out += [x for note in notes.get(i, ()) for x in note.split("\n")]
        out += base.lines[i : i + 1]
    return out


def _edited_lines(base: Cascade, edits: Sequence[Edit]) -> list[tuple[str, int]]:
    """(line, number of its rules) with the edits made."""
    lines = [(text, len(owned)) for text, owned in zip(base.lines, base.line_rules, strict=True)]
    parser = RuleParser(base.table)

    def line_of(rule: int) -> int:
        seen = 0
        for i, (_, n) in enumerate(lines):
            if n and seen == rule:
                return i
            if seen < rule < seen + n:
                raise MidDisjunctionError(f"rule {rule} is inside the line {lines[i][0]!r}")
            seen += n
        if seen == rule:
            return len(lines)
        raise RuleError(f"no rule {rule}")

    def before(rule: int, before_stage: bool) -> int:
        i = line_of(rule)
        if before_stage:
            while i and not lines[i - 1][1]:
                i -= 1
                if lines[i][0].strip()[:1] in (GOLD, BLACK):
                    return i
            return line_of(rule)
        while i and not lines[i - 1][1] and lines[i - 1][0].strip().startswith(COMMENT):
            i -= 1  # a comment right above belongs to its rule
        return i

    def law(e: Edit) -> list[tuple[str, int]]:
        notes = [(x, 0) for x in standard_comment(e.comment).split("\n")] if e.comment else []
        return [*notes, (e.law, len(parser.parse(e.law)))]

    for e in edits:
        if e.op == "insert":
            i = before(e.at, e.before_stage)
            lines[i:i] = law(e)
            continue
        i = line_of(e.at)
        if lines[i][1] > 1:
            raise MidDisjunctionError(f"rule {e.at} shares the line {lines[i][0]!r}")
        if e.op == "delete":
            del lines[i]
        elif e.op == "modify":
            lines[i : i + 1] = law(e)
        else:
            moved = lines.pop(i)
            lines.insert(before(e.to - (e.to > e.at), e.before_stage), moved)
    return lines
