"""Runs over tables, scores, what-if runs, files: on small words of our own."""

import random

import pytest
from pyspark.sql import functions as F

from phonoweave.functions.distance import EDGE_GAP, GAP, FeatureDistance, levenshtein, symbol_codes, symbol_vectors
from phonoweave.functions.features import RuleError, SymbolTable, norm
from phonoweave.functions.inventory import letter_table, phonetic_table
from phonoweave.operators import diagnose, engine, metrics, whatif
from phonoweave.plans import bounds as bounds_module
from phonoweave.plans.rules import RuleParser, match_bounds
from phonoweave.sources import readers
from phonoweave.sources.readers import read_cascade, read_lexicon, resolve_header
from phonoweave.streaming.cascade_stream import stream_cascade

CASCADE = ["$ an example", "[+nas] > m / __ [+lab,+cons]", "~Early", "a > e / __ ( [+cons] ) i", "=Mid", "$ final loss", "i > ∅ / [+cons] __ #", "{t;k} > {d;ɡ} / [+syl] __ [+syl]", "~Late", "e > i"]


def cascade():
    return read_cascade(CASCADE, phonetic_table())


def lex(spark, *lines):
    return read_lexicon(spark, list(lines))


def test_simulation_and_log(spark):
    run = engine.simulate_lexicon(lex(spark, "k a n p i", "t a t i $ c", "", "o"), cascade()).orderBy("etym_id").collect()
    assert [r.etym_id for r in run] == [0, 1, 3] and [r.outcome for r in run] == ["k a m p", "t i t", "o"]
    first = run[0]
    assert [(s.stage, s.type, s.form) for s in first.stages] == [("Early", "g", "k a m p i"), ("Mid", "b", "k a m p i"), ("Late", "g", "k a m p")]
    assert [(x.rule_idx, x.before, x.after) for x in first.log] == [(0, "k a n p i", "k a m p i"), (2, "k a m p i", "k a m p")]


def test_presence(spark):
    c = read_cascade(["a > e", "~S", "e > i"], phonetic_table())
    rows = engine.simulate_lexicon(lex(spark, "a , e", "-- , o e", "a , --", "a , >*", "-- , --", "{ABSENT} , >*"), c, [1]).orderBy("etym_id").collect()
    assert [(r.outcome, r.status) for r in rows] == [("i", "present"), ("o i", "present"), (None, "absent"), ("i", "present"), (None, "absent"), (None, "absent")]


def test_reports_of_a_run(spark):
    c = read_cascade(["a > e", "~S", "e > i", "=T", "o > u"], phonetic_table())
    run = engine.simulate_lexicon(lex(spark, "a, e, i", "--, o, u", "t, --, t"), c, [1])
    text = {r.etym_id: r.derivation.split("\n") for r in engine.derivation_text(run, c).collect()}
    assert text[0] == ["a", "e | 0 : a > e", "S : e", "i | 1 : e > i", "T : i", "i"]
    assert text[1] == ["--", "S : --", "T : o", "u | 2 : o > u", "u"] and text[2] == ["t", "S : t", "T : --", "--"]
    graph = {r.etym_id: tuple(r)[1:] for r in engine.stage_report(run, c, [1], 2).collect()}
    assert graph[0] == ("a", "e {GOLD: e}", "i", "i {GOLD: i}") and graph[1] == ("--", "-- {GOLD: o}", "o", "u {GOLD: u}")
    rows = sorted((r.etym_id, r.ord, r.label, r.form) for r in engine.rule_report(run, c).collect())
    assert [x[2:] for x in rows if x[0] == 0] == [("INPUT", "a"), ("R0", "e"), ("~S", "e"), ("R1", "i"), ("=T", "i")]
    assert [x[2:] for x in rows if x[0] == 1] == [("INPUT", "--"), ("~S", "--"), ("=T", "+ o"), ("R2", "u")]


PATTERNS = [
    "t a", "[+syl] ( r ) t", "[+nas]", "( [-syl] )* a", "@ a", "# t", "[αlab,-syl] a [αlab,-syl]", "t + a", "( a )", "a ( t )+", "@", "#", "+", "+ a", "a #", "a + #", "( @ )* #", "# ( @ )* a",
    "[αvoi,-syl] ( a )* [!αvoi,-syl]", "( [αlab] )* a [αlab]", "( [αlab,βvoi] ( r ) )* [βvoi,αlab]", "[αlab] [βvoi] [αlab,βvoi]", "( t a )* t", "( ( t ) a )* n", "a ( ( n ) ( t ) )* r", "( + ) a", "t ( # )", "@ @ t",
]


def forms_for(t, n, seed):
    rng = random.Random(seed)
    out = [" ".join(x for _ in range(rng.randint(0, 8)) for x in rng.choice(["a", "t", "r", "n", "m", "+ a", "t", "d +", "# a"]).split()) for _ in range(n)]
    return [(f,) for f in [*out, "", "#", "# a t #", "a  t", "+", "+ +", None]]


@pytest.mark.parametrize("make", [letter_table, phonetic_table])
def test_bounds_by_columns_agree_with_the_matcher(spark, make):
    """Every pattern over random words: boundaries at the ends and inside, reluctant groups, bound letters."""
    t = make()
    rows = forms_for(t, 400, 3)
    df = spark.createDataFrame(rows, "form string")
    codes, native, want = bounds_module.codes_of(t), [], {}
    df = df.select("form", bounds_module.whole(F.col("form"), codes).alias("word")).cache()
    for i, p in enumerate(PATTERNS):
        items = RuleParser(t).context(p).items
        regex = bounds_module.bounds_regex(items, t, codes)
        assert regex is not None, p
        native.append(bounds_module.bounds(F.col("word"), regex).alias(f"b{i}"))
        want[i] = [None if f is None else match_bounds(items, t.word(f)) for (f,) in rows]
    got = df.select("form", *native).collect()
    df.unpersist()
    for i, p in enumerate(PATTERNS):
        assert [None if r[f"b{i}"] is None else [tuple(b) for b in r[f"b{i}"]] for r in got] == want[i], p


@pytest.mark.parametrize("pattern", ["t a", "( a )", "( [-syl] )* a", "# ( @ )* a", "[αlab] ( ( [βvoi] ) )* [αlab,βvoi]"])
def test_filters_agree_with_the_matcher(spark, pattern):
    t = letter_table()
    df = spark.createDataFrame(forms_for(t, 200, 4), "form string")
    items = RuleParser(t).context(pattern).items
    want = engine.matches_by_walking(df, t, items).where(F.size("bounds") > 0).drop("bounds")
    assert sorted(r.form for r in engine.filter_words(df, t, items).collect()) == sorted(r.form for r in want.collect())
    assert sorted(map(str, engine.matches(df, t, items).collect())) == sorted(map(str, engine.matches_by_walking(df, t, items).collect()))


def test_no_python_in_bounds_and_autopsy(spark):
    t = letter_table()
    df = spark.createDataFrame([("a t a n", True)], "form string, miss boolean")
    found = engine.matches(df, t, RuleParser(t).context("[αlab,-syl] ( r ) a #").items)
    plan = diagnose.contingency(diagnose.contexts(found, t, [-1, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_a_symbol_that_is_not_in_the_table(spark):
    t = phonetic_table()
    with pytest.raises(Exception, match="not in the table"):
        engine.matches(spark.createDataFrame([("a qqq",)], "form string"), t, RuleParser(t).context("a").items).collect()


def test_ranges_and_snapshots_agree(spark):
    df = spark.createDataFrame([("k a n p i",), ("t a t i",), (None,)], "form string")
    c = cascade()
    whole = engine.apply_cascade(df, c, stops=[0, 2, 5], log=True).orderBy("form").collect()
    part = engine.apply_cascade(engine.apply_cascade(df, c, rules=(0, 2)).withColumnRenamed("outcome", "mid"), c, "mid", (2, len(c.rules))).orderBy("form").collect()
    assert [r.outcome for r in whole] == [r.outcome for r in part] and whole[0].outcome is None
    assert all(r.snaps[0] == r.form and r.snaps[1] == p.mid for r, p in zip(whole[1:], part[1:], strict=True))


def test_unknown_symbol_is_an_error(spark):
    with pytest.raises(Exception, match="unknown symbol"):
        engine.apply_cascade(spark.createDataFrame([("ʘ",)], "form string"), cascade()).collect()


def test_lexicon_reader(spark):
    df = read_lexicon(spark, ["=In, Out", "a b ,  c   d $ x ɸ7", "", "e,f ɸ9"], use_form_id=True, header=True)
    rows = df.orderBy("etym_id").collect()
    assert [(r.etym_id, list(r.cells)) for r in rows] == [(1, ["a b", "c d"]), (3, ["e", "f"])] and rows[1].form_id == "9"
    assert readers.check_columns(df) == 2 and readers.distinct_symbols(df) == list("abcdef")
    with pytest.raises(RuleError):
        readers.check_columns(lex(spark, "a, b", "c"))


def test_header_rules():
    c = cascade()
    assert resolve_header("a, b, c", c).golds == (1, 2) and resolve_header("a, b, c, d", c).output == 3
    named = resolve_header("=In, Late, Modern", c)
    assert named.golds == (1,) and named.output == 2 and [s.kind for s in named.cascade.stages] == ["b", "b", "g"]
    assert [s.kind for s in resolve_header("a, b", c).cascade.stages] == ["b", "b", "b"]
    for bad in ("a, b, c, d, e", "=In, Nothing, Late", "=In, Late, Early"):
        with pytest.raises(RuleError):
            resolve_header(bad, c)


def test_tables_and_checks():
    t = SymbolTable.from_lines(["SYMB,f,g", "FEATURE_WEIGHTS,1,2", "a,+,0", "b,-,+"])
    assert t.weights == [1.0, 2.0] and t.vectors == {"a": "21", "b": "02"}
    for bad in ([], ["SYMB,f,f"], ["SYMB,f", "a,+,-"], ["SYMB,f", "a,x"], ["SYMB,f", "a>,+"], ["SYMB,f", "a:b,+"], ["SYMB,f", "a~,+"], ["SYMB,f", "x0,+"]):
        with pytest.raises(RuleError):
            SymbolTable.from_lines(bad)
    with pytest.raises(RuleError):
        t.read_diacritics(["x=+f,-f"])
    assert SymbolTable.from_lines(["SYMB,f", "ɸ,+", "(,-"]).vectors == {"ɸ": "2", "(": "0"}
    t.read_implications(["f:+g", "+g:-f $ c"])
    assert t.close(["+f"]) == ["+f", "+g"]


# --- scores ----------------------------------------------------------------------------------------------------------------------


def test_levenshtein_counts_symbols(spark):
    codes = symbol_codes([norm(s) for s in ("t͡ʃ", "ã", "t", "a", "ɡ")])
    df = spark.createDataFrame([(norm("# t͡ʃ ã #"), norm("# t a #"), 2), (norm("ã t"), norm("t"), 1), ("", "t a", 2), (None, "t", None)], "a string, b string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", levenshtein(F.col("a"), F.col("b"), codes)).collect())


def slow_distance(d, a, b):
    """The recurrence, written over: by plain recursion with its own costs."""
    import functools

    x, y = [[int(c) for c in v] for v in a], [[int(c) for c in v] for v in b]
    diff = lambda p, q: sum(abs(i - j) for i, j in zip(p, q, strict=True))
    zero = [0] * d.n_features
    gap = lambda s, i: d.id_weight * d.n_features if d.simple else d.id_weight * (diff(s[i], s[i - 1] if i else zero) + diff(s[i], s[i + 1] if i + 1 < len(s) else zero))

    @functools.cache
    def cost(i, j):
        if not i or not j:
            return sum(gap(x, k) for k in range(i)) + sum(gap(y, k) for k in range(j))
        return min(cost(i - 1, j - 1) + diff(x[i - 1], y[j - 1]) / 2, cost(i - 1, j) + gap(x, i - 1), cost(i, j - 1) + gap(y, j - 1))

    return cost(len(x), len(y)) / d.n_features


def test_feature_distance():
    t, rng = letter_table(), random.Random(2)
    for simple in (False, True):
        d = FeatureDistance(len(t.features), 0.5, None, simple)
        for _ in range(150):
            a, b = (" ".join(rng.choices("abdemnt", k=rng.randint(0, 5))) for _ in "ab")
            got, pairs = d.align(symbol_vectors(t, a), symbol_vectors(t, b))
            assert abs(got - slow_distance(d, symbol_vectors(t, a), symbol_vectors(t, b))) < 1e-9
            assert [i for i, _ in pairs if i >= 0] == [*range(len(a.split()))] and [j for _, j in pairs if j >= 0] == [*range(len(b.split()))]
        sides = [tuple(symbol_vectors(t, " ".join(rng.choices("abdemnt", k=rng.randint(0, 5)))) for _ in "ab") for _ in range(80)]
        assert d.distances(sides).tolist() == [x for x, _ in d.align_many(sides)]
    plain = FeatureDistance(len(t.features))
    assert plain.align(symbol_vectors(t, "t a"), symbol_vectors(t, "t a d"))[1] == [(0, 0), (1, 1), (EDGE_GAP, 2)]
    assert plain.align(symbol_vectors(t, "t a d"), symbol_vectors(t, "t d"))[1] == [(0, 0), (1, GAP), (2, 1)]
    assert plain.align([], symbol_vectors(t, "t"))[1] == [(GAP, 0)]
    w = FeatureDistance(2, 0.5, (1.0, 3.0))
    assert w.align(["20"], ["22"])[0] == 3.0 / 2


def test_metrics_and_confusions(spark):
    t = letter_table()
    df = spark.createDataFrame([(0, "t a", "d a"), (1, "t a t", "t a t"), (2, "t o", "d o"), (3, "e", "o")], "etym_id long, pred string, gold string")
    pairs = metrics.with_alignment(metrics.pair_distances(df, symbol_codes("abdeot")), t, FeatureDistance(len(t.features)))
    row = metrics.accuracy(pairs).first()
    assert (row.n, row.acc, row.acc1) == (4, 0.25, 1.0) and abs(row.avg_ped - (0.5 + 0 + 0.5 + 1) / 4) < 1e-12 and row.avg_fed > 0
    top = diagnose.top_confusions(diagnose.confusions(pairs)).collect()
    assert [(r.res_sym, r.gold_sym, r.n) for r in top] == [("t", "d", 2), ("e", "o", 1)]
    around = {(r.offset, r.sym): r.n for r in diagnose.confusion_contexts(pairs, "t", "d").collect()}
    assert around == {(-2, "#"): 2, (-1, "#"): 2, (1, "a"): 1, (1, "o"): 1, (2, "#"): 2}
    assert {r.sym: (r.n_words, r.n_tokens, r.n_errors) for r in metrics.errors_by_phone(pairs, "pred").collect()}["t"] == (3, 4, 2)
    assert [r.etym_id for r in metrics.mismatches(pairs, ["d", "o"]).collect()] == [2] and metrics.mismatches(pairs).count() == 3
    assert {(r.etym_id, round(r.fed, 9)) for r in metrics.with_fed(metrics.pair_distances(df, symbol_codes("abdeot")), t, FeatureDistance(len(t.features))).collect()} == {(r.etym_id, round(r.fed, 9)) for r in pairs.collect()}
    by = {r.sym: r for r in metrics.analysis_file(pairs).collect()}
    assert by["t"].error_rate == 0 and by["d"].mean_fed > 0 and by["d"].mean_ld == 1
    text = metrics.accuracy_report(metrics.accuracy(pairs)).first().text.split("\n")
    assert len(text) == 5 and text[0].split()[-1] == "0.25000000" and metrics.accuracy_text(metrics.accuracy(pairs)).first().text.split("\t")[1] == "1.00000000"
    paired = metrics.paired_accuracy(df.withColumn("hyp", F.col("gold")), symbol_codes("abdeot"))
    assert paired.first().delta_acc == 0.75 and metrics.comparative_report(paired).first().text.split("\n")[0].endswith("0.25000000 -> 1.00000000")
    told = {(r.offset, r.kind, r.value): r.share for r in diagnose.prognosis(diagnose.confusion_contexts(pairs, "t", "d"), t).collect()}
    assert told[(-1, "boundary", "#")] == 1 and told[(1, "phone", "a")] == 0.5 and (1, "constant", "+syl") in told and (2, "constant", "+syl") not in told
    fewer = {(r.offset, r.value) for r in diagnose.prognosis(diagnose.confusion_contexts(pairs, "t", "d"), t, suppress=spark.createDataFrame([("+syl",)], "spec string")).collect()}
    assert (1, "+syl") not in fewer and (1, "a") in fewer
    assert metrics.accuracy(df.limit(0).withColumns({"ld": F.lit(1), "ped": F.lit(0.5)})).first().n == 0


def test_scores(spark):
    df = spark.createDataFrame([(3, 1, 1, 5), (0, 0, 0, 4), (2, 0, 0, 2)], "n11 long, n10 long, n01 long, n00 long")
    got = [r.score for r in diagnose.scored(df, "phi").collect()]
    assert abs(got[0] - (3 * 5 - 1) / (4 * 4 * 6 * 6) ** 0.5) < 1e-12
    f = [r.score for r in diagnose.scored(df, "f").collect()]
    assert abs(f[0] - 0.75) < 1e-12 and f[1] == 0 and f[2] == 1
    with pytest.raises(ValueError):
        diagnose.scored(df, "g")


def test_autopsy(spark):
    t = letter_table()
    rows = [("t a n", True), ("d a n", False), ("t a m", True), ("a", False), ("o", True)]
    found = engine.matches(spark.createDataFrame(rows, "form string, miss boolean"), t, RuleParser(t).context("a").items)
    table = {(r.rel_pos, r.predictor): (r.n11, r.n10, r.n01, r.n00) for r in diagnose.contingency(diagnose.contexts(found, t, [-1, 1])).collect()}
    assert table[(-1, "t")] == (2, 0, 0, 2) and table[(-1, "-voi")] == (2, 0, 0, 2) and table[(1, "+nas")] == (2, 1, 0, 1) and table[(-1, "#")] == (0, 1, 2, 1)
    assert diagnose.autopsy_scope(found.withColumn("length", F.size(F.split("form", " ")) + 2)) == (-2, 2)
    best = diagnose.top_predictors(diagnose.scored(diagnose.contingency(diagnose.contexts(found, t, [-1])), "f"), 1).collect()
    assert {r.kind for r in best} == {"feature", "phone"} and all(r.score > 0.1 for r in best)  # the boundary predicts no miss
    kinds = spark.createDataFrame([(x,) for x in ("#", "+", "+voi", "-syl", "a")], "p string").select(diagnose.predictor_kind(F.col("p")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["bound", "bound", "feature", "feature", "phone"]
    edge = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.11)], "rel_pos int, predictor string, score double")
    assert [r.predictor for r in diagnose.top_predictors(edge).collect()] == ["b"]


# --- what if ---------------------------------------------------------------------------------------------------------------------


def uids(c):
    return [r.uid for r in c.rules]


def test_edits_and_maps():
    base = cascade()
    assert uids(base) == ["L1.0", "L3.0", "L6.0", "L7.0", "L9.0"]
    insert = whatif.propose(base, [whatif.Edit("insert", 0, law="o > u")])
    assert insert.base_to_hyp() == [1, 2, 3, 4, 5] and insert.hyp_to_base() == [-1, 0, 1, 2, 3, 4] and [s.instant for s in insert.cascade.stages] == [2, 3, 5]
    delete = whatif.propose(base, [whatif.Edit("delete", 1)])
    assert delete.base_to_hyp() == [0, -1, 1, 2, 3] and [s.instant for s in delete.cascade.stages] == [1, 1, 3]
    move = whatif.propose(base, [whatif.Edit("relocate", 0, to=4)])
    assert uids(move.cascade) == ["L3.0", "L6.0", "L7.0", "L1.0", "L9.0"] and move.base_to_hyp() == [3, 0, 1, 2, 4] and [s.instant for s in move.cascade.stages] == [0, 1, 3]
    back = whatif.propose(base, [whatif.Edit("relocate", 4, to=1, before_stage=True)])
    assert uids(back.cascade) == ["L1.0", "L9.0", "L3.0", "L6.0", "L7.0"] and [s.instant for s in back.cascade.stages] == [2, 3, 5]
    many = whatif.propose(base, [whatif.Edit("modify", 2, law="i > ∅ / {t;d} __ #")])
    assert many.base_to_hyp() == [0, 1, 2, 4, 5] and [s.instant for s in many.cascade.stages] == [1, 2, 5]
    assert move.fork() == 0 and delete.fork() == 1
    assert sorted(delete.global_order().values()) == [0, 1, 2, 3, 4]
    for bad in ([whatif.Edit("delete", 9)], [whatif.Edit("delete", 1), whatif.Edit("insert", 0, law="")], [whatif.Edit("modify", 1, law="a > o / __ i"), whatif.Edit("delete", 1)], [whatif.Edit("paint", 0)], [whatif.Edit("relocate", 0)]):
        with pytest.raises(RuleError):
            whatif.propose(base, bad)


def test_differential(spark):
    base = read_cascade(["a > e", "e > i", "i > o", "t > d"], phonetic_table())
    h = whatif.propose(base, [whatif.Edit("delete", 0)])
    df = spark.createDataFrame([(1, "t a"), (2, "e"), (3, "u"), (4, None)], "etym_id long, form string")
    both = whatif.run_both(df, h)
    diff = whatif.differential(both, h)
    rows = {(r.etym_id, r.rule_uid): (r.base_after, r.hyp_after) for r in diff.collect()}
    assert rows == {(1, "L0.0"): ("t e", None), (1, "L1.0"): ("t i", None), (1, "L2.0"): ("t o", None), (1, "L3.0"): ("d o", "d a")}
    assert {(r.etym_id, r.rule_uid, r.effect) for r in whatif.fed_bled(diff, h).collect()} == {(1, "L1.0", "bled"), (1, "L2.0", "bled")}
    assert [(r.etym_id, r.first_idx) for r in whatif.divergence(both, h).collect()] == [(1, 0)]
    assert [(r.rule_uid, r.n_words, r.first_key) for r in whatif.dominoes(both, h).collect()] == [("L0.0", 1, 1)]
    assert [tuple(r) for r in whatif.domino_words(both, h).collect()] == [("L0.0", 1)]
    assert [r.etym_id for r in whatif.affected(both, h).collect()] == [1] and whatif.changed_outcomes(both).count() == 1
    results = {r.rule_uid: (r.edited, r.n_only_base, r.n_only_hyp, r.n_otherwise) for r in whatif.basic_results(both, h).collect()}
    assert results == {"L0.0": (True, 1, 0, 0), "L1.0": (False, 1, 0, 0), "L2.0": (False, 1, 0, 0), "L3.0": (False, 0, 0, 1)}


def test_differential_is_row_local(spark):
    """One Arrow stage, no join and no shuffle."""
    base = read_cascade(["a > e", "e > i"], phonetic_table())
    h = whatif.propose(base, [whatif.Edit("delete", 0)])
    df = spark.createDataFrame([(1, "t a")], "etym_id long, form string")
    plan = whatif.differential(whatif.run_both(df, h), h)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan


def test_stage_results(spark):
    base = read_cascade(["a > e", "~Mid", "e > i"], phonetic_table())
    h = whatif.propose(base, [whatif.Edit("delete", 0)])
    lexicon = lex(spark, "t a, t e, t i", "o, o, o", "a, --, a", "a, >*, i")
    rows = {r.stage: r for r in whatif.stage_results(lexicon, h, symbol_codes("aeiot"), [1], 2).collect()}
    assert (rows["Mid"].base_n, rows["Mid"].base_acc, rows["Mid"].hyp_acc) == (2, 1.0, 0.5)
    assert (rows["Output"].base_n, rows["Output"].base_acc, rows["Output"].delta_acc) == (3, 1.0, 1 / 3 - 1)
    with pytest.raises(ValueError):
        whatif.stage_results(lexicon, h, symbol_codes("a"))


EDITS = {
    "insert": [whatif.Edit("insert", 1, law="o > u")],
    "insert in front": [whatif.Edit("insert", 0, law="o > u / __ t", comment="new")],
    "delete": [whatif.Edit("delete", 4)],
    "modify": [whatif.Edit("modify", 1, law="a > o / __ i")],
    "relocate on": [whatif.Edit("relocate", 0, to=4)],
    "relocate back": [whatif.Edit("relocate", 4, to=1, before_stage=True)],
}


@pytest.mark.parametrize("kind", EDITS)
def test_accepted_hypotheses_can_be_edited_on(kind):
    h = whatif.propose(cascade(), EDITS[kind])
    now = whatif.accept(h)
    assert [str(r) for r in now.rules] == [str(r) for r in h.cascade.rules] and now.stages == h.cascade.stages
    assert whatif.rewrite(h.cascade, []) == list(now.lines) == whatif.rewrite(h.base, h.edits)
    again = whatif.propose(now, [whatif.Edit("delete", 0), whatif.Edit("insert", 1, law="u > o")])
    lines = whatif.rewrite(now, again.edits)
    assert len(lines) == len(now.lines) and "u > o" in lines and [x for x in lines if x[:1] in "~="] == [x for x in CASCADE if x[:1] in "~="]
    assert [str(r) for r in whatif.accept(again).rules] == [str(r) for r in again.cascade.rules]
    assert [str(r) for r in read_cascade(whatif.rewrite(h.cascade, [whatif.Edit("delete", 0)]), phonetic_table()).rules] == [str(r) for r in h.cascade.rules[1:]]


def test_places_of_edits_alone():
    base = cascade()
    out = whatif.rewrite(base, [whatif.Edit("delete", 0), whatif.Edit("insert", 1, law="o > u"), whatif.Edit("modify", 3, law="t > d", comment="look here")], placeholders=True)
    assert [x for x in out if x in CASCADE] == CASCADE
    notes = [x for x in out if x not in CASCADE]
    assert notes == ["$ delete this rule", "$ insert here: o > u", "$ look here"]
    assert out.index(notes[0]) + 1 == out.index(CASCADE[1]) and out.index(notes[1]) + 1 == out.index(CASCADE[6])
    several = read_cascade(["a > e / {b;d} __", "o > u"], phonetic_table())
    assert whatif.rewrite(several, [whatif.Edit("delete", 1)], placeholders=True) == ["$ delete this rule", *several.lines]
    parted = whatif.propose(several, [whatif.Edit("delete", 1)])
    with pytest.raises(whatif.MidDisjunctionError):
        whatif.accept(parted)
    with pytest.raises(whatif.MidDisjunctionError):
        whatif.rewrite(parted.cascade, [whatif.Edit("delete", 0)])


def test_rewrite():
    base = cascade()
    out = whatif.rewrite(base, [whatif.Edit("insert", 2, law="o > u", comment="new"), whatif.Edit("delete", 0)])
    assert out == ["$ an example", "~Early", CASCADE[3], "=Mid", "$ new", "o > u", "$ final loss", *CASCADE[6:]]
    again = read_cascade(out, phonetic_table())
    want = whatif.propose(base, [whatif.Edit("insert", 2, law="o > u"), whatif.Edit("delete", 0)]).cascade
    assert [str(r) for r in again.rules] == [str(r) for r in want.rules] and again.stages == want.stages
    several = read_cascade(["a > e / {b;d} __", "o > u"], phonetic_table())
    with pytest.raises(whatif.MidDisjunctionError):
        whatif.rewrite(several, [whatif.Edit("delete", 1)])
    with pytest.raises(whatif.MidDisjunctionError):
        whatif.rewrite(several, [whatif.Edit("insert", 1, law="e > i")])


def test_comments_and_files(spark, tmp_path):
    text = readers.standard_comment("word " * 60)
    assert readers.is_standard_comment(text) and not readers.is_standard_comment("no mark")
    (tmp_path / "c.txt").write_text("\n".join(CASCADE), encoding="utf-8")
    assert readers.read_lines(spark, str(tmp_path / "c.txt")) == CASCADE
    readers.write_rules_log(spark, cascade(), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == len(cascade().rules)
    a, b = spark.createDataFrame([(0, "x"), (1, "y")], "line_no int, line string"), spark.createDataFrame([(0, "x"), (1, "z")], "line_no int, line string")
    assert {(r.side, r.line) for r in readers.diff_lines(a, b).collect()} == {("a", "y"), ("b", "z")}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("k a n p i",)], "form string").write.parquet(str(tmp_path / "in"))
    stream = stream_cascade(spark.readStream.schema("form string").parquet(str(tmp_path / "in")), cascade())
    q = stream.writeStream.format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert [r.outcome for r in spark.sql("select * from streamed").collect()] == ["k a m p"]
    with pytest.raises(ValueError):
        stream_cascade(spark.createDataFrame([("a",)], "form string"), cascade())


def test_what_a_task_remembers_is_bounded():
    """Of distinct forms no more than a batch's are held, of long ones none; equal ones are made once."""
    import weakref

    import pyarrow as pa

    class Made:
        pass

    alive, n = weakref.WeakSet(), [0]

    def made(f):
        out = Made()
        alive.add(out)
        n[0] += 1
        return out

    of = engine._each_form(made)
    for a in range(0, 60_000, 10_000):
        of(pa.array([f"a {i}" for i in range(a, a + 10_000)]))
        assert len(alive) <= 10_000
    of = engine._each_form(made)
    of(pa.array(["t " * 5_000 + str(i) for i in range(50)]))
    assert not alive
    n[0] = 0
    assert len(set(of(pa.array(["a", None, "a", "a"])))) == 2 and n[0] == 1
