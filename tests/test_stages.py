"""Kept forms: where runs begin, how tables meet, and what a log tells of an instant."""

import pytest
from pyspark.sql import functions as F

from phonoweave import queries
from phonoweave.functions.inventory import letter_table
from phonoweave.operators import engine, stages, whatif
from phonoweave.sources.readers import read_cascade, read_lexicon


def rules(n):
    return queries.cascade(*(rule for rule, _ in queries.long_steps(n)))


@pytest.fixture(scope="module")
def kept(spark):
    words = spark.createDataFrame([("banana", "b a n a n a"), ("stone", "s t o n e"), ("x", "x"), ("none", None), ("twin", "t w i n"), ("twin2", "t w i n")], "word string, form string")
    return words, stages.Snapshots.build(words, rules(700), 100, buckets=3)


def test_a_late_edit_runs_late_rules_alone(spark, kept):
    """At rule 600 of 700: 100 rules a form, counted, and the same results as from the start."""
    words, store = kept
    h = whatif.propose(store.cascade, [whatif.Edit("delete", 600)])
    tried = spark.sparkContext.accumulator(0)
    plain = lambda df: sorted(map(str, df.select("word", "fork", "base_outcome", "base_log", "hyp_outcome", "hyp_log").collect()))
    assert plain(store.run_both(h, tried)) == plain(whatif.run_both(words, h))
    forms = words.where("form is not null").count()
    assert tried.value <= 100 * forms and tried.value % 100 == 0 and tried.value >= 100 * 4


def test_pivots_start_at_the_nearest_instant(spark, kept):
    words, store = kept
    assert [store.nearest(x) for x in (0, 99, 100, 650, 700)] == [0, 0, 100, 600, 700]
    for at in (0, 37, 300, 655, 700):
        tried = spark.sparkContext.accumulator(0)
        got = {r.word: r.form for r in store.at(at, tried).collect()}
        want = {r.word: r.outcome for r in engine.apply_cascade(words, store.cascade, rules=(0, at)).collect()}
        assert got == want and tried.value <= (at - store.nearest(at)) * 5
    scan = store.kept(300)._jdf.queryExecution().executedPlan().toString()
    assert "f300" in scan and "f200" not in scan.split("ReadSchema")[1]
    for wrong in (-1, 701):
        with pytest.raises(ValueError):
            store.nearest(wrong)
    with pytest.raises(ValueError):
        store.run_both(whatif.propose(rules(3), [whatif.Edit("delete", 1)]))


def test_kept_tables_meet_without_a_shuffle(spark):
    df = spark.range(500).select(F.col("id").alias("etym_id"), F.col("id").cast("string").alias("form"))
    tables = [stages.keep(df.withColumnRenamed("form", n), "etym_id", n, 4) for n in ("pred", "gold", "pivot")]
    out = stages.side_by_side(tables)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 500 and all(r.pred == r.gold == r.pivot == str(r.etym_id) for r in rows) and "Exchange" not in plan
    with pytest.raises(ValueError):
        stages.side_by_side([tables[0], stages.keep(df, "etym_id", "other", 5)])
    for t in tables:
        t.drop()
    assert not spark.catalog.tableExists(tables[0].name)


def test_forms_at_a_rule_from_the_log(spark):
    """Every instant of words that stay, come in, go, and never change, against runs of so many rules."""
    c = read_cascade(["a > e", "~S", "t > d", "e > i", "=T", "i > o", "~U", "o > u"], letter_table())
    lexicon = read_lexicon(spark, ["t a, t a, t a", "--, t e, t e", "t a t, --, n e", "n, n, --", "l, >*, l"])
    run = engine.simulate_lexicon(lexicon, c, [1, 2])
    got = run.select("etym_id", *(stages.form_at_rule(i, c).alias(f"r{i}") for i in range(6))).collect()
    want = {0: ["t a", "t e", "d e", "d i", "d o", "d u"], 1: [None, "t e", "d e", "d i", "d o", "d u"], 2: ["t a t", None, None, None, "n e", "n e"], 3: ["n"] * 4 + [None] * 2, 4: ["l"] * 6}
    assert {r.etym_id: list(r)[1:] for r in got} == want
