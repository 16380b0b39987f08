"""A run from files, the column forms of matrices, and the small helpers."""

import pytest
from pyspark.sql import functions as F

from phonoweave.functions import columns, text
from phonoweave.functions.inventory import letter_table, phonetic_table
from phonoweave.operators import metrics
from phonoweave.operators.whatif import Edit
from phonoweave.plans.rules import RuleParser
from phonoweave.plans.run import RunConfig, Session, main, parse_args, run


def test_run_from_files(spark, tmp_path):
    t = phonetic_table()
    marks = {"2": "+", "0": "-", "1": "0"}
    (tmp_path / "symbols").write_text("\n".join(["SYMB," + ",".join(t.features), *(f"{s}," + ",".join(marks[v] for v in vec) for s, vec in t.vectors.items())]), encoding="utf-8")
    (tmp_path / "diacritics").write_text("ʰ=+sg $ a comment\ñ=+nas\n", encoding="utf-8")
    (tmp_path / "implications").write_text("+nas:+son\n", encoding="utf-8")
    (tmp_path / "cascade").write_text("$ x\n[+syl] > [+nas] / __ [+nas,-syl]\n~Mid\nn > ∅ / [+syl] __ #\n", encoding="utf-8")
    (tmp_path / "lexicon").write_text("p a n , p ã n , p ã $ one ɸx1\ntʰ o n a, tʰ õ n a, tʰ õ\no , -- , >*\n", encoding="utf-8")
    config = RunConfig(*(str(tmp_path / n) for n in ("symbols", "cascade", "lexicon", "implications", "diacritics", "out")))
    r = run(spark, config)
    at_end = {x.etym_id: (x.ld, round(x.fed, 6)) for x in r.pairs().collect()}
    assert at_end[0] == (0, 0.0) and at_end[1][0] == 2 and 2 not in at_end
    row = metrics.accuracy(r.pairs("Mid")).first()
    assert (row.n, row.acc, row.avg_fed) == (2, 1.0, 0.0)
    assert spark.read.parquet(str(tmp_path / "out" / "stages")).count() == 3
    assert {r.etym_id for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "distances")).collect()} == {"0", "1"}
    paths = [x for n, f in (("-symbols", "symbols"), ("-rules", "cascade"), ("-lex", "lexicon"), ("-impl", "implications"), ("-diacrit", "diacritics")) for x in (n, str(tmp_path / f))]
    again = main([*paths, "-idcost", "0.5", "-hs"], spark)
    assert again.lexicon.count() == 3 and [s.name for s in again.cascade.stages] == ["Mid"]
    assert not main([*paths, "-is"], spark).cascade.stages
    look(spark, Session(r))


def look(spark, s):
    assert s.accuracy().first().n == 2 and s.at("Mid").accuracy(fed=True).first().acc == 1.0
    assert s.filtered("[+nas,-syl]").pairs().count() == 2 and s.filtered("tʰ").pairs().count() == 1 and s.filtered("tʰ").unfiltered().pairs().count() == 2
    assert s.pivoted("Mid").filtered("ã").pairs().count() == 1 and s.pivoted(None).pairs().where("form = pred").count() == 2
    assert [r.etym_id for r in s.mismatches().collect()] == [1] and s.errors("pred").count() > 0 and s.confusions().count() > 0
    assert s.report().first().text.count("\n") == 4 and s.filtered("n").shares().first().n_in == 2
    top = s.confusions().first()
    assert s.confusion(top.res_sym, top.gold_sym, 0.1).count() > 0 and s.filtered("n").autopsy().count() >= 0
    assert s.word("p a n").first().derivation.split("\n")[0] == "p a n" and list(s.rule("__ #")) == [1] and s.changed(0).count() == 2
    h, scores = s.propose([Edit("delete", 0)])
    assert [str(x) for x in h.cascade.rules] == [str(s.run.cascade.rules[1])] and scores.where("stage = 'Mid'").first().hyp_acc == 0
    for wrong in (lambda: s.at("No"), lambda: s.pivoted("No"), s.autopsy, s.shares):
        with pytest.raises(ValueError):
            wrong()


def test_command_line():
    c = parse_args(["-lex", "l", "-rules", "c", "-diacrit", "-simple_FED", "-USE_FORM_ID", "-rpe", "-idcost", "0.25", "-out", "o"])
    assert (c.lexicon, c.cascade, c.diacritics, c.simple_fed, c.use_form_id, c.debug_rules, c.changes, c.explicit, c.id_cost, c.out) == ("l", "c", "diacritics.txt", True, True, True, True, True, 0.25, "o")
    plain = parse_args([])
    assert (plain.id_cost, plain.simple_fed, plain.diacritics, plain.implications, plain.symbols) == (0.5, False, None, "implications.txt", "symbols.csv")
    for bad in (["-lex"], ["-idcost", "-s"], ["-q"], ["word"], ["-"]):
        with pytest.raises(ValueError):
            parse_args(bad)


def test_morphology_columns(spark):
    df = spark.createDataFrame([({"case": "dat"}, ["law"]), (None, None)], "specs map<string,string>, domains array<string>")
    rows = df.select(columns.morph_spec(F.col("specs"), "case").alias("c"), columns.morph_spec(F.col("specs"), "x").alias("x"), columns.in_domain(F.col("domains"), "law").alias("d")).collect()
    assert [tuple(r) for r in rows] == [("dat", None, True), (None, None, False)]


def test_columns(spark):
    t = phonetic_table()
    df = columns.symbols_df(spark, t)
    m = RuleParser(t).slot("[+syl,-hi]")
    hits = {r.symbol for r in df.where(columns.matches_matrix(F.col("fv"), m, len(t.features))).collect()}
    assert hits == {s for s in t.vectors if m.match(t.phone(s), {}) is not None} and "a" in hits and "i" not in hits
    row = df.where("symbol = 'a'").select(
        columns.feature_value(F.col("fv"), t, "lo").alias("lo"),
        columns.feature_value(F.col("fv"), t, "ant").alias("ant"),
        columns.spelled(F.col("fv"), t).alias("spelled"),
        columns.printed(columns.with_feature(F.col("fv"), t, "back", "+"), t).alias("back"),
        columns.imposed(F.col("fv"), RuleParser(t).slot("[+hi,-lo,.voi]")).alias("imposed"),
    ).first()
    assert (row.lo, row.ant, row.spelled, row.back) == ("+", "0", t.spell(t.vectors["a"]), "ɑ")
    assert row.imposed[t.features.index("hi")] == "2" and row.imposed[t.features.index("voi")] == "1"
    assert columns.features_df(spark, letter_table()).count() == len(letter_table().features)
    assert columns.implications_df(spark, t).count() == len(t.implications) and columns.diacritics_df(spark, t).count() == len(t.diacritics)


def test_helpers():
    assert text.strip_ends("[a]") == "a" and text.is_int("-3") and not text.is_int("3a") and text.int_prefix("12b") == 12 and text.int_prefix("b") is None
    assert text.is_blank(" \t") and text.pad("a", 3) == "a  " and text.has_suffix("abc", "bc") and text.common_prefix("abc", "abd") == "ab"
    assert text.difference("a t i", "a d i") == "a {t;d} i" and text.difference("a", "a") == "a" and text.column_layout([1, 2], 3) == "1  2"
