"""Texts are split as they are; the words are lower-cased, A-Z alone."""

import pytest

from phonoweave import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["match_bounds_morph", "match_bounds_alpha", "match_bounds", "context_autopsy_fbeta", "errors_by_phone"])
def test_no_text_is_lower_cased_letter_by_letter(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(text" in plan and "translate(text" not in plan


def test_only_a_to_z_make_words(spark, tmp_path):
    # the Kelvin sign, a dotted I, a long s: not letters of words
    texts = ["The THE the", "a\u212Ab", "x\u0130y \u017Fs", "don't", "Straße ÉtÉ", "\U0001D400Q\U0001D400", "", "123", None, "z\nZ\u0000q"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.word for r in queries.words(spark, str(tmp_path)).collect())
    assert got == sorted({"the", "a", "b", "x", "y", "s", "don", "t", "stra", "e", "q", "z"})
