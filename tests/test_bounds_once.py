"""Bounds are found once for each distinct word, not at each place of a word in the documents."""

import pytest

from phonoweave import queries

DATA = "/root/testdata/sf0.001"
NAMES = ["match_bounds_edge", "match_bounds_morph", "match_bounds", "context_autopsy_fbeta", "match_bounds_alpha"]


@pytest.mark.parametrize("name", NAMES)
def test_no_condition_searches_words_again(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith(("Filter", "Join"))]
    assert "regexp_replace" in plan and conditions and not any("regexp_replace" in line for line in conditions)


def test_predictors_and_their_totals_are_counted_from_one_reading(spark):
    plan = queries.QUERIES["context_autopsy_fbeta"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    read = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Relation")]
    assert len(read) == 2, plan  # documents and labels
