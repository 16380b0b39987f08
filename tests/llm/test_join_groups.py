"""Components of the n-gram join are worked out once: what leaders have connected is one node in what comes after."""

import random

from pyspark.sql import functions as F
from test_llm import brute_groups

from phonoweave.llm import ngram_join


def texts_of_families() -> list[str]:
    rng = random.Random(3)
    out = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(60)]
        out += [" ".join([*base, f"e{f}x{j}"]) for j in range(4)]
    return out + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(5)]


def edges_of_calls(spark, texts, monkeypatch) -> list[set]:
    """The edges of each call for components; the result is held against brute force."""
    calls = []
    own = ngram_join.connected_components

    def noted(edges, a, b):
        calls.append({(min(r), max(r)) for r in edges.select(a, b).collect()})
        return own(edges, a, b)

    monkeypatch.setattr(ngram_join, "connected_components", noted)
    rows = list(enumerate(texts))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {tuple(r) for r in got.collect()} == brute_groups(rows)
    return calls


def test_leaders_links_are_connected_once(spark, monkeypatch):
    assert len(edges_of_calls(spark, texts_of_families(), monkeypatch)) == 1


def test_later_links_are_between_groups_only(spark, monkeypatch):
    """A part of the leaders' links is held back, so that groups and single classes are linked later."""
    own, calls = ngram_join._Join.verify, []

    def some(self, pairs, classes):
        calls.append(1)
        out = own(self, pairs, classes)
        return out.where(F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0) if len(calls) == 1 else out

    monkeypatch.setattr(ngram_join._Join, "verify", some)
    first, later = edges_of_calls(spark, texts_of_families(), monkeypatch)
    assert first and later and not first & later
