"""Phrase collocations against a count of all n-grams."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from phonoweave.llm import collocations as module
from phonoweave.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, n string, key string"


def brute(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for m in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {q[i:j] for q, b in found.items() for i in range(len(q)) for j in range(i + 1, len(q) + 1) if j - i < len(q) and 100 * b >= 100 * own[q[i:j]]}
        rank = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]], len(p), k))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s, m, k) for i, (s, a, p, left, right, m, k) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def made(seed, docs=60):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Straße", "É", "x\x00y", " ", "the"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", ".", "; "]) for _ in range(rng.choice([0, 1, 5, 60])))
    rows = [(rng.choice(["en", "en", "de", None]), text()) for _ in range(docs)]
    rows += [("en", None), ("fr", ""), (None, "A b A b A b"), ("en", "the the the the the the the"), ("en", "the " * 300), *[("en", "P q R s t, P q R s t")] * 9]
    return rows


@pytest.mark.parametrize(("words_sent", "pivot_rows"), [(1000, 10**6), (1000, 20), (0, 10**6), (0, 20)])
def test_against_all_ngrams(spark, words_sent, pivot_rows):
    """Words sent or joined, pivots whole or dealt over parts: the same phrases."""
    rows = made(words_sent + pivot_rows)
    df = spark.createDataFrame([(i % 3, t, lang, "n", "key") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    for least, longest, top in ((4, 5, 2000), (2, 3, 7)):
        got = collocations(df, least, longest, top, words_sent, pivot_rows)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, longest, top)


def test_empty_table_and_no_frequent_phrase(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b c", "en", "", ""), (2, None, None, None, None)], SCHEMA)).count() == 0


def test_long_text_in_parts(spark):
    text = "one two. " * 90_000 + "three four" * 2 + "z" * 700_000
    got = collocations(spark.createDataFrame([(1, text, "en", "", "")], SCHEMA)).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in got] == [("one two", 90_000, 90_000, 90_000, 180_000 + 3)]


def test_every_ngram_has_one_owner():
    rng = np.random.default_rng(5)
    ids, linked = rng.integers(-1, 6, 500), rng.random(500) < 0.9
    left, right, _, matrix, _ = module._fragments(ids, linked, np.ones(500, np.int64), 4, 10)
    got, want = Counter(), Counter()
    for a, b, row in zip(left.astype(int), right.astype(int), matrix.tolist(), strict=True):
        for x in range(a + 1):
            for y in range(b + 1):
                if 2 <= x + y + 1 <= 5:
                    got[tuple(row[4 - x : 5 + y])] += 1
    for m in range(2, 6):
        for i in range(len(ids) - m + 1):
            if (ids[i : i + m] >= 0).all() and linked[i : i + m - 1].all():
                want[tuple(ids[i : i + m].tolist())] += 1
    assert got == want


def test_rows_whose_hashes_meet_are_told_apart(monkeypatch):
    monkeypatch.setattr(module, "_row_hash", lambda m: np.zeros(len(m), np.uint64))
    order, first = module._groups(np.array([[1, 2], [3, 4], [1, 2]], np.int32))
    assert sorted(np.diff(first, append=3).tolist()) == [1, 2] and len(order) == 3
