"""The divergence audit against dense sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from phonoweave.llm import divergence as module
from phonoweave.llm.divergence import divergence

SCHEMA = "text string, lang string, source string, term string, n int"
SCALE = 1_000_000_000


def brute(rows, least, top):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((x or "" for x in r) for r in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        df[lang].update(set(terms))
        n[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in df[lang].items() if d >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + SCALE * (counts[t] + 1) // total for t in kept}

        of = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        far = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(-sum(far(of[s][t], of[x][t]) for t in kept), x.encode()) for x in sources - {s}]
            terms = [(-far(of[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and of[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    words = [*(chr(97 + i) * (1 + i % 3) for i in range(26)), "Straße", "É", "ñandú", "日本", "THE", "the"]
    text = lambda: "".join(rng.choice(words[: rng.choice([3, 12, len(words)])]) + rng.choice([" ", "1", "_", "\n", "\x00", "'"]) for _ in range(rng.choice([0, 1, 6, 40])))
    rows = [(text(), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "ä", None])) for _ in range(70)]
    rows += [(None, "en", "empty"), ("", "xx", "p"), ("only one", "xx", "q"), ("rare words", "yy", "alone"), ("x" * 3000, "de", "a"), *[("same row", "en", "b")] * 4]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_dense_sums(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "term", 3) for r in rows], SCHEMA).repartition(4)
    for least, top in ((3, 200), (1, 4), (50, 10)):
        assert sorted(tuple(r) for r in divergence(df, least, top).collect()) == brute(rows, least, top)


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_document_counts_once(spark):
    """Its parts share terms; they are one document."""
    long = "seldom " + "word " * 250_000 + "seldom"
    rows = [(long, "en", "a"), ("seldom word", "en", "b"), ("word", "en", "b")]
    assert sorted(tuple(r) for r in divergence(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()) == brute(rows, 3, 200)


def test_the_sketch_is_never_too_low(spark):
    """A tiny sketch, in which every cell is shared: each term that is in enough documents is possible."""
    rng = random.Random(9)
    rows = [(" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(9)), rng.choice(["en", "de"]), "s") for _ in range(120)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    bits = module.frequent_cells(df, 3, 18)
    docs = defaultdict(Counter)
    for text, lang, _ in rows:
        docs[lang].update(set(text.split()))
    raw = {t for own in docs.values() for t in own}
    data = np.frombuffer(" ".join(sorted(raw)).encode(), np.uint8)
    (_, h, _, _, _), = module.terms_of(np.array([0, len(data)]), data)
    kept = 0
    for lang, own in docs.items():
        yes = module._possible(bits, module._keys(h, np.full(len(h), module._lang_hash(lang), np.uint64)), 18)
        assert all(y for y, t in zip(yes, sorted(raw), strict=True) if own[t] >= 3)
        kept += int(yes.sum())
    assert kept < 0.8 * sum(map(len, docs.values()))
