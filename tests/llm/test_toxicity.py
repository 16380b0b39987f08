"""The recurrent network against slow sums, finite differences and held-out documents."""

import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoweave.llm import queries, toxicity
from phonoweave.llm.divergence import terms_of


def words_of(texts):
    raws = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raws)])
    (raw, h, begin, size, text), = terms_of(at, np.frombuffer(b"".join(raws), np.uint8))
    return toxicity.words_of(raw, h, begin, size, text, 0, len(texts))


def filled(seed=1):
    net, rng = toxicity.Network(), np.random.default_rng(seed)
    for k, v in net.p.items():
        net.p[k] = rng.normal(0, 0.4, v.shape).astype(np.float32)
    return net


def made(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def slow(net, text):
    """One text, one window, one word and one gate at a time, n-grams by slicing."""
    p, c = {k: v.astype(float) for k, v in net.p.items()}, toxicity.CELLS
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    terms = ["".join(x) for x in text.lower().split()]
    hashes = {}
    for t in set(terms):
        raw = t.encode()
        (_, h, *_), = terms_of(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
        hashes[t] = int(h[0])

    def entry(t):
        x = p["words"][hashes[t] >> 20 & toxicity.WORD_ROWS - 1].copy()
        marked = b"\x01" + t.encode() + b"\x02"
        grams = [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        for g in grams:
            row = int(toxicity.mix64(np.array([int.from_bytes(g, "big") + (len(g) << 56)], np.uint64))[0]) & toxicity.GRAM_ROWS - 1
            x += p["grams"][row] / math.sqrt(len(grams))
        return x @ p["enter"] + p["bias"]

    best = -math.inf
    for start in range(0, max(1, len(terms)), toxicity.STRIDE):
        if start and start + toxicity.WINDOW - toxicity.STRIDE >= len(terms):
            break
        part = [entry(t) for t in terms[start : start + toxicity.WINDOW]]
        states = [[None, None] for _ in part]
        for side in (0, 1):
            h = np.zeros(c)
            for t in range(len(part)) if side == 0 else reversed(range(len(part))):
                x, a = part[t][3 * c * side : 3 * c * (side + 1)], h @ p["turn"][side]
                new = np.zeros(c)
                for j in range(c):
                    r, z = sigmoid(x[j] + a[j]), sigmoid(x[c + j] + a[c + j])
                    n = math.tanh(x[2 * c + j] + r * a[2 * c + j])
                    new[j] = (1 - z) * n + z * h[j]
                h = states[t][side] = new
        logit = p["level"][0]
        if part:
            all_states = np.array([np.concatenate(s) for s in states])
            e = np.exp(all_states @ p["look"])
            logit += (e / e.sum()) @ all_states @ p["out"]
        best = max(best, logit)
    return sigmoid(best)


def test_windows_and_gates_against_slow_sums():
    rng, net = random.Random(2), filled()
    texts = ["", "a", "1 2 3", made(rng, 5), made(rng, toxicity.WINDOW), made(rng, toxicity.WINDOW + 1), made(rng, 150), made(rng, 209)]
    got = net.scores(words_of(texts))
    assert np.allclose(got, [slow(net, t if any(ch.isalpha() for ch in t) else "") for t in texts], atol=1e-4)


def test_every_word_is_in_a_window():
    lengths = np.arange(0, 400)
    text, first, room = toxicity.windows_of(lengths)
    start = np.cumsum(lengths) - lengths
    for i, n in enumerate(lengths):
        own = text == i
        seen = {w for a, r in zip(first[own] - start[i], room[own], strict=True) for w in range(a, a + r)}
        assert seen == set(range(n)) and own.sum() >= 1 and all(r > 0 or n == 0 for r in room[own])


def test_gradient_against_differences():
    net, w = filled(3), words_of(["ab ba abc ab", "e", "bad words here and there bad", ""])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, first, room = toxicity.windows_of(w.lengths)
    slope = np.array([0.3, -1.0, 0.7, 0.2])

    def total():
        return float(net.forward(net.entries(w).astype(np.float64), w.number, first, room) @ slope)

    gates = net.entries(w)
    g = net.backward(w, gates, net.forward(gates, w.number, first, room, keep=True)[1], slope)
    rng = np.random.default_rng(1)
    for k, d in g.items():
        if isinstance(d, tuple):
            dense = np.zeros_like(net.p[k])
            dense[d[0]] = d[1]
            places = [(int(rng.choice(d[0])), int(rng.integers(dense.shape[1]))) for _ in range(6)]
        else:
            dense, places = d, [tuple(int(rng.integers(x)) for x in d.shape) for _ in range(6)]
        for at in places:
            kept = net.p[k][at]
            net.p[k][at] = kept + 0.01
            high = total()
            net.p[k][at] = kept - 0.01
            low = total()
            net.p[k][at] = kept
            assert abs((high - low) / 0.02 - dense[at]) < 2e-3 + 0.02 * abs(dense[at]), (k, at)


def test_a_long_text_and_odd_rows(spark):
    """A bad word after a megabyte of others is found; null, empty and wordless texts get the score of no words."""
    rng = random.Random(4)
    clean = lambda n: " ".join(rng.choice(["tree", "stone", "water", "cloud", "river"]) for _ in range(n))
    rows = [(1, clean(20) + " vilest " + clean(20)) for _ in range(60)] + [(0, clean(40)) for _ in range(60)]
    net = toxicity.train(rows)
    table = [(1, clean(200_000) + " vilest"), (2, clean(200_000)), (3, None), (4, ""), (5, "12 !"), (5, "a vilest"), (5, "a vilest"), (None, clean(3)), (7, "vilest" * 200_000)]
    df = spark.createDataFrame([(*r, 9.0, "x") for r in table], "doc_id long, text string, score double, number string").coalesce(1)
    got = [(r.doc_id, r.score) for r in toxicity.score(df, net).collect()]
    assert [i for i, _ in got] == [i for i, _ in table] and all(0 <= x <= 1 for _, x in got)
    score = [x for _, x in got]
    assert score[0] > 0.5 > max(score[1], score[7]) and score[2] == score[3] == score[4] < 0.5 and score[5] == score[6] > 0.5
    assert toxicity.score(df.where("doc_id > 99"), net).collect() == []
    assert np.concatenate(list(toxicity.score_batch(net, pa.RecordBatch.from_pydict({"text": ["", "", "a b", "", "c", ""]})))).shape == (6,)


def test_without_both_labels_scores_are_low(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, F.col("toxic"), F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score(docs, net).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(truth[i], r.predicted) for i, r in got.items() if r.held_out and i in truth]
    bad = [p for y, p in held if y == 1]
    good = [p for y, p in held if y == 0]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)
