"""The training-data operators: brute force, round trips, and odd inputs. Small tables of our own."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from phonoweave.llm import bit_sliced, bloom, components, language_id, line_dedup, media, mixing, ngram_join, packing, queries, token_counts, url_filters, warc

LONG = "word " * 400_000  # 2 MB
ODD = [None, "", " ", "\n\n", "a", "é", "\0", LONG, "x" * 300_000, "日本語 テキスト"]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", None, None, *([1] * (len(extra.split(",")) if extra else 0))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KINDS + (", " + ", ".join(f"{c} int" for c in extra.split(",")) if extra else ""))


def empty(spark):
    return spark.createDataFrame([], KINDS)


# --- filters and components ------------------------------------------------------------------------------------------------------


def test_bloom_never_misses(spark):
    keys = [hashlib.md5(str(i).encode()).digest()[:8] for i in range(3000)]
    rows = [(k,) for i, k in enumerate(keys) for _ in range(1 + (i % 3 == 0))]
    df = spark.createDataFrame(rows, "k binary").repartition(5)
    got = bloom.build_twice(df, lambda b: iter([np.frombuffer(b"".join(b.column("k").to_pylist()), np.uint64)]), len(rows))
    hit = got.suspects(np.frombuffer(b"".join(keys), np.uint64))
    assert hit[::3].all() and hit.mean() < 0.45
    assert not bloom.build_twice(df.limit(0), lambda b: iter([np.zeros(0, np.uint64)]), 0).suspects(np.frombuffer(keys[0], np.uint64)).any()


@pytest.mark.parametrize(("keys", "held"), [(3000, 1 << 22), (2_000_000, 500)])
def test_repeat_filter(spark, keys, held, monkeypatch):
    """No key that is there twice is missed, in one task or in two, in one segment or many; few others are suspected."""
    monkeypatch.setattr(bloom, "KEYS_HELD", held)
    rng = np.random.default_rng(keys)
    once, twice = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, 700).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    own = np.concatenate([once, twice, twice, twice[:50]])
    rng.shuffle(own)
    df = spark.createDataFrame([(own[i : i + 997].tobytes(),) for i in range(0, len(own), 997)], "k binary").repartition(5)
    got = bloom.build_repeats(df, lambda b: iter([np.frombuffer(x, np.uint64) for x in b.column("k").to_pylist()]), keys)
    assert got.suspects(twice).all() and got.suspects(once).mean() < (0.02 if keys > 20_000 else 0.5)
    assert not bloom.build_repeats(df.limit(0), lambda b: iter([np.zeros(0, np.uint64)]), 0).suspects(once[:9]).any()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)] + [(5, None), (7, 7)]
    got, _ = components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    rows = got.collect()
    assert {r.node: r.component for r in rows} == {x: find(x) for x in list(parent)} and len(rows) == len(parent)


# --- 1 and 8 ---------------------------------------------------------------------------------------------------------------------


PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def two_domains(spark):
    rng = random.Random(3)
    make = lambda kind: " ".join(rng.choices(["alpha", "beta", "gamma"] if kind == "x" else ["delta", "beta", "zeta"], k=30))
    kinds = ["x"] * 240 + ["y"] * 60
    df = docs(spark, [make(k) for k in kinds])
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds) if i % 2] + [(None, "x"), (3, None), (9999, "y")], "doc_id long, kind string")
    return kinds, df, mixing.fit(df, labels, F.col("kind"))


def test_classifier_and_rates(spark):
    kinds, df, model = two_domains(spark)
    rates, found = mixing.mix(df, model, {"x": 0.5, "y": 0.5}, 1.0, PATH)
    out = rates.collect()
    right = [k == model.domains[int(np.argmax(r.p))] for r in out for k in [kinds[r.doc_id]]]
    assert np.mean(right) > 0.97  # half of them held out
    total = sum(r.n_tokens for r in out)
    assert [r.n_tokens for r in sorted(out, key=lambda r: r.doc_id)] == library([r.text for r in df.orderBy("doc_id").collect()])
    shares = sum(r.rate * r.n_tokens * np.array(r.p) for r in out) / total
    assert np.abs(shares - 0.5).max() < 1e-5 and min(r.rate for r in out) >= 0 and found.residual < 1e-5
    copies = mixing.resample(df, model, {"x": 0.5, "y": 0.5}, 1.0, PATH)
    assert copies.columns == df.columns and abs(copies.count() - sum(r.rate for r in out)) < 40


def by_rates(spark, p, n, goal, **more):
    df = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(len(n))], "doc_id long, n_tokens long, p array<double>")
    found = mixing.solve(df, goal, **more)
    return found, np.array([x.rate for x in mixing.with_rates(df, found.offset).orderBy("doc_id").collect()])


@pytest.mark.parametrize("goal", [[0.02, 0.9, 0.08], [0.7, 0.28, 0.02], [0.2, 0.2, 0.6]])
def test_least_squares_against_brute_force(spark, goal):
    """Plain projected gradient, many steps; the first two goals make rates 0."""
    rng, goal = np.random.default_rng(5), np.array(goal)
    p, n = rng.dirichlet([0.3] * 3, 60), rng.integers(1, 50, 60)
    found, r = by_rates(spark, p, n, goal)
    g = np.linalg.inv((p * n[:, None]).T @ p / n.sum())
    plain = np.ones(60)
    for _ in range(20_000):
        plain = np.maximum(0, plain + p @ g @ (goal - (plain * n) @ p / n.sum()))
    loss = lambda r: float(np.abs(goal - (r * n) @ p / n.sum()).max())
    assert (r >= 0).all() and found.residual < 2e-5 and loss(r) <= loss(plain) + 2e-5 and np.abs((r * n) @ p / n.sum() - found.reached).max() < 1e-9
    assert (r == 0).any() == (goal.max() > 0.65) and found.passes < 30
    assert (n * (r - 1) ** 2).sum() <= (n * (plain - 1) ** 2).sum() + 1e-3  # the nearest to 1 of those that reach it


def test_targets_out_of_reach(spark):
    p = np.array([[0.6, 0.4], [0.5, 0.5]])
    found, r = by_rates(spark, p, [10, 10], np.array([1.0, 0.0]))
    best = min(((1 - 0.3 * a - 0.25 * b) ** 2 + (0.2 * a + 0.25 * b) ** 2, a, b) for a in np.linspace(0, 5, 501) for b in (0.0, 0.1, 0.5))
    assert found.residual > 0.1 and r[1] == 0 and abs(r[0] - best[1]) < 0.02
    with pytest.raises(RuntimeError, match="did not settle"):
        by_rates(spark, p, [10, 10], np.array([1.0, 0.0]), passes=2)


def test_mixing_odd_inputs(spark):
    model = mixing.train([("a", "one two"), ("b", "three"), ("a", "")])
    rows = mixing.mix(docs(spark, ODD, "rate,p,n_tokens"), model, {"a": 1, "b": 1}, 1.0, PATH)[0].collect()
    assert len(rows) == len(ODD) and all(r.rate >= 0 for r in rows) and {r.doc_id: r.n_tokens for r in rows}[7] == library([LONG])[0]
    assert mixing.mix(empty(spark), model, {"a": 1}, 1.0, PATH)[0].count() == 0
    assert [r.rate for r in mixing.mix(docs(spark, [None, ""]), model, {"a": 1}, 1.0, PATH)[0].collect()] == [1.0, 1.0]
    none = mixing.fit(empty(spark), spark.createDataFrame([], "doc_id long, kind string"), F.col("kind"))
    assert abs(mixing.mix(docs(spark, ["a b"]), none, {}, 2.0, PATH)[0].first().rate - 2.0) < 1e-6
    odd = spark.createDataFrame([(None, "a b", "en", None, None), (1, "c", "en", None, None), (1, "c", "en", None, None), (2, None, "en", None, None)], KINDS)
    same = mixing.resample(odd.withColumns({x: F.lit(1) for x in ("row", "u", "times", "copy")}), none, {}, 1.0, PATH)
    assert same.count() == 4 and same.columns == [*odd.columns, "row", "u", "times", "copy"]
    assert mixing.resample(empty(spark), none, {}, 1.0, PATH).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, ["a"]), model, {"c": 1}, 1.0, PATH)


def test_word_hashes():
    from phonoweave.llm import common

    rng = random.Random(8)
    texts = ["".join(rng.choices(["ab", "Ab", "c", " ", "\n", "\x0b", "é"], k=rng.randint(0, 30))) for _ in range(50)]
    texts += [LONG, " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000)), "x" * 1_200_000 + " y", ""]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, n = common.word_hashes(at, np.frombuffer(b"".join(raw), np.uint8))
    want = [[w.lower() for w in r.split()] for r in raw]
    assert n.tolist() == [len(w) for w in want]
    flat = [w for own in want for w in own]
    seen = dict(zip(flat, h.tolist(), strict=True))
    assert [seen[w] for w in flat] == h.tolist() and len(set(seen.values())) == len(seen)


def test_boundaries_are_best():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 9) for _ in lengths])
        k = rng.randint(1, 4)
        cost = lambda ends: sum(int(c) * min(e for e in ends if e >= x) for x, c in zip(lengths.tolist(), counts, strict=True))
        import itertools

        best = min(cost([*some, int(lengths[-1])]) for m in range(min(k, len(lengths))) for some in itertools.combinations(lengths[:-1].tolist(), m))
        ends = packing.boundaries(lengths, counts, k)
        assert len(ends) <= k and cost(ends.tolist()) == best


def test_packing(spark):
    rng = random.Random(4)
    sizes = [rng.randint(0, 300) for _ in range(500)] + [5000, 0, 7, 7]
    df = spark.createDataFrame([(i % 400, n) for i, n in enumerate(sizes)] + [(None, None)], "doc_id long, n_tokens long")
    rows = packing.pack(df, buckets=5, budget=1000).collect()
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault(r.batch_id, []).append(r)
    assert len(rows) == len(sizes) + 1 and sorted(r.n_tokens for r in rows) == sorted([*sizes, 0])
    assert all(len(b) == 1 or len(b) * b[0].bucket_len <= 1000 for b in batches.values()) and all(len({r.bucket for r in b}) == 1 for b in batches.values())
    assert packing.pack(df.limit(0)).count() == 0
    lengths = {r.doc_id: r.n_tokens for r in packing.pack_documents(docs(spark, ODD, "bucket,slot,batch,n_tokens"), PATH).collect()}
    assert lengths == dict(enumerate(library([t or "" for t in ODD])))
    nameless = packing.pack(spark.createDataFrame([(None, 10)] * 300, "doc_id long, n_tokens long").repartition(3), 2, 100).groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in nameless) == 300 and max(r["count"] for r in nameless) <= 10


def test_packing_deals_one_id_over_slots(spark):
    """60,000 rows of one id go to several slots; all rows are there, batches are full but for one a slot, and the same each time."""
    df = spark.createDataFrame([(7, 10, "x")], "doc_id long, n_tokens long, batch string").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(60_000)))).drop("_")
    rows = [sorted(packing.pack(part, 2, 1000).groupBy("batch_id").count().collect()) for part in (df, df.repartition(7))]
    assert rows[0] == rows[1] and sum(r["count"] for r in rows[0]) == 60_000 and max(r["count"] for r in rows[0]) == 100
    slots = {r.batch_id.rsplit("-", 1)[0] for r in rows[0]}
    assert len(slots) == 3 and sum(r["count"] < 100 for r in rows[0]) <= 3


def test_optimal_boundaries_of_long_lengths(spark):
    """Every length up to 5,000 tokens may be a boundary: the cost is that of a plain dynamic program."""
    rng = random.Random(6)
    sizes = [rng.choice([rng.randint(0, 300), rng.randint(900, 5000)]) for _ in range(400)]
    for buckets in (1, 3, 6):
        rows = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long"), buckets, 10**6).collect()
        lengths = sorted(set(sizes))
        counts = [sizes.count(x) for x in lengths]
        best = [0.0] + [float("inf")] * len(lengths)
        for _ in range(buckets):
            best = [0.0] + [min(best[i] + lengths[j] * sum(counts[i : j + 1]) for i in range(j + 1)) for j in range(len(lengths))]
        assert sum(r.bucket_len for r in rows) == best[-1] and len({r.bucket for r in rows}) <= buckets


# --- 2 ---------------------------------------------------------------------------------------------------------------------------


def text_of(rng, words, n):
    return " ".join(rng.choices(words, k=n))


WORDS = {"aa": ["schnell", "schaft", "keit", "einung"], "bb": ["tion", "ing", "ness", "the"], "cc": ["eaux", "oui", "été", "ment"]}


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, WORDS[k], 40), k if i % 7 else None, None, None) for i, k in enumerate(rng.choices(list(WORDS), k=300))]
    truth = [next(k for k, w in WORDS.items() if r[1].split()[0] in w) for r in rows]
    df = spark.createDataFrame(rows, KINDS)
    model = language_id.fit(df)
    out = {r.doc_id: r for r in language_id.identify(df.withColumns({"score": F.lit("x"), "lang_pred": F.lit(0)}), model).collect()}
    held = [i for i in out if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.98 and all(0 <= r.score <= 1 for r in out.values())
    odd = {r.doc_id: r for r in language_id.identify(docs(spark, [*ODD, "123 !?"]), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3, 6, 10)] == ["und"] * 6 and odd[0].score == 0 and odd[7].lang_pred in WORDS
    assert language_id.identify(empty(spark), model).count() == 0
    nothing = language_id.fit(empty(spark))
    assert language_id.identify(docs(spark, ["abc"]), nothing).first().lang_pred == "und"
    mixed = text_of(rng, WORDS["aa"], 30) + " " + text_of(rng, WORDS["cc"], 10)
    w = language_id.read_words([mixed])
    p = model.posteriors(model.emissions(w), w.text)
    assert (p[:30].argmax(axis=1) == 0).mean() > 0.9 and (p[30:].argmax(axis=1) == 2).mean() > 0.8


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.zeros((1 << language_id.TABLE_BITS, 3), np.float32), rng.normal(size=(3, 3)))
    e = rng.normal(size=(5, 3)).astype(np.float32)
    want, weight, pairs_want = np.zeros((5, 3)), 0.0, np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=5):
        s = np.exp(sum(e[i, y] for i, y in enumerate(path)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(path)))
        weight += s
        for i, y in enumerate(path):
            want[i, y] += s
        for a, b in itertools.pairwise(path):
            pairs_want[a, b] += s
    pairs = np.zeros((3, 3))
    assert np.abs(model.posteriors(e, np.zeros(5, int), pairs) - want / weight).max() < 1e-5 and np.abs(pairs - pairs_want / weight).max() < 1e-5


def test_one_chain_a_text(monkeypatch):
    rng = np.random.default_rng(4)
    model = language_id.Model(["a", "b", "c"], np.zeros((1 << language_id.TABLE_BITS, 3), np.float32), 2 * rng.normal(size=(3, 3)))
    sizes = [5, 1, 12, 13, 24, 100]
    e, text = rng.normal(size=(sum(sizes), 3)).astype(np.float32), np.repeat(np.arange(6), sizes)
    results = []
    for window in (12, 1000):
        monkeypatch.setattr(language_id, "WINDOW", window)
        pairs = np.zeros((3, 3))
        results.append((model.posteriors(e, text, pairs), pairs))
    assert np.abs(results[0][0] - results[1][0]).max() < 1e-5 and np.abs(results[0][1] - results[1][1]).max() < 1e-3
    monkeypatch.setattr(language_id, "PART", 50)
    words = " ".join(rng.choice(["ab", "cde", "fé", "12", "ghi"], 300))
    assert "".join(language_id.text_parts(words)) == words and max(map(len, language_id.text_parts(words))) < 60


def test_words_that_lower_casing_parts(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, ["İstanbul", "İZMİR", "güzel"] if i % 2 else WORDS["aa"], 30), "tr" if i % 2 else "aa", None, None) for i in range(80)]
    model = language_id.fit(spark.createDataFrame(rows, KINDS))
    assert [x[0] for x in (model.predict(["İstanbul güzel"]), model.predict(["schnell schaft"]))] == [["tr"], ["aa"]]


def test_language_spans(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, WORDS[k], 40), k, None, None) for i, k in enumerate(rng.choices(list(WORDS), k=200))]
    model = language_id.fit(spark.createDataFrame(rows, KINDS))
    mixed = text_of(rng, WORDS["aa"], 100) + " 12, " + text_of(rng, WORDS["cc"], 90)
    got = {r.doc_id: r.spans for r in language_id.label_words(docs(spark, [mixed, *ODD], "spans"), model).collect()}
    assert [(x.first, x.words, x.lang) for x in got[0]] == [(0, 100, "aa"), (100, 90, "cc")] and all(0.5 < x.score <= 1 for x in got[0])
    assert got[1] == [] and got[2] == [] and sum(x.words for x in got[8]) == 400_000
    assert language_id.label_words(empty(spark), model).count() == 0
    nothing = language_id.fit(empty(spark))
    assert language_id.label_words(docs(spark, ["abc"]), nothing).first().spans == []


# --- 3 ---------------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    rng = random.Random(7)
    shared = "".join(rng.choices("abcdefgh \n", k=20_000))
    texts = [*ODD, shared, shared + "tail", "head" + shared, "ab" * 288, "q" * 576, *(["copy " * 500] * 30)]
    df = docs(spark, texts, "digest,frame,chunks,row")
    store = media.MediaStore(df.select("doc_id", "text"))
    built = {r.doc_id: b"".join(__import__("zstandard").ZstdDecompressor().decompress(x.frame) for x in r.chunks) for r in store.payload_rows().collect()}
    assert all(built[i] == media.pad((t or "").encode()) for i, t in enumerate(texts)) and len(built) == len(texts)
    out = {r.doc_id: r for r in media.media_features(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = media.pad(raw)
        assert len(p) % 576 == 0 and (out[i].n_bytes, out[i].payload_bytes) == (len(raw), len(p))
        assert out[i].payload_sha256 == hashlib.sha256(p).hexdigest() and out[i].tail_crc32 == zlib.crc32(p[-32:])
    assert len({(out[i].media_sha256, out[i].feature) for i in range(15, 45)}) == 1
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    assert media.media_features(empty(spark)).count() == 0


def test_chunks_follow_content():
    rng = random.Random(8)
    body = bytes(rng.choices(range(256), k=60_000))
    a, b = media.chunk_payloads([body, b"some more bytes in front" + body])
    assert b"".join(a) == body and len(a) > 10 and len(set(a) & set(b)) >= len(a) - 2
    assert all(len(c) <= media.MAX_CHUNK for c in a) and all(len(c) >= media.MIN_CHUNK for c in a[:-1])
    assert media.chunk_payloads([body])[0] == a and media.chunk_payloads([b"\1" * 999, body])[1] == a
    slow = [sum(int(media.GEAR[body[i - j]]) << j for j in range(32)) & 0xFFFFFFFF for i in range(40, 60)]
    assert media.gear(np.frombuffer(body, np.uint8))[40:60].tolist() == slow


# --- 4 ---------------------------------------------------------------------------------------------------------------------------


def brute_top(rows, queries_, k):
    fine = [(i, np.floor(np.array(v, float) * 1024).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in fine:
        if q in queries_:
            hits = sorted((-int(v @ w), i) for i, w in fine if i != q and len(w) == len(v))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(hits[:k])}
    return out


@pytest.mark.parametrize("block", [7, 1 << 13])
def test_top_k(spark, block, monkeypatch):
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", block)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0, 0.01, 1, 3])]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(30)] + [(300, None), (301, []), (302, [None] * 6), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (310, [1.0, 2.0]), (320, [3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("block", F.lit(2)).repartition(3)
    got = bit_sliced.top_k(df, df.where("vec_id % 10 = 0"), 10)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, range(0, 1000, 10), 10)
    none = df.where("vec_id < 0")
    assert bit_sliced.top_k(df, none).count() == 0 and bit_sliced.top_k(none, df).count() == 0 and bit_sliced.top_k(none, none).count() == 0


@pytest.mark.parametrize("cell", [1, 1 << 25])
def test_top_k_broadcasts_no_queries(spark, cell, monkeypatch):
    """Every block of the index meets every block of queries once, dealt by cells, and no copies of the queries are broadcast."""
    monkeypatch.setattr(bit_sliced, "BLOCK_ROWS", 16)
    monkeypatch.setattr(bit_sliced, "CELL_BYTES", max(cell, 300))
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 50]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = bit_sliced.top_k(df, df.where("vec_id % 5 = 0"), 10)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows, range(0, 150, 5), 10)


def test_top_k_of_great_components(spark):
    """Scores up to 62 bits are exact; vectors whose scores might leave 64 bits take no part."""
    most = math.isqrt((1 << 62) // 2) / 1024
    rows = [(0, [most - 4, 1.0]), (1, [most - 4, -(most - 4)]), (2, [-(most - 4), most - 4]), (3, [1e300, 0.0]), (4, [3e9, 3e9]), (5, [0.5, 0.5]), (6, [-1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i not in (3, 4, 6)}
    got = {(r.query_id, r.vec_id): r.score for r in bit_sliced.top_k(df, df, 10).collect()}
    assert got == {(a, b): sum(x * y for x, y in zip(fine[a], fine[b], strict=True)) for a in fine for b in fine if a != b}



# --- 5 ---------------------------------------------------------------------------------------------------------------------------

PIECES = ["a", "s", "t", "re", "'", "'s", "'ll", "'VE", " ", "  ", "\n", "\t", "1", "²", "é", "ﬁ", "中", ".", "!!", "<|endoftext|>", "<|endof", "the", "don't", "\x1c", "\x85", " ", "_", "😀", "Ab", "\0", "́", "　"]


def test_the_splitter_looks_bytes_up():
    """The tables for bytes are those of the automaton, and maps of states are composed row by row."""
    for table, want in ((token_counts._AFTER, token_counts.AFTER), (token_counts._BEGINS, token_counts.BEGINS)):
        at = np.arange(len(want), dtype=np.uint8).reshape(2, -1)
        assert token_counts._looked_up(at, table).tolist() == want[at].astype(np.uint8).tolist()
    a, b = np.random.default_rng(1).integers(0, token_counts.N_STATES, (2, 50, token_counts.N_STATES)).astype(np.uint8)
    assert token_counts.compose(a, b).tolist() == [[int(y[x]) for x in row] for row, y in zip(a, b, strict=True)]


def test_tokens_against_the_library():
    rng = random.Random(10)
    with open(PATH, encoding="utf-8") as f:
        compiled = token_counts.CompiledTokenizer(f.read())
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(6000)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(c) for c in range(a, a + 256)) for a in (0, 0x100, 0x300, 0x600, 0x900, 0x2000, 0x2100, 0x3000, 0xFF00)]
    assert compiled.count(texts).tolist() == library(texts)
    compiled.counter.pieces, compiled.counter.LONG, compiled.counter.MOST_EDGES = token_counts.Table(7), 6, 5  # forgetting changes nothing
    assert compiled.count(texts[:500]).tolist() == library(texts[:500])


def test_tokens_of_long_texts_in_parts(monkeypatch):
    rng = random.Random(12)
    with open(PATH, encoding="utf-8") as f:
        compiled = token_counts.CompiledTokenizer(f.read())
    monkeypatch.setattr(token_counts, "PART", 20)
    texts = ["".join(rng.choices([*PIECES, " ", " "], k=rng.randint(0, 120))) for _ in range(800)] + ["a" * 3000, " " * 900, "ab'll " * 300]
    assert compiled.count(texts).tolist() == library(texts)


def test_table_of_numbers():
    rng = np.random.default_rng(1)
    t, keys = token_counts.Table(12), np.unique(rng.integers(0, 1 << 60, 1500).astype(np.uint64))
    t.put(keys, np.ones_like(keys), np.arange(len(keys)))
    assert (t.get(keys, np.ones_like(keys)) == np.arange(len(keys))).all() and (t.get(keys, keys | np.uint64(2)) == -1).all()
    t.put(keys + np.uint64(1 << 61), np.ones_like(keys), np.arange(len(keys)))  # too many: the first are forgotten
    assert (t.get(keys, np.ones_like(keys)) == -1).all()


def test_maps_compose():
    rng = np.random.default_rng(3)
    syms = rng.integers(0, token_counts.N_SYMBOLS, 5000).astype(np.uint8)
    state, want = token_counts.FRESH, []
    for i, s in enumerate(syms.tolist()):
        at = s * token_counts.N_STATES + state
        if token_counts.BEGINS[at]:
            want.append(i)
        state = token_counts.AFTER[at]
    assert token_counts.piece_starts(syms).tolist() == want


def test_count_tokens(spark):
    out = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, ODD, "n_tokens,over_limit"), PATH, 1024).collect()}
    want = library([t or "" for t in ODD])
    assert [out[i].n_tokens for i in range(len(ODD))] == want and [out[i].over_limit for i in range(len(ODD))] == [n > 1024 for n in want]
    assert [out[i].n_bytes for i in range(len(ODD))] == [len((t or "").encode()) for t in ODD]
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets, parent = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("task_rows", [2, 4096])
def test_near_duplicates(spark, task_rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "TASK_ROWS", task_rows)
    rng = random.Random(11)
    texts = [*ODD[:6], ODD[9]]
    for _ in range(12):  # families with few and many edits, so that some are linked through others only
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 200))]
        texts += [edited(rng, base, rng.randrange(0, 9)) for _ in range(12)] + [" ".join(base)] * 2
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([5, 10, 20, 200]))) for _ in range(60)]
    texts += ["one two three", "One  TWO\tthree", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, cls int, component_id int").repartition(4)
    assert {tuple(r) for r in ngram_join.near_duplicates(df).collect()} == brute_groups(rows)


def test_classes_of_one_name_are_named_anew(spark, monkeypatch):
    """Names of 64 bits of which only 4 count at first: many classes share one."""
    own = ngram_join.class_of
    monkeypatch.setattr(ngram_join, "class_of", lambda s, seed=0: (own(s, seed)[0] & 15 if seed < 2 else own(s, seed)[0], own(s, seed)[1]))
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(20)) for _ in range(60)]
    rows = list(enumerate(texts + texts[:5]))
    kept = ngram_join._Join(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    with pytest.raises(ngram_join._SameName):
        kept.links(kept.store(kept.profile(), "profile"))


def test_near_duplicates_odd(spark):
    long = spark.createDataFrame([(3, LONG), (4, LONG + "x"), (3, LONG), (8, None), (9, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(long).collect()) == [(3, 1, 3), (3, 1, 3), (4, 2, 4), (8, 0, 8), (9, 0, 9)]
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_shingle_sets_against_brute_force():
    rng = random.Random(12)
    texts = ["".join(rng.choices(["a", "B", "cd", " ", "\n", "\x0b", "é", "\x1f", "\xa0"], k=rng.randint(0, 60))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    for t, s in zip(texts, ngram_join.shingle_sets(at, np.frombuffer(b"".join(raw), np.uint8)), strict=True):
        assert {(0, len(s), 0)} == {(0, n, 0) for _, n, _ in brute_groups([(0, t)])}


# --- 7 ---------------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    page = lambda u: f'<html><head><link rel="canonical" href="{u}"></head>'
    rows = [
        (1, "https://Example.com/en/a?x#y", None), (2, "http://www.example.com/en/", ""), (3, "no scheme", "<p>"), (4, None, None), (5, "http://a.net/es/b", "x"),
        (6, "http://b.org/1", page("http://a.net/fr/c")), (7, "http://c.org/2#top", '<META content="0; URL=http://b.org/1" http-equiv="refresh">'), (8, "http://d.org/3", page("/4")), (9, "http://d.org/4", None),
        (10, "http://e.org/5", page("http://a.net/es/z")), (11, "http://e.org/5", None), (12, "http://f.org/6", page("http://ok.com/7")), (13, "http://f.org/8", '<link href="http://f.org/6" rel=canonical>' + page("http://a.net/es/q")), (14, "://x", None), (15, "http://net", None), (16, "http://anet/es/", None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "node": F.lit(3)})
    got = {r.page_id: r for r in url_filters.judge_urls(df, queries.RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("example.com", "/en/a", "example.com/en/", "block")
    assert (got[2].rule, got[2].verdict) == ("www.example.com/en/", "allow") and [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (3, 4)] == [("", "", None, "allow")] * 2
    assert [got[i].verdict for i in (5, 6, 7, 8, 9, 10, 11)] == ["block", "block", "block", "allow", "allow", "block", "block"]
    assert [got[i].verdict for i in (12, 13)] == ["allow", "allow"] and got[14].host == "x" and got[15].rule is None and got[16].rule is None and len(got) == 16
    joined = url_filters.judge_urls(df, spark.createDataFrame(queries.RULES, "action string, host string, path string"))
    assert {r.page_id: tuple(r) for r in joined.collect()} == {i: tuple(r) for i, r in got.items()}
    given = url_filters.judge_urls(df.where("page_id in (8, 9)").drop("html").withColumn("html", F.lit(None).cast("string")), queries.RULES, spark.createDataFrame([("http://d.org/4", "http://a.net/fr/")], "a string, b string"))
    assert {r.page_id: r.verdict for r in given.collect()} == {8: "allow", 9: "block"}
    assert url_filters.judge_urls(df.limit(0), queries.RULES).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ('<link rel=canonical href="page.html">', ["http://a.net/es/page.html"]),
        ('<link rel="canonical" href="../x">', ["http://a.net/x"]),
        ("<link rel='canonical' href='./y/./z/..'>", ["http://a.net/es/y/"]),
        ('<link rel=canonical href="../../../x">', ["http://a.net/x"]),
        ('<link rel=canonical href="?p=1">', ["http://a.net/es/d?p=1"]),
        ('<link rel=canonical href="#top">', []),
        ('<link rel=canonical href="//B.org/X?y=Z#t">', ["http://b.org/X?y=Z"]),
        ('<link rel=canonical href="/q?a=1&amp;b=2&#38;c=&#x26;amp;">', ["http://a.net/q?a=1&b=2&c=&amp;"]),
        ('<link rel=canonical href="/&#233;&#x65E5;&#xD800;&">', ["http://a.net/é日&"]),
        ('<LINK HREF=HTTP://B.org/P REL="alternate Canonical">', ["http://b.org/P"]),
        ("""<link rel="canonical" href="/it's">""", ["http://a.net/it's"]),
        ('<link rel=canonical href=/1><link rel="canonical" href="/2"><meta http-equiv=refresh content="0;url=/3"><meta http-equiv="refresh" content="5; /4">', [f"http://a.net/{i}" for i in (1, 2, 3, 4)]),
        ("""<meta http-equiv="refresh" content="0; URL='../r?x=1&amp;y'">""", ["http://a.net/r?x=1&y"]),
        ('<meta http-equiv="refresh" content="url=s">', ["http://a.net/es/s"]),
        ('<meta http-equiv="refresh" content="30"><link rel="canonicalx" href="/n"><link data-rel="canonical" href="/n"><link rel=canonical href="mailto:x">', []),
        ('<base href="/b/c"><link rel=canonical href="d">', ["http://a.net/b/d"]),
    ],
)
def test_url_targets(spark, html, want):
    df = spark.createDataFrame([(1, "HTTP://A.net/es/d?e#f", html)], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in url_filters.page_edges(df).collect()) == [("http://a.net/es/d?e", x) for x in want]


def test_components_of_urls_against_brute_force(spark):
    """Random canonical links and refreshes, in absolute, relative and differently written forms; unions on the driver."""
    rng = random.Random(11)
    hosts = ["a.net", "b.org", "c.org", "ok.com", "example.com", "d.org"]
    paths = ["/es/1", "/fr/2", "/en/3", "/4", "/5", "/6"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    parent = {u: u for u in urls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    table = []
    for i, u in enumerate(urls):
        html = ""
        for v in rng.sample(urls, rng.choice([0, 0, 0, 1, 1])):
            same = u.split("/")[2] == v.split("/")[2]
            written = rng.choice([v, v.replace("http://", "HTTP://").replace(".org", ".ORG"), v + "#x", "//" + v[7:], *(["/" + v.split("/", 3)[3]] if same else [])])
            html += f'<link rel=canonical href="{written}">' if rng.random() < 0.5 else f'<meta http-equiv="refresh" content="0; url={written}">'
            parent[find(u)] = find(v)
        table.append((i, u, html or None))

    def own(u):
        host, path = u[7:].split("/", 1)
        fits = [(h + p, a) for a, h, p in queries.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits, key=lambda x: len(x[0]))[1] if fits else None

    told = {}
    for u in urls:
        told.setdefault(find(u), set()).add(own(u))
    want = [own(u) or ("block" if "block" in told[find(u)] and "allow" not in told[find(u)] else "allow") for u in urls]
    got = url_filters.judge_urls(spark.createDataFrame(table, "page_id long, url string, html string"), queries.RULES).orderBy("page_id").collect()
    assert [r.verdict for r in got] == want
    heard = [told[find(u)] for u in urls if own(u) is None]  # pages without a rule: block and allow are inherited, and allow goes first
    assert {None, "block"} in heard and {None, "allow"} in heard and {None, "allow", "block"} in heard


def test_url_aliases_of_blocked(spark):
    rows = [("http://b.org/fr/1?page=2&ref=x", '<link rel=canonical href="//A.net/fr/x">'), ("http://b.org/2", '<link rel=canonical href="fr/1?page=2&amp;ref=x">'), ("http://B.org/3", None), ("http://c.org/4", '<meta http-equiv=refresh content="0;url=http://b.ORG/3"><meta http-equiv=refresh content="0;url=http://A.NET/fr/x">'), ("http://d.org", "<link rel=canonical href=e>")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    assert [r.verdict for r in url_filters.judge_urls(df, queries.RULES).orderBy("page_id").collect()] == ["block"] * 4 + ["allow"]


# --- 9 ---------------------------------------------------------------------------------------------------------------------------


def brute_lines(texts, min_docs, keep="none"):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    lines = [(t or "").split("\n") for t in texts]
    n, first = {}, {}
    for d, own in enumerate(lines):
        for i, k in enumerate(map(key, own)):
            first.setdefault(k, (d, i))
        for k in {*map(key, own)}:
            n[k] = n.get(k, 0) + 1
    gone = {k for k, c in n.items() if k and c >= min_docs}
    return [(len(own), "\n".join(x for i, x in enumerate(own) if key(x) not in gone or (keep == "first" and first[key(x)] == (d, i)))) for d, own in enumerate(lines)]


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize(("min_docs", "keep"), [(3, "none"), (2, "first")])
def test_lines(spark, limit, min_docs, keep, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    rng = random.Random(13)
    pool = [f"line {i}" for i in range(30)] + ["Line 1", " line 2\t", "", "É", "é", "\x0bx", "\x1cx", "x"]
    texts = [*ODD, *("\n".join(rng.choices(pool, k=rng.randint(0, 8))) for _ in range(80))]
    df = docs(spark, texts, "n_lines,n_dropped,digest,line").repartition(4)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df, min_docs, keep).collect()}
    for i, (n, left) in enumerate(brute_lines(texts, min_docs, keep)):
        assert (got[i].n_lines, got[i].text or "") == (n, left), i
        assert got[i].n_dropped == n - (left.count("\n") + 1 if got[i].n_dropped < n else 0)
    assert line_dedup.dedup_lines(empty(spark), 2).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, 2, "some")


# --- 10 --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [0, 10**6])
def test_warc(spark, limit, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_KEYS", limit)
    big = "<p>" + "y" * 200_000
    rows = [(1, "http://a", "z" * 100), (2, "http://b\r\nX: y", "z" * 100), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (0, "u", big), (9, "u", "é" * 60 + "\r\n\r\nWARC/1.0\r\n\r\n"), (None, "u", "z" * 100), (1, "http://a", "z" * 100), (10, "u", "z" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "record_type": F.lit(2)}).repartition(3)
    got = sorted(warc.archive_pages(df, 100, chunk_bytes=1000).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    want = []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == raw]
        revisit = len(raw) >= 100 and page is not None and page != min(same)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert [tuple(r) for r in got] == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_file_form(spark):
    df = spark.createDataFrame([(i, f"http://x/{i}", "body %d " % i * (i * 50)) for i in range(20)], "page_id long, url string, html string")
    chunks = warc.write_archives(df, chunk_bytes=700).df.collect()
    assert max(len(c.data) for c in chunks) <= 1200 and any(c.n_chunks > 3 for c in chunks)
    chunks.sort(key=lambda c: (*map(int, c.record_id.split(":")), c.chunk_no))
    archive = b"".join(c.data for c in chunks)
    for size in (1, 7, 4096, 10**7):
        found = list(warc.RecordReader().feed_all(io.BytesIO(archive), size))
        assert sorted(int(f["X-Page-Id"]) for f in found) == [*range(20)] and all(f["WARC-Payload-Digest"] == "sha256:" + f["sha256"] for f in found)
    assert archive.count(b"HTTP/1.1 200 OK\r\n") == 20 and all(f["WARC-Record-ID"].startswith("<urn:uuid:") for f in found) and len({f["WARC-Record-ID"] for f in found}) == 20
    same = warc.write_archives(spark.createDataFrame([(i, "u", "z" * 300) for i in (5, 6)], "page_id long, url string, html string"), date="2021-02-03T04:05:06Z").df.collect()
    first, again = sorted(warc.RecordReader().feed_all(io.BytesIO(b"".join(c.data for c in same))), key=lambda f: f["WARC-Type"])
    assert (first["WARC-Type"], again["WARC-Type"], again["Content-Length"]) == ("response", "revisit", "0") and again["WARC-Refers-To"] == first["WARC-Record-ID"] and again["WARC-Date"] == "2021-02-03T04:05:06Z"
    for bad in (b"nothing\r\n\r\n", b"WARC/1.0\r\nContent-Type: application/http\r\nContent-Length: 4\r\n\r\nabcd"):
        with pytest.raises(ValueError):
            list(warc.RecordReader().feed(bad))
    damaged = [c.asDict() | ({"data": bytes(len(c.data))} if c.chunk_no == 1 else {}) for c in chunks]
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark.createDataFrame(damaged, "record_id string, chunk_no int, n_chunks int, data binary, state binary")).collect()
