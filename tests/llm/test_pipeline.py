"""The pipeline's stages at their own parameters. Small tables of our own."""

import base64
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], KINDS).repartition(3)


@pytest.mark.parametrize("copies", [9, 10, 12])
def test_one_copy_keeps_its_text(spark, copies):
    text = "one line of a copied text\nand another line of it\n\nand a last"
    rows = [(100 + i, text) for i in range(copies)] + [(1, "a text of its own"), (2, None), (3, "")]
    found = pipeline.line_stage(spark, docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in rows)
    full = [r.doc_id for r in found if r.text == text]
    assert full == [100] if copies >= 10 else len(full) == copies
    assert all(not (r.text or "").strip() for r in found if r.doc_id > 99 and r.doc_id not in full)
    assert all(r.n_chars == len(r.text) for r in found if r.text is not None)
    after = pipeline.near_stage(spark, docs(spark, [(r.doc_id, r.text) for r in found]), "").collect()
    assert [r.doc_id for r in after if r.text == text] == [100]


def test_first_lines_against_brute_force(spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(20) if i % (j + 1) == 0)) for i in range(1, 61)]
    where = {}
    for i, t in rows:
        for line in t.split("\n"):
            where.setdefault(line, []).append(i)
    want = {i: "\n".join(x for x in t.split("\n") if len(where[x]) < 10 or where[x][0] == i) for i, t in rows}
    assert {r.doc_id: r.text for r in pipeline.line_stage(spark, docs(spark, rows), "").collect()} == want


def test_no_learned_language_goes(spark):
    rng = random.Random(4)
    parts = {"en": "the ing tion er and of re th", "fr": "que eau ment ai oi la les é", "de": "ung sch ein keit er lich der ü", "es": "ción ado ar os el la mente ñ"}
    words = {k: ["".join(rng.choices(v.split(), k=rng.randint(1, 3))) for _ in range(300)] for k, v in parts.items()}
    clean = [(i, " ".join(rng.choices(words[lang], k=60)), lang) for i, lang in enumerate(sorted(parts) * 60)]
    mixed = [(1000, " ".join(rng.choices(words["fr"], k=30) + rng.choices(words["de"], k=30)), None), (1001, clean[1][1].upper() + "!!", None), (1002, clean[2][1] + " 0cf1bbc67ab39b2d", None)]
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(60)]
    junk = [" ".join(noise), base64.b64encode(rng.randbytes(600)).decode(), "Все люди рождаются свободными и равными. " * 3, "すべての人間は、自由であり " * 5, "Wszyscy ludzie rodzą się wolni i równi pod względem swych praw. " * 3, " ".join(noise * 3) + " " + clean[0][1][:80], "12 34 --", "", None]
    rows = [(i, t, k, None, len(t)) for i, t, k in clean + mixed] + [(2000 + i, t, None, None, 0) for i, t in enumerate(junk)]
    table = spark.createDataFrame(rows, KINDS).repartition(3)
    got = pipeline.language_stage(spark, table, "")
    assert got.columns == table.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _, _ in clean + mixed]
    assert pipeline.language_stage(spark, table.limit(0), "").count() == 0


def brute_heads(rows):
    """The (doc_id, text) that stay, where the first of a group is told by its id alone."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return sorted((rows[i] for i in set(group)), key=repr)


def test_near_rows_of_one_id_and_without(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    rows = [(5, a), (5, b), (5, b), (7, a + " end"), (3, b + " end"), (None, c), (None, c), (9, a), (None, d), (11, d), (12, None), (13, ""), (14, "")]
    for i in range(60):
        base = text()
        rows += [(rng.choice([100 + i, 300 + 2 * i, None]) if k == 0 else 200 + 3 * i + k, base + f" x{k}") for k in range(rng.randint(1, 3))]
    got = pipeline.near_stage(spark, docs(spark, rows), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == brute_heads(rows)
    alone = pipeline.near_stage(spark, docs(spark, [(None, c), (None, c), (None, c + " end"), (None, d)]), "").collect()
    assert len(alone) == 2 and {r.text[:9] for r in alone} == {c[:9], d[:9]}
    assert pipeline.near_stage(spark, docs(spark, []), "").count() == 0


# --- mixing and packing, and all of it ---------------------------------------------------------------------------------------------


def tables(spark, folder, rows, labels, extra=""):
    """A folder with documents and labels; the documents have a clashing column `extra`."""
    df = spark.createDataFrame(rows, KINDS).withColumns({c: F.lit(1) for c in extra.split(",") if c})
    df.repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def corpus(n=240):
    """(rows, labels): documents of words of their domain; every second one is labelled, a third of them toxic."""
    rng = random.Random(5)
    pool = {"good": ["alpha", "beta", "gamma", "shared"], "toxic": ["delta", "zeta", "omega", "shared"], "plain": ["kappa", "iota", "shared"]}
    kinds = [rng.choice([*pool]) for _ in range(n)]
    rows = [(i, " ".join([f"n{i}", *rng.choices(pool[k], k=rng.randint(20, 60))]), "en", "s", 1) for i, k in enumerate(kinds)]
    return rows, [(i, int(k == "good"), int(k == "toxic")) for i, k in enumerate(kinds) if i % 2], kinds


def tokens(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]


def test_mixing_stage(spark, tmp_path):
    rows, labels, kinds = corpus()
    table = tables(spark, tmp_path, rows, labels, "times,row,u")
    got = pipeline.mixing_stage(spark, table, str(tmp_path))
    assert got.columns == table.columns
    kept = [r.doc_id for r in got.collect()]
    texts = {r[0]: r[1] for r in rows}
    size = dict(zip(texts, tokens(list(texts.values())), strict=True))
    total = sum(size.values())
    share = {k: sum(size[i] for i in kept if kinds[i] == k) / total for k in set(kinds)}
    assert all(abs(share[k] - pipeline.TARGETS[k]) < 0.06 for k in share), share
    assert sum(kinds[i] == "toxic" for i in kept) < sum(k == "toxic" for k in kinds) / 4
    assert {r.text for r in got.collect()} <= set(texts.values())
    assert pipeline.mixing_stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_packing_stage(spark):
    rng = random.Random(8)
    texts = [" ".join(["word"] * rng.randint(0, 900)) for _ in range(150)] + [None, "", "same", "same", "long " * 20_000]
    rows = pipeline.packing_stage(spark, docs(spark, [*enumerate(texts), (None, "same"), (3, texts[3]), (4, "another text of an id")]), "").collect()
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert sorted((str(r.doc_id), str(r.text_md5)) for r in rows) == sorted((str(i), str(digest(t))) for i, t in [*enumerate(texts), (None, "same"), (3, texts[3]), (4, "another text of an id")])
    assert sorted(r.n_tokens for r in rows) == sorted(tokens([t or "" for t in [*texts, "same", texts[3], "another text of an id"]]))
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    assert all(r.n_tokens <= r.bucket_len for r in rows)
    assert all(len({r.bucket for r in b}) == 1 and (len(b) == 1 or len(b) * b[0].bucket_len <= 16_384) for b in batches.values())
    assert pipeline.packing_stage(spark, docs(spark, []), "").count() == 0


def test_run_keeps_what_is_clean(spark, tmp_path):
    """Copies, near copies, junk, rows without an id or text, over all stages; nothing of a stage but the last is left behind."""
    rng = random.Random(3)
    parts = {"en": "the ing tion er and of re th", "de": "ung sch ein keit er lich der"}
    words = {k: ["".join(rng.choices(v.split(), k=rng.randint(1, 3))) for _ in range(400)] for k, v in parts.items()}
    clean = [(i, " ".join(rng.choices(words[k], k=80)), k, "s", 9) for i, k in enumerate(["en", "de"] * 60)]
    rows = [*clean, *((500 + i, clean[0][1], "en", "s", 9) for i in range(15)), *((600 + i, clean[1][1] + f" {i}", "de", "s", 9) for i in range(5))]
    rows += [(900, None, "en", None, None), (901, "", None, None, 0), (902, "0000 1111", "en", "s", 1), (903, "xqj zwkq vvxz " * 20, None, "s", 1), (None, clean[4][1], "en", "s", 1), (7, clean[7][1], "de", "s", 1)]
    table = tables(spark, tmp_path, rows, [(i, 1, 0) for i in range(0, 120, 2)], "lang_pred,score,component_id")
    kept = table
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        seen[name] = kept.collect()
        assert name == "packing" or kept.columns == table.columns
    found = sorted(r.doc_id for r in seen["language_id"] if r.doc_id is not None)
    assert found == sorted(r[0] for r in rows if r[0] is not None and r[0] < 900)
    assert len(seen["line_dedup"]) == len(seen["language_id"])
    full = [r for r in seen["ngram_join"] if r.text]
    assert sorted(r.doc_id for r in full) == list(range(120))
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["mixing"]}
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect() if r.doc_id is not None) == sorted((r.doc_id, r.n_tokens) for r in seen["packing"] if r.doc_id is not None)
    import os

    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert len(glob.glob(os.path.join(root, "pipeline-*"))) <= 1


def test_run_on_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_their_own_names(spark, tmp_path):
    """Columns named like those that the operators add come out as they went in."""
    rows, labels, _ = corpus(80)
    clash = "score,known,lang_pred,_row,row,r,w,n_lines,n_dropped,component_id,n_shingles,p,rate,times,u,copy"
    kept = tables(spark, tmp_path, [(i, t + " the and of", *x) for i, t, *x in rows], labels, clash)
    for i, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        assert not kept.where(" or ".join(f"{c} <> 1 or {c} is null" for c in clash.split(","))).count() and kept.count() > 20, name
