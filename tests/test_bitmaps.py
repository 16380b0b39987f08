"""Bitmap indexes, tiles and keyed layouts against plain counts; what they read."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from phonoweave.functions.inventory import letter_table, phonetic_table
from phonoweave.operators import bitmaps, diagnose, metrics, tiles
from phonoweave.operators.bitmaps import Holds


def predictors(table, sym):
    return {sym} | {("+" if v == "2" else "-") + f for f, v in zip(table.features, table.vectors[sym], strict=True) if v in "02"}


def at(table, word, place):
    return predictors(table, word[place - 1] if place > 0 else word[place]) if len(word) >= abs(place) else set()


@pytest.mark.parametrize("block", [1 << 16, 70])
def test_contingencies_of_any_filter(spark, monkeypatch, block):
    monkeypatch.setattr(bitmaps, "BLOCK_WORDS", block)
    t, rng = letter_table(), random.Random(block)
    rows = [(" ".join(rng.choices("aeitnd", k=rng.randint(0, 5))), rng.random() < 0.4) for _ in range(400)] + [(None, True), ("a t", None)]
    index = bitmaps.build_index(spark.createDataFrame(rows, "form string, miss boolean").coalesce(1), t, 2)
    words = [(f.split(), m) for f, m in rows if f is not None and m is not None]
    for filters in ((), (Holds(1, "+syl"),), (Holds(-1, "-syl"), Holds(1, "t", True)), (Holds(2, "a"), Holds(-2, "a")), (Holds(1, "q"),), (Holds(1, "q", True),)):
        inside = [(w, m) for w, m in words if all((h.predictor in at(t, w, h.place)) != h.absent for h in filters)]
        want, n, bad = {}, len(inside), sum(m for _, m in inside)
        for place in (1, 2, -1, -2):
            for w, m in inside:
                for p in at(t, w, place):
                    want.setdefault((place, p), [0, 0])[not m] += 1
        want = {k: (a, b, bad - a, n - bad - b) for k, (a, b) in want.items()}
        got = {(r.place, r.predictor): (r.n11, r.n10, r.n01, r.n00) for r in bitmaps.contingency(index, filters).collect()}
        assert got == want
        row = bitmaps.subset(index, filters).first()
        assert (row.n, row.n_in, row.n_miss, row.n_in_miss) == (len(words), n, sum(m for _, m in words), bad)
    read = bitmaps.contingency(index, (Holds(1, "+syl"),)).inputFiles()
    assert all("predictors" in f or "chosen" in f for f in read)  # no table of words


def test_tiles_hold_all_words(spark):
    rng = random.Random(2)
    steps = sorted({(rng.randint(0, 90), rng.randint(0, 5)) for _ in range(200)})
    df = spark.createDataFrame([(f"w{k:03}", r, f"{k}-{r}") for k, r in steps], "etym_id string, rule_idx int, after string").repartition(5)
    number = {k: i for i, k in enumerate(sorted({k for k, _ in steps}))}
    got = {(r.tile, r.rule_idx, i): r[f"c{i}"] for r in tiles.rule_tiles(df, 7).collect() for i in range(7) if r[f"c{i}"] is not None}
    assert got == {(number[k] // 7, r, number[k] % 7): f"{k}-{r}" for k, r in steps}
    assert {(r.tile * 7 + r.place, r.etym_id) for r in tiles.tile_words(df, 7).collect()} == {(i, f"w{k:03}") for k, i in number.items()}


def test_a_key_reads_one_file(spark, tmp_path):
    """Of many files sorted by key, the statistics of all but one rule the key out: only its rows are scanned."""
    df = spark.range(4000).select(F.format_string("w%05d", F.col("id")).alias("word"), F.col("id").cast("int").alias("rule_idx"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tiles.write_by_key(df, f"{tmp_path}/x", "word")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(glob.glob(f"{tmp_path}/x/part-*")) == 4
    found = tiles.lookup(spark, f"{tmp_path}/x", "word", "w02345")
    assert [r.rule_idx for r in found.collect()] == [2345]
    plan = found._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().apply(0)
    assert "EqualTo(word,w02345)" in plan.toString() and scan.metrics().apply("numOutputRows").value() <= 1100


def test_scope_by_group(spark):
    rows = [("x", [(1, 2)], 5)] * 3 + [("x", [], 5)] * 2 + [("y", [(3, 4)], 9)] * 4 + [("z", None, 3)]
    df = spark.createDataFrame(rows, "g string, bounds array<struct<start:int,end:int>>, length int")
    got = {(r.g, r.side): r.radius for r in diagnose.scope(df, by=["g"]).collect()}
    assert got == {("x", "s"): 1, ("x", "e"): 3, ("y", "s"): 3, ("y", "e"): 4, ("z", "s"): 4, ("z", "e"): 4}
    assert diagnose.autopsy_scope(df.where("g = 'x'")) == (-1, 3) and diagnose.autopsy_scope(df.limit(0)) == (-1, 1)


def test_counts_by_vector(spark):
    """Two symbols of one vector are one phone there."""
    t = phonetic_table()
    t.vectors["qq"] = t.vectors["a"]
    df = spark.createDataFrame([("a qq t",), ("qq",), ("t # +",), (None,)], "form string")
    assert {r.fv: r.n_words for r in metrics.vector_docfreq(df, t).collect()} == {t.vectors["a"]: 2, t.vectors["t"]: 2}
