"""Numbers of lines against reading the files one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from phonoweave.functions.inventory import phonetic_table
from phonoweave.plans.run import RunConfig, run
from phonoweave.sources import lines


@pytest.fixture
def small_splits(spark):
    """Files are cut into many splits, several of which a task reads."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def written(path, seed):
    rng = random.Random(seed)
    out = []
    for name in ("a.txt", "b.txt", "c.txt", "sub.txt", "z.txt"):
        own = ["".join(rng.choice("abé \t$\r") for _ in range(rng.choice([0, 0, 3, 40]))) for _ in range(rng.choice([1, 60, 300]))]
        (path / name).write_bytes(("\n".join(own) + rng.choice(["", "\n"])).encode())
        text = (path / name).read_bytes().decode().split("\n")
        out += text[:-1] if text[-1] == "" else text
    (path / "empty.txt").write_bytes(b"")
    return out


@pytest.mark.parametrize("sent", [100_000, 0])
def test_many_files_and_splits(spark, tmp_path, small_splits, monkeypatch, sent):
    monkeypatch.setattr(lines, "SPLITS_SENT", sent)
    want = written(tmp_path, sent)
    got = lines.numbered_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 3
    assert sorted((r.line_no, r.value) for r in got.collect()) == list(enumerate(want))
    some = lines.numbered_lines(spark, str(tmp_path), F.col("value").contains("b"))
    assert sorted((r.line_no, r.value) for r in some.where("line_no is not null").collect()) == list(enumerate(x for x in want if "b" in x))
    assert some.where("line_no is null").count() == sum("b" not in x for x in want)
    assert lines.first_line(spark, str(tmp_path), F.col("value").contains("b")) == next(x for x in want if "b" in x)
    assert lines.first_line(spark, str(tmp_path), F.col("value") == "nothing") is None


def test_no_lines(spark, tmp_path):
    (tmp_path / "x").write_text("")
    assert lines.numbered_lines(spark, str(tmp_path / "x")).collect() == []


def test_a_lexicon_of_many_files(spark, tmp_path, small_splits):
    """Blank lines, comments and the header are no words; numbers go on from file to file, and composed letters are decomposed."""
    t = phonetic_table()
    marks = {"2": "+", "0": "-", "1": "0"}
    (tmp_path / "symbols").write_text("\n".join(["SYMB," + ",".join(t.features), *(f"{s}," + ",".join(marks[v] for v in vec) for s, vec in t.vectors.items())]), encoding="utf-8")
    (tmp_path / "cascade").write_text("~Mid\nt > d\n", encoding="utf-8")
    folder = tmp_path / "lexicon"
    folder.mkdir()
    words = [f"{'t ' * (i % 5 + 1)}a" for i in range(300)]
    (folder / "part-0").write_text("$ a comment\n\n=Input, Mid, Output\n" + "\n".join(f"{w}, {w}, {w.replace('t', 'd')} $ x" for w in words[:100]) + "\n", encoding="utf-8")
    (folder / "part-1").write_text("\n  $ none\n" + "\n\n".join(f"{w} , {w} , a" for w in words[100:]), encoding="utf-8")
    r = run(spark, RunConfig(str(tmp_path / "symbols"), str(tmp_path / "cascade"), str(folder), None))
    got = sorted((x.etym_id, x.cells[0], x.outcome) for x in r.lexicon.collect())
    assert got == [(i, w, w.replace("t", "d")) for i, w in enumerate(words)] and r.layout.header
    assert r.pairs(fed=False).where("ld = 0").count() == 100
