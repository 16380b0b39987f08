"""Rows of any columns through the stages' helpers."""

from pyspark.sql import functions as F

from phonoweave.llm import rows

TEXT = " ".join(f"w{i}" for i in range(40))


def table(spark):
    """Copies, a near copy, differing texts of one id, no id, no text; columns of the names that the helper itself uses."""
    own = [(1, TEXT, 5, "a"), (2, TEXT + " end", 6, "b"), (2, "another text of the same id", 7, "c"), (2, "another text of the same id", 8, "d"), (None, TEXT, 9, "e"), (4, None, 1, "f"), (5, "", 2, "g"), (None, "no id here", 3, "h")]
    df = spark.createDataFrame(own, "doc_id long, text string, `r` int, `w` string")
    return df.withColumns({"row": F.col("r") + 1, "_row": F.lit(99), "n": F.lit("n"), "component_id": F.lit(7.5), "a.b": F.lit("dot"), "kind": F.create_map(F.lit("x"), F.col("w"))})


def test_one_of_each_keeps_whole_rows(spark):
    df = table(spark)
    got = rows.one_of_each(df)
    assert got.columns == df.columns
    found = sorted((str(r.doc_id), r.text, r.row - r.r, r["a.b"], r._row, r.n, r.component_id, r.kind["x"] == r.w) for r in got.collect())
    rest = (1, "dot", 99, "n", 7.5, True)
    assert found == sorted((str(i), t, *rest) for i, t in [(1, TEXT), (2, "another text of the same id"), (4, None), (5, ""), (None, "no id here")])
    assert rows.one_of_each(df.limit(0)).count() == 0
    again = {tuple(map(str, r)) for r in rows.one_of_each(df.repartition(5)).collect()}
    assert again == {tuple(map(str, r)) for r in got.collect()}  # the same of the rows equal in id and text


def test_rows_of_one_name_are_named_anew(spark, monkeypatch):
    real = rows._hash
    monkeypatch.setattr(rows, "_hash", lambda seed, *columns: F.lit(17).cast("long") if seed == 0 else real(seed, *columns))
    assert rows.one_of_each(table(spark)).count() == 5


def test_held_and_given_back(spark):
    df = table(spark)
    back = rows.given_back(rows.held(df, "text").withColumns({"score": F.lit(1)}), df, text=F.upper("text"))
    assert back.columns == df.columns and sorted(r.text or "" for r in back.collect()) == sorted((r.text or "").upper() for r in df.collect())
    only = df.select("text")
    assert rows.given_back(rows.held(only, "text"), only, text=F.col("text")).columns == ["text"]
