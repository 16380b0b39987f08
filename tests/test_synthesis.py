"""Names of vectors by joins against naming one vector after the other."""

import random

from phonoweave.functions.features import DIGIT_OF, force, parse_spec
from phonoweave.functions.inventory import letter_table, phonetic_table
from phonoweave.functions.synthesis import name_vectors


def test_names_agree_with_one_by_one(spark):
    t, rng = phonetic_table(), random.Random(3)
    vectors = [*list(t.vectors.values())[:10]]
    for _ in range(400):
        vec = rng.choice([*t.vectors.values()])
        specs = [s for m in rng.sample([*t.diacritics], rng.randint(1, 5)) for s in t.diacritics[m]]
        vec = force(vec, [(t.features.index(parse_spec(s)[1]), DIGIT_OF[parse_spec(s)[0]]) for s in specs])
        vectors.append(force(vec, [(rng.randrange(len(t.features)), "2")]) if rng.random() < 0.2 else vec)
    df = spark.createDataFrame([(v,) for v in [*vectors, *vectors, None]], "fv string").repartition(4)
    got = {r.fv: r.symbol for r in name_vectors(df, t).collect()}
    want = {v: phonetic_table().symbol(v) for v in vectors}  # a new table for each, so that none remembers
    assert got == want and "?" in set(want.values()) and any(len(x) > 3 for x in want.values())


def test_a_table_without_marks(spark):
    t = letter_table()
    none = "1" * len(t.features)
    df = spark.createDataFrame([(t.vectors["a"],), (none,)], "fv string")
    assert {r.fv: r.symbol for r in name_vectors(df, t).collect()} == {t.vectors["a"]: t.symbols[t.vectors["a"]], none: "?"}
    assert name_vectors(df.limit(0), t).collect() == []
