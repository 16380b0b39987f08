"""The registered queries over the smallest tables: against DuckDB where they have SQL, else against brute force."""

import glob
import hashlib
import os
import zlib

import pytest

from phonoweave.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(r[i] for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([d[0] for d in found.description], found.fetchall())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def library(texts):
    from tokenizers import Tokenizer

    return dict(zip(texts, (len(e.ids) for e in Tokenizer.from_file(queries.tokenizer()).encode_batch(list(texts.values()), add_special_tokens=False)), strict=True))


def test_token_counts_mixing_and_packing(spark, texts):
    want = library(texts)
    counts = {r.doc_id: r for r in queries.op5_token_counts(spark, DATA).collect()}
    assert {i: r.n_tokens for i, r in counts.items()} == want and all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len(texts[i].encode()) for i, r in counts.items())
    assert {r.doc_id: r.n_tokens for r in queries.op8_packing(spark, DATA).collect()} == want
    mixed = queries.op1_mixing(spark, DATA).collect()
    assert {r.doc_id: r.n_tokens for r in mixed} == want and all(r.rate >= 0 for r in mixed)
    total = sum(want.values())
    for domain, share in queries.TARGETS.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{domain}"] for r in mixed) / total - share) < 1e-4


def test_language(spark, texts):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op2_language_id(spark, DATA).collect()}
    assert set(found) == set(truth) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in found.items())
    held = [i for i, r in found.items() if r.held_out and truth[i]]
    assert sum(found[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_media(spark, texts):
    found = {r.doc_id: r for r in queries.op3_media_columns(spark, DATA).collect()}
    assert set(found) == set(texts)
    for i, r in found.items():
        raw = texts[i].encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_redirects_against_sql(spark, tmp_path):
    """Pages with links and refreshes: the query and its recursive SQL agree, and blocks and allows are inherited."""
    import random

    import duckdb

    rng = random.Random(18)
    hosts = ["a.net", "b.org", "c.org", "d.org", "e.io", "Ok.com", "example.com", "www.example.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/es/1", "/fr/2", "/en/3", "/4", "/5?q=1", "")]
    rows = []
    for i, u in enumerate([*urls, None, "no address", urls[3], "HTTP://A.net/es/1#x"]):
        tags = "".join(rng.choice([f'<link rel="canonical" href="{v}">', f"<LINK href='{v}' rel=canonical />", f'<meta http-equiv="refresh" content="3; url={v}">']) for v in rng.sample(urls, rng.choice([0, 0, 1])))
        rows.append((i, u, rng.choice([f"<html>{tags}<p>text</p>", tags, None])))
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op7_url_filters(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(queries.SQL["op7_url_filters"])
    mine = got.collect()
    assert rows_of(got.columns, mine) == rows_of([d[0] for d in found.description], found.fetchall())
    assert sum(r.verdict == "block" and r.rule is None for r in mine) >= 3 and any(r.verdict == "block" and r.rule for r in mine)


def rows_of(columns, values):
    return rows(columns, [tuple(r) for r in values])
