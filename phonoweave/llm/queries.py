"""The queries of this subpackage, at production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, toxicity
from .bit_sliced import top_k
from .collocations import collocations
from .common import table
from .divergence import divergence
from .language_id import fit, identify
from .line_dedup import dedup_lines
from .media import media_features
from .ngram_join import near_duplicates
from .packing import pack_documents
from .token_counts import count_tokens
from .url_filters import judge_urls
from .warc import archive_pages

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


#: The wanted shares of tokens.
TARGETS = {"good": 0.7, "plain": 0.28, "toxic": 0.02}
#: The wanted number of tokens, as a share of those there are.
TOKEN_BUDGET = 1.0
#: The least share of letters in words of a learned language, in a document whose language counts as known.
MIN_KNOWN = 0.5


def domain() -> Column:
    """The domain of a labelled row."""
    return F.expr("case when toxic = 1 then 'toxic' when quality = 1 then 'good' when quality = 0 then 'plain' end")


def tokenizer() -> str:
    """The path of the file whose tokens all operators count."""
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.fit(docs, table(spark, sf_dir, "labels"), domain())
    rates, _ = mixing.mix(docs, model, TARGETS, TOKEN_BUDGET, tokenizer())
    return rates.select("doc_id", "n_tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)), "rate")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer(), over=1024).drop("text")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=80)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer(), buckets=12, budget=16_384)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, keep="none", min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), min_bytes=100)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"), min_docs=3, top=200)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.col("toxic"), ~held_out)
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"), min_count=100, max_words=5, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_media_columns": op3_media_columns,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filters": op7_url_filters,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

#: Edges are the absolute addresses in quotes that canonical links and refreshes of a page name; the query reads more forms.
_OP7 = r"""
WITH RECURSIVE
r(action, rhost, rpath) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
t AS (
  SELECT url AS a, unnest(regexp_extract_all(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical["'']?[\s/>][^>]*>?|<link\s[^>]*rel\s*=\s*["'']?canonical["'']?>')) AS tag, '(?is)href\s*=\s*["'']([^"''#]*)' AS p FROM pages WHERE url IS NOT NULL
  UNION ALL SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["'']?\s[^>]*>')), '(?is)url\s*=\s*([^"''#>\s]*)' FROM pages WHERE url IS NOT NULL),
x AS (SELECT a, regexp_extract(tag, p, 1) AS b FROM t),
y AS (SELECT unnest([a, b]) AS u FROM x WHERE contains(b, '://')),
n AS (
  SELECT u, lower(regexp_extract(u, '^[^:/?#]*://[^/?#]*')) || regexp_extract(substr(u, length(regexp_extract(u, '^[^:/?#]*://[^/?#]*')) + 1), '^[^#]*') AS node FROM (SELECT DISTINCT u FROM y UNION SELECT DISTINCT url FROM pages WHERE url IS NOT NULL)),
e AS (SELECT DISTINCT p.node AS a, q.node AS b FROM x JOIN n p ON p.u = x.a JOIN n q ON q.u = x.b WHERE p.node <> q.node),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c(node, root) AS (SELECT DISTINCT a, a FROM d UNION SELECT d.b, c.root FROM c JOIN d ON d.a = c.node),
k AS (SELECT node, min(root) AS component FROM c GROUP BY node),
u AS (SELECT node AS url FROM k UNION SELECT url FROM pages),
h AS (
  SELECT url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM u),
m AS (
  SELECT url, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url),
g AS (SELECT component, bool_or(m.action = 'allow') AS allowed, bool_or(m.action = 'block') AS blocked FROM k LEFT JOIN m ON m.url = k.node GROUP BY component)
SELECT p.page_id, h.host, h.path, m.rule, coalesce(m.action, CASE WHEN g.blocked AND NOT coalesce(g.allowed, false) THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN h ON h.url IS NOT DISTINCT FROM p.url LEFT JOIN m ON m.url = p.url LEFT JOIN n ON n.u = p.url LEFT JOIN k ON k.node = n.node LEFT JOIN g ON g.component = k.component
"""

_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT place, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT place) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.place, k.doc_id
"""

_OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to FROM q
"""

_OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP6 = r"""
WITH RECURSIVE
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

_OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS p FROM x JOIN v USING (lang)),
q0 AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
q AS (SELECT q0.lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v) AS q FROM q0 JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""

_OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
m AS (SELECT lang, ws, unnest(range(1, 6)) AS m FROM w),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM m WHERE len(ws) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((1000::HUGEINT * c.a::HUGEINT * n.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM k c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT lang, m, phrase, a, arg_min(struct_pack(k := k, l := l, r := r), score * 10 + k) AS best, min(score) AS score FROM s GROUP BY ALL),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.m > b.m AND c.a = b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase))
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(best.l AS BIGINT) AS l, CAST(best.r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, score, CAST(m AS INTEGER) AS n_words, CAST(best.k AS INTEGER) AS cut
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

SQL: dict[str, str] = {
    "op11_divergence": _OP11,
    "op13_collocations": _OP13,
    "op6_ngram_join": _OP6,
    "op4_exact_top_k": _OP4,
    "op7_url_filters": _OP7, "op9_line_dedup": _OP9, "op10_warc": _OP10,
}
