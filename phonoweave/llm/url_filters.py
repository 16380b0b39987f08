"""Redirect equivalence: block decisions pass to the aliases of a blocked address. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, ascii_lower
from .components import connected_components

Rule = tuple[str, str, str]  # action, host, path

_CANONICAL = r"""(?is)<link\b[^>]*?(?<![\w-])rel\s*=\s*(?:canonical|"(?:[^">]*\s)?canonical|'(?:[^'>]*\s)?canonical)(?=["'\s/>])[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*?(?<![\w-])http-equiv\s*=\s*["']?\s*refresh(?=["'\s/>])[^>]*>"""
_BASE = r"""(?is)<base\b[^>]*?(?<![\w-])href\s*=[^>]*>"""
_ORIGIN = r"(?s)^[^:/?#]*://[^/?#]*"
_ENTITY = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});"
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, action) of the longest fitting rule, else null. A chain of conditions, longest rule first."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        at_host = (host == rule_host) | host.endswith(f".{rule_host}")
        found = F.when(at_host & path.startswith(rule_path), F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def rules_by_join(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) of the distinct (host, path) of `addresses` that a rule fits; `rules` has action, host, path.

    For rule lists of any length: an address meets the rules of its host and of the domains above it by a join on the host.
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = addresses.select("host", "path").distinct().select("host", "path", F.explode(above).alias("domain"))
    own = rules.select(F.col("action"), F.col("host").alias("domain"), F.col("path").alias("start"))
    met = each.join(own, "domain").where(F.col("path").startswith(F.col("start")))
    rule = F.concat("domain", "start")
    return met.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("action").alias("action")), F.struct(F.length(rule), rule)).alias("found"))


def with_rules(addresses: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """`addresses` (host, path, ...) with found: struct(rule, action) of the longest fitting rule, else null."""
    if not isinstance(rules, DataFrame):
        return addresses.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    return addresses.join(rules_by_join(addresses, rules), ["host", "path"], "left")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it; keeps nested plans small."""
    return F.transform(F.array(value), body)[0]


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in quotes or without; empty if there is none. Character references are decoded."""
    pattern = rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
    return _decoded(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))


def _decoded(text: Column) -> Column:
    """Numeric references and those of _NAMED, once, from left to right."""

    def one(t: Column) -> Column:
        code = F.when(t.rlike("^&#[xX]"), F.conv(F.regexp_extract(t, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(t, "([0-9]+);", 1)).cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        out = F.when(t.rlike("^&#.*;$") & valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        for name, char in _NAMED.items():
            out = out.when(t == name, char)
        return out.otherwise(t)

    parts = lambda x: F.regexp_extract_all(x, F.lit(rf"(?s){_ENTITY}|.[^&]*"), F.lit(0))
    return _let(text, lambda x: F.when(x.contains("&"), F.array_join(F.transform(parts(x), one), "")).otherwise(x))


def _refresh_target(tag: Column) -> Column:
    """What follows the seconds or url= in a refresh; empty if it only reloads its page."""
    content = F.trim(_attribute(tag, "content"))
    after = F.regexp_extract(content, r"""(?is)^(?:[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?|url\s*=\s*)(.*)$""", 1)
    loose = _decoded(F.regexp_extract(tag, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1))  # quotes within like quotes
    quoted = lambda rest: F.regexp_extract(rest, r"""(?s)^(["'])(.*?)(?:\1|$)""", 2)
    return _let(after, lambda rest: F.when(rest.rlike("^[\"']"), quoted(rest)).when(rest != "", rest).otherwise(loose))


def _without_dots(path: Column) -> Column:
    """A path that starts with /, its segments . and .. applied."""
    split = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    start = F.array().cast("array<string>")
    ended = lambda p: F.when(F.element_at(p, -1).isin(".", ".."), F.concat(p, F.array(F.lit("")))).otherwise(p)
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(_let(split, ended), start, step), "/"))


def resolved(base: Column, to: Column) -> Column:
    """The address that `to` is on a page of address `base`, without fragment. Empty if it has a scheme but no host."""
    to = F.regexp_replace(F.trim(F.regexp_replace(to, r"[\t\n\r]", "")), r"(?s)#.*$", "")
    part = lambda x, i: F.regexp_extract(x, r"(?s)^([^:/?#]*://[^/?#]*)([^?#]*)([^#]*)", i)
    origin, path = part(base, 1), part(base, 2)

    def whole(to: Column) -> Column:
        return (
            F.when(to == "", F.substring_index(base, "#", 1))
            .when(to.rlike(_ORIGIN), to)
            .when(to.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (origin == ""), "")
            .when(to.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), to))
            .when(to.startswith("/"), F.concat(origin, to))
            .when(to.startswith("?"), F.concat(origin, path, to))
            .otherwise(F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^.*/", 0)), to))
        )

    dotted = lambda x: F.concat(part(x, 1), _without_dots(part(x, 2)), part(x, 3))
    return _let(_let(to, whole), lambda x: F.when(part(x, 2).rlike(r"/\.\.?(/|$)"), dotted(x)).otherwise(x))


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): an address and one that its page names as canonical or refreshes to, fragments removed, all tags read.

    Targets are resolved against the page's address, or the href of its base tag: absolute, //host, /path, ?query, relative.
    """
    url, html = F.col("url"), F.col("html")
    hint = html.rlike("(?i)canonical|http-equiv")
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    targets = F.concat(F.transform(tags(_CANONICAL), lambda t: _attribute(t, "href")), F.transform(tags(_REFRESH), _refresh_target))
    base = resolved(url, _attribute(F.regexp_extract(html, _BASE, 0), "href"))
    ends = _let(base, lambda at: F.transform(F.filter(targets, lambda t: t != ""), lambda t: _plain(resolved(at, t))))
    return pages.where(url.isNotNull() & hint).select(_plain(url).alias("a"), F.explode(ends).alias("b")).where(F.col("b").contains("://") & (F.col("a") != F.col("b")))


def _plain(url: Column) -> Column:
    """The name of an address in the graph: no fragment, A-Z of scheme and host lower-cased."""
    origin = F.regexp_extract(url, _ORIGIN, 0)
    return F.concat(ascii_lower(origin), F.substring_index(F.substring(url, F.length(origin) + 1, F.lit(1 << 30)), "#", 1))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Every row of `pages` (page_id, url, html, ...) with host, path, rule and verdict.

    A page's own rule decides first. Without one, the page follows its component over redirect edges (`redirects`: a, b;
    and those found in the pages): allow if a member is explicitly allowed, else block if a member is blocked, else
    allow. Null or malformed addresses have empty host and path, no rule, and are allowed. Repeated rows get equal
    results; an empty table gives an empty result; other columns are not looked at. A short list of rules is compiled into
    the plan, one condition each; a DataFrame of rules (action, host, path) of any length is joined by host.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = with_rules(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    own = judged.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.action").alias("action"))
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(_plain(F.col("a")).alias("a"), _plain(F.col("b")).alias("b")))
    stored = Stored(edges.distinct(), "url-edges")
    if stored.df.isEmpty():
        stored.drop()
        return own.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    members, _ = connected_components(stored.df, "a", "b")
    members = with_rules(members.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))}), rules)
    weight = F.when(F.col("found.action") == "allow", 2).when(F.col("found.action") == "block", 1).otherwise(0)
    decided = members.groupBy("component").agg(F.max(weight).alias("w"))
    aliases = members.join(decided, "component").where("w = 1").select(F.col("node").alias("alias"))
    out = own.join(aliases, (F.col("action").isNull()) & (_plain(F.col("url")) == F.col("alias")), "left")
    verdict = F.coalesce("action", F.when(F.col("alias").isNotNull(), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
