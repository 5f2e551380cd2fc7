"""URL filter with redirect equivalence, in DataFrame functions alone.

A rule (host, path) fits its host and all subdomains if the url's path starts with its own;
the longest fitting rule decides. Urls that redirect to each other, or name each other as
canonical, are one resource: connected components over those links carry block decisions
to aliases that no rule fits. An explicit allow comes first: it stands for its own url
whatever its aliases are, and a component that holds one isn't blocked for the rest.

Links come from the pages themselves (``<link rel=canonical>``, a meta refresh) and from a
table of redirects, if given. A relative address is resolved against its page's url. A url's
node is the url without its fragment, with scheme and host in lower case.

Null urls and urls without ``://`` have empty host and path, fit no rule, are nobody's alias
and are allowed. Rows that repeat a page are judged alike; very long pages are searched whole, for all
their links. Other columns of ``pages`` are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .components import connected_components

#: (verdict, host, path), a stated list that becomes part of the expression.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Longer lists of rules belong in a table to join with.
MOST_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["'][^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The url's name as a resource; null if it has no ``://``."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    scheme = F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), rest))


def deciding_rule(url: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (length, allow, rule) of the longest rule that fits, allow before block among equals; else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} become an expression")
    host, path = host_of(url), path_of(url)
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(verdict == "allow").alias("allow"), F.lit(h + p).alias("rule")),
        )
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, allow: boolean, rule: string>")


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, ``.`` and ``..`` resolved; ``..`` stops at the root."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(F.when(folder, F.concat(walked, F.array(F.lit("")))).otherwise(walked), "/"))


def resolved(url: Column, to: Column) -> Column:
    """What ``to`` names on the page ``url``; null for other schemes (``mailto:``)."""
    origin = F.concat(F.substring_index(url, "://", 1), F.lit("://"), host_of(url))
    path, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"^/(.*/)?", 1))
    return (
        F.when(F.startswith(to, F.lit("?")) | F.startswith(to, F.lit("#")), F.concat(origin, path_of(url), to))
        .when(F.instr(to, "://") > 0, to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.substring_index(url, "://", 1), F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(origin, _without_dots(path), rest))
        .when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): the nodes of pages and of what they name as canonical or refresh to."""
    named = F.explode(F.concat(F.regexp_extract_all("html", F.lit(_LINK), 1), F.regexp_extract_all("html", F.lit(_REFRESH), 1)))
    found = pages.where("url is not null and html is not null").select("url", named.alias("to")).where("`to` <> ''")
    to = F.replace(F.col("to"), F.lit("&amp;"), F.lit("&"))
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), to)).alias("b"))


def judge(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule and verdict of each page (page_id, url, html).

    redirects: (from_url, to_url), in addition to the links in the pages.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    members = connected_components(edges).withColumn("allow", deciding_rule(F.col("node"), rules)["allow"])
    decided = members.groupBy("root").agg(F.bool_or("allow").alias("any_allow"), F.bool_or(~F.col("allow")).alias("any_block"))
    blocked = members.join(decided.where("any_block and not any_allow"), "root").where("allow is null").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))
    judged = pages.select("page_id", "url", deciding_rule(F.col("url"), rules).alias("decided"), node_of(F.col("url")).alias("node"))
    judged = judged.join(blocked, judged.node == blocked["__node"], "left")
    allow = F.coalesce(F.col("decided.allow"), ~F.coalesce("__blocked", F.lit(False)))
    return judged.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("decided.rule").alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("url")


#: Links have no look-ahead in RE2, so both orders of the attributes are written out.
OP4_SQL = r"""
WITH RECURSIVE named AS (
  SELECT url, unnest([
    regexp_extract(html, '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*?\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*?\bcontent\s*=\s*["''][^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1)]) AS target
  FROM pages WHERE url LIKE '%://%'),
pairs AS (
  SELECT url AS x, CASE WHEN target LIKE '%://%' THEN replace(target, '&amp;', '&') WHEN target LIKE '//%' THEN split_part(url, '://', 1) || ':' || replace(target, '&amp;', '&')
    WHEN target LIKE '/%' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || replace(target, '&amp;', '&') END AS y
  FROM named WHERE target <> ''),
ends AS (SELECT x AS u FROM pairs UNION SELECT y FROM pairs WHERE y IS NOT NULL UNION SELECT url FROM pages),
part AS (SELECT u, strpos(u, '://') AS pos, substr(u, strpos(u, '://') + 3) AS rest FROM ends),
split AS (
  SELECT u, pos, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN pos > 0 THEN translate(substr(u, 1, pos - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://'
      || translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS node
  FROM part),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
ruled AS (
  SELECT u, host, path, node, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
edge AS (SELECT a.node AS a, b.node AS b FROM pairs JOIN ruled a ON a.u = x JOIN ruled b ON b.u = y),
linked AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
alias AS (SELECT r.a AS node, bool_or(x.verdict = 'block') AND NOT coalesce(bool_or(x.verdict = 'allow'), false) AS blocked FROM reach r JOIN ruled x ON x.node = r.b GROUP BY r.a)
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
  coalesce(r.verdict, CASE WHEN coalesce(a.blocked, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN ruled r ON r.u = p.url LEFT JOIN alias a ON a.node = r.node
"""
