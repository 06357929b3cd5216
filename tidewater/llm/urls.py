"""URL filters: prefix rules, and block decisions that spread to redirect and canonical aliases."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components
from .html_text import BODY, CLOSE

#: (verdict, host, path) of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_LITERAL_RULES = 2000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// and for null."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What names a page among its aliases: host, path and query; scheme and fragment don't tell pages apart. Null for a
    url without a host, which is no page's alias."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.array_size(labels)), lambda i: F.array_join(F.slice(labels, i, F.array_size(labels)), "."))


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds rule_ (verdict, rule) to rows with host and path columns: the longest rule that fits, of equals the first in
    order of text, allow before block. A list of up to MAX_LITERAL_RULES is looked up in a constant; more rules, or a
    table of them (verdict, host, path), are joined by host suffix."""
    best = lambda fits: F.element_at(F.array_sort(fits), 1)
    if not isinstance(rules, DataFrame) and len(rules) > MAX_LITERAL_RULES:
        rules = rows.sparkSession.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    if isinstance(rules, DataFrame):
        hosts = rows.select("host").distinct().withColumn("suffix", F.explode(_suffixes(F.col("host"))))
        rule = F.struct((-F.length(F.concat("r.host", "r.path"))).alias("order"), F.concat("r.host", "r.path").alias("rule"), F.col("r.verdict").alias("verdict"), F.col("r.path").alias("path"))
        fits = hosts.join(rules.alias("r"), F.col("suffix") == F.col("r.host")).groupBy(hosts["host"]).agg(F.collect_set(rule).alias("rules_"))
        rows = rows.join(fits, "host", "left")
        own = F.coalesce("rules_", F.array().cast("array<struct<order:int,rule:string,verdict:string,path:string>>"))
    else:
        by_host: dict[str, list[Column]] = {}
        for verdict, host, path in sorted(set(map(tuple, rules))):
            by_host.setdefault(host, []).append(F.struct(F.lit(-len(host + path)).alias("order"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(path).alias("path")))
        if not by_host:
            return rows.withColumn("rule_", F.lit(None).cast("struct<order:int,rule:string,verdict:string,path:string>"))
        table = F.create_map(*[x for host, own in by_host.items() for x in (F.lit(host), F.array(*own))])
        own = F.flatten(F.filter(F.transform(_suffixes(F.col("host")), lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(own, lambda r: F.startswith(F.col("path"), r["path"]))
    return rows.withColumn("rule_", F.when(F.size(fits) > 0, best(fits))).drop("rules_")


_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style|textarea|title|noscript|template)(?![^\s/>]){BODY}|<(link|meta|base)(?![^\s/>]){BODY}", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_REFRESH = re.compile(r"\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(\"[^\"]*|'[^']*|.*)", re.DOTALL | re.IGNORECASE)
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def page_targets(url: str, page: str) -> list[str]:
    """Absolute targets of a page's canonical links and refresh redirects.

    Comments and the content of scripts and the like are no links; rel is a list of words; references are decoded; the
    first base element counts. Relative targets are resolved as RFC 3986 says, whatever the page's scheme; those that
    can't be, and those of schemes without a host, are none.
    """
    found, base, at = [], None, 0
    while m := _TAG.search(page, at):
        at = m.end()
        if m[1]:
            close = CLOSE[m[1].lower()].search(page, at)
            at = close.end() if close else len(page)
        elif m[3]:
            own: dict[str, str] = {}
            for x in _ATTRIBUTE.finditer(m[4]):
                own.setdefault(x[1].lower(), entities.unescape(x[2] or x[3] or x[4] or ""))
            tag, target = m[3].lower(), ""
            if tag == "base":
                base = base if base is not None else own.get("href")
            elif tag == "link" and "canonical" in own.get("rel", "").lower().split():
                target = own.get("href", "")
            elif tag == "meta" and own.get("http-equiv", "").strip().lower() == "refresh" and (to := _REFRESH.match(own.get("content", ""))):
                target = to[1].lstrip("\"'")
            if target.strip():
                found.append(re.sub(r"[\t\r\n]", "", target).strip())
    out = []
    for target in found:
        try:
            full = urljoin("http://" + url.partition("://")[2], base or "")
            out.append(urljoin(full, target))
        except ValueError:  # a target with an ill-formed host
            continue
    return [x for x in out if _ABSOLUTE.match(x)]


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) node edges from the pages' canonical links and refresh redirects. Only pages that speak of either reach
    Python; pages whose url has no host have no edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, t) for u, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in page_targets(u, page)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["u", "t"])

    html, url = F.col(html_col).cast("string"), F.col(url_col).cast("string")
    low = F.lower(html)
    rows = pages.where(node_of(url).isNotNull() & (F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))))
    found = rows.select(url.alias("u"), html.alias("h")).mapInArrow(run, "u string, t string")
    return found.select(node_of(F.col("u")).alias("src"), node_of(F.col("t")).alias("dst")).where("src <> dst")


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page.

    A page with a rule of its own has that rule's verdict. Others share one with their aliases, which canonical links,
    refresh redirects and given edges (src_url, dst_url) connect, directly or not, whether or not the aliases are pages
    themselves: allow if a rule allows any, else block if a rule blocks any; and allow without aliases or rules.

    Null and malformed urls have an empty host and path, no rule, no aliases and the verdict allow. Repeated rows are
    judged each; null ids keep their row. An empty table gives no rows; other columns are ignored. Very long pages and
    urls are read whole.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    links = page_edges(pages, url_col, html_col) if html_col else None
    if edges is not None:
        given = edges.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
        links = given if links is None else links.unionByName(given)
    judged = with_rule(rows, rules)
    if links is None:
        alias = F.lit(None).cast("string")
    else:
        member = connected_components(links)
        urls = member.withColumn("u", F.concat(F.lit("x://"), "node"))
        urls = with_rule(urls.select("node", "component", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path")), rules)
        decided = urls.groupBy("component").agg(F.min("rule_.verdict").alias("alias"))  # allow comes before block
        judged = judged.join(member.join(decided.where("alias is not null"), "component").select("node", "alias"), "node", "left")
        alias = F.col("alias")
    return judged.select("page_id", "host", "path", F.col("rule_.rule").alias("rule"), F.coalesce("rule_.verdict", alias, F.lit("allow")).alias("verdict"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), list(RULES))


_HOST = r"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = r"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_NODE = f"CASE WHEN {_HOST} <> '' THEN {_HOST} || {_PATH} || coalesce(regexp_extract({{u}}, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '') END"
# links are read as far as SQL can: outside comments, with &amp; decoded; no base elements, no dot segments
OP5_SQL = rf"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {', '.join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
bare AS (SELECT url, regexp_replace(html, '(?is)<!--.*?-->|<(script|style|noscript|template|textarea|title)\b.*?</(script|style|noscript|template|textarea|title)\s*>', '', 'g') AS html FROM pages WHERE {_HOST.format(u='url')} <> ''),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM bare),
found AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?is)^<link.*\srel\s*=\s*(?:"(?:[^"]*\s)?canonical[\s"]|''(?:[^'']*\s)?canonical[\s'']|canonical[\s>])') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)[;,\s]\s*url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END, '&amp;', '&') AS t FROM tags),
full_target AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN 'x:' || t
    WHEN starts_with(t, '/') THEN 'x://' || {_HOST.format(u='url')} || t WHEN starts_with(t, '?') THEN 'x://' || {_HOST.format(u='url')} || {_PATH.format(u='url')} || t
    ELSE 'x://' || {_HOST.format(u='url')} || regexp_replace({_PATH.format(u='url')}, '[^/]*$', '') || t END AS t
  FROM found WHERE t <> ''),
edge AS (SELECT DISTINCT {_NODE.format(u='url')} AS a, {_NODE.format(u='t')} AS b FROM full_target),
both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
ends AS (SELECT a, b, {_HOST.format(u="('x://' || b)")} AS host, {_PATH.format(u="('x://' || b)")} AS path FROM reach),
node_rule AS (
  SELECT b, arg_min(verdict, (-length(rhost || rpath), rhost || rpath, verdict)) AS verdict
  FROM (SELECT DISTINCT b, host, path FROM ends) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY b),
alias AS (SELECT a, min(verdict) AS verdict FROM ends JOIN node_rule USING (b) GROUP BY a),
page AS (SELECT row_number() OVER () AS n, page_id, {_HOST.format(u='url')} AS host, {_PATH.format(u='url')} AS path, {_NODE.format(u='url')} AS node FROM pages),
own AS (
  SELECT n, arg_min(rhost || rpath, (-length(rhost || rpath), rhost || rpath, verdict)) AS rule, arg_min(verdict, (-length(rhost || rpath), rhost || rpath, verdict)) AS verdict
  FROM page JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page.page_id, page.host, page.path, own.rule, coalesce(own.verdict, alias.verdict, 'allow') AS verdict
FROM page LEFT JOIN own USING (n) LEFT JOIN alias ON alias.a = page.node
"""
