"""URL filters with redirect equivalence: block decisions reach aliases through redirects and canonical links.

Each URL is judged by the longest rule that fits it. URLs joined by redirect or canonical-link edges are aliases of each
other; connected components over those edges carry a block to aliases that no rule names. An explicit rule on a URL,
allow or block, always goes before what its aliases say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, mapped, written
from .components import connected_components

#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What edges connect: host, path and query; scheme and fragment don't tell URLs apart. Null without ://."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), path(url), query))


class _Links(HTMLParser):
    """What a page says it is an alias of: canonical links and refresh redirects, and the base they are seen from."""

    def __init__(self):
        super().__init__()
        self.base, self.targets = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}  # of repeated attributes the first counts
        if tag == "base" and self.base is None and "href" in a:
            self.base = a["href"].strip()
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.targets.append(a.get("href", "").strip())
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            self.targets.append(refresh_target(a.get("content", "")))

    handle_startendtag = handle_starttag


def refresh_target(content: str) -> str:
    """The URL of a refresh's content: '5; url=x', '0;"x"'; empty without one."""
    found = re.match(r"\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?(?:'([^']*)|\"([^\"]*)|(.*))", content, re.I | re.S)
    return next((x for x in found.groups() if x), "").strip() if found else ""


def targets(url: str, html: str) -> list[str]:
    """Absolute http and https URLs that the page is an alias of, resolved as RFC 3986 says."""
    links = _Links()
    links.feed(html)
    links.close()
    out = []
    for t in filter(None, links.targets):
        try:
            whole = urljoin(urljoin(url, links.base or ""), t)
        except ValueError:  # no URL
            continue
        if whole.lower().startswith(("http://", "https://")):
            out.append(whole)
    return out


def page_edges(pages: DataFrame) -> DataFrame:
    """(url, target) from each page's canonical links and refresh redirects. Pages without either never reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(u, t) for u, h in zip(b.column(0).to_pylist(), b.column(1), strict=True) for t in targets(u, h.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["url", "target"])

    some = F.col("html").rlike(r"(?i)canonical|http-equiv") & F.contains("url", F.lit("://"))
    return mapped(pages.where(some).select("url", "html"), run, "url string, target string")


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """urls (key, host, path; distinct keys) that a rule fits: key, rule, verdict of the longest (ties: block first).

    Each host is dealt out as its own suffixes, and those are joined with the rules' hosts by equality, so the number of
    rules doesn't multiply the work.
    """
    spark = urls.sparkSession
    table = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = urls.select("key", "path", F.explode(suffixes).alias("rule_host")).join(table, "rule_host").where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), rule.alias("rule"), "verdict")).alias("best")
    return fits.groupBy("key").agg(best).select("key", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and alias: whether the verdict came from an alias.

    pages: page_id, url, html. redirects: further edges (url, target). Without a rule and a blocked alias a URL is
    allowed, null and malformed ones too. Repeated rows come back as often as they came; other columns are not looked
    at; an empty table gives no rows.
    """
    edges = page_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select("url", "target"))
    edges = edges.select(node(F.col("url")).alias("u"), node(F.col("target")).alias("v"), "url", "target")
    edges = written(edges.where("u is not null and v is not null and u <> v"), "redirects")
    pages = pages.select("page_id", "url", node(F.col("url")).alias("key"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    keyed = pages.where("key is not null").select("key", "host", "path")
    ends = [edges.select(F.col(k).alias("key"), host(F.col(c)).alias("host"), path(F.col(c)).alias("path")) for k, c in (("u", "url"), ("v", "target"))]
    direct = written(ruled(keyed.union(ends[0]).union(ends[1]).distinct(), rules), "ruled")
    found = connected_components(edges)
    members = found.join(direct, found["node"] == direct["key"]).where("verdict = 'block'").select("component").distinct()
    aliases = written(found.join(members, "component").select(F.col("node").alias("key"), F.lit(True).alias("blocked")), "aliases")
    out = pages.join(direct, "key", "left").join(aliases, "key", "left")
    blocked = F.col("rule").isNull() & F.coalesce("blocked", F.lit(False))
    verdict = F.when(blocked, "block").otherwise(F.coalesce("verdict", F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), blocked.alias("alias"))
