r"""Operator 13, URL rules that follow redirects and canonical links.

A rule is an action, a host and a path: it fits the host and its subdomains where the url's path starts with the rule's. Of
several the longest wins (host and path together), of equally long ones that which allows. What no rule fits is judged by its aliases:

1. urls that ask for one resource are one node: the scheme, ``#`` and what follows it, a last ``/`` of the path, and parameters
   that only track (``TRACKING``) don't count. A node of another host is never the same, ``www.`` and ``m.`` included;
2. edges lead from a page to the target of its ``<link rel=canonical>`` and of its ``<meta http-equiv=refresh>``, and from source to target
   of the redirects that are given; relative targets are taken from the page's url. Targets needn't be pages;
3. connected components of edges (rounds of large and small stars, hubs spread over tasks) bring together all aliases;
4. a page's own rule comes first. A page without one is allowed where a rule allows another url of its node; else a block
   anywhere in its component blocks it, so a link to an allowed page is no way out; else it is allowed.

A null url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and is allowed. Null and empty pages have no
links, links without a target count as none. Repeated pages are judged alike, empty tables give no rows; other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statvine.llm.common import stash
from statvine.operators.communities import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
TRACKING = r"(?s)^((utm_[^=]*|ref|fbclid|gclid)(=.*)?)?$"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules that the query applies. Fixed values.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def node(url: Column) -> Column:
    """What the url asks for; null where it has no host."""
    query = F.array_join(F.filter(F.split(F.regexp_replace(F.regexp_extract(url, AUTHORITY, 3), r"^\?", ""), "&"), lambda x: ~x.rlike(TRACKING)), "&")
    asked = F.concat(host(url), F.regexp_replace(path(url), "/$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(host(url) != "", asked)


def absolute(target: Column, url: Column) -> Column:
    """``target`` as a link on the page at ``url``; null for other schemes and for nothing."""
    target = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.lit("/"), F.regexp_replace(F.regexp_replace(path(url), "^/", ""), "[^/]*$", ""))
    return (
        F.when((target == "") | target.isNull() | (host(url) == ""), None)
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.substring_index(scheme, "//", 1), target))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), None)
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path(url), target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(folder, target))
    )


def fitting(host_: Column, path_: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and action of the rule that wins; nulls where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.action == "allow")):
        fits = ((host_ == rule.host) | host_.endswith("." + rule.host)) & path_.startswith(rule.path)
        name, action = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.action).otherwise(action)
    return name, action


def links(pages: DataFrame) -> DataFrame:
    """source, target (urls) of what pages declare, each page at most once by kind."""
    declared = F.array(*(F.regexp_extract("html", p, 1) for p in (CANONICAL, REFRESH)))
    found = pages.where("url is not null and html is not null").select(F.col("url").alias("source"), F.explode(declared).alias("target")).where("target <> ''")
    return found.select("source", absolute(F.col("target"), F.col("source")).alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, inherited (an alias decided) of each page (page_id, url, html).

    redirects: source, target, as urls.
    """
    tied = links(pages)
    if redirects is not None:
        tied = tied.unionByName(redirects.select("source", absolute(F.col("target"), F.col("source")).alias("target")))
    tied = stash(tied.where("source is not null and target is not null"), "url-links")
    digest = lambda url: F.unhex(F.md5(node(F.col(url)).cast("binary")))
    edges = tied.select(digest("source").alias("source"), digest("target").alias("target")).where("source <> target").distinct()
    parts = stash(connected_components(edges), "url-parts")

    name, action = fitting(F.col("host"), F.col("path"), rules)
    read = lambda df, *keep: df.select(*keep, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), digest("url").alias("node")).withColumns({"rule": name, "action": action})
    urls = pages.select("url").unionByName(tied.select(F.col("target").alias("url"))).unionByName(tied.select(F.col("source").alias("url")))
    told = lambda c: F.max(F.col("action") == c)
    nodes = read(urls).where("node is not null and action is not null").groupBy("node").agg(told("allow").alias("allowed"), told("block").alias("blocked"))
    blocked = parts.join(nodes.where("blocked"), parts["id"] == nodes["node"], "left_semi").select("component").distinct()
    caught = parts.join(blocked, "component", "left_semi").select(F.col("id").alias("node"), F.lit(False).alias("allowed"))
    # a node without edges is a component of its own
    decided = nodes.where("allowed or blocked").select("node", "allowed").unionByName(caught).groupBy("node").agg(F.max("allowed").alias("allowed"))
    decided = decided.select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("by_alias"))
    rows, free = read(pages, "page_id"), F.col("action").isNull() & F.col("node").isNotNull()
    sure = rows.where(~free).select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(False).alias("inherited"))
    asked = rows.where(free).join(decided, "node", "left")
    return sure.unionByName(asked.select("page_id", "host", "path", "rule", F.coalesce("by_alias", F.lit("allow")).alias("verdict"), F.col("by_alias").isNotNull().alias("inherited")))
