"""URL filters: host and path rules, and redirect equivalence that carries block decisions to aliases.

Rules (host, path, verdict) fit their host and all its subdomains where the path starts with the rule's; the longest rule
wins, by host and then by path. Few rules become one column expression; their number is a size the caller states.

Pages that no rule fits take the method's verdict. Redirects (`<meta http-equiv="refresh">`, and a table of redirects where
one is given) and canonical links (`<link rel="canonical">`) are edges between URLs, read without scheme and fragment, with the
host in lower case; relative targets are resolved against the page's own URL. Connected components of these edges are found in distributed rounds; an alias is blocked if its
component has a URL that a rule blocks and none that a rule allows: an explicit allow takes precedence. Rules speak about every
URL of the graph, crawled or not, each read as it is written: a blocked URL is usually no page of the table. All others
are allowed. URLs without an edge stay out of the graph and of every join on it.

Tags are read outside comments and outside the elements whose content is text or no part of the page (script, style, textarea,
title, template); one of these that is never closed runs to the end of the page.

A null url, or one without "://", has an empty host and path, fits no rule, joins no component and is allowed. A null page
text has no edges. Repeated rows and null ids return one row each; a page of several canonical links has an edge for each. Of equally
long rules the last listed wins. An empty table gives no rows. Other columns than page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, scope, stage

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL without scheme and fragment, its host in lower case; null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


#: What holds no tags of the page: comments, and elements whose content is text or no part of the page. One that is not closed runs to the end.
_HIDDEN = r"(?is)<!--.*?-->|<script\b.*?(?:</script\b[^>]*>|\z)|<style\b.*?(?:</style\b[^>]*>|\z)|<textarea\b.*?(?:</textarea\b[^>]*>|\z)|<title\b.*?(?:</title\b[^>]*>|\z)|<template\b.*?(?:</template\b[^>]*>|\z)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, its `.` and `..` segments worked out."""
    segments = F.split(F.substring(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), 2, 1 << 30), "/", -1)
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(segments, F.expr("cast(array() as array<string>)"), step), "/"))


def resolved(url: Column, to: Column) -> Column:
    """The target of a link on a page, by the rules for relative references; null where it names the page itself or nothing."""
    home, path = F.concat(F.lit("http://"), host_of(url)), path_of(url)
    whole = F.when(to.startswith("/"), to).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), to))
    parts = lambda k: F.regexp_extract(whole, r"(?s)^([^?#]*)(.*)$", k)
    return (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("?"), F.concat(home, path, to))
        .when((to != "") & ~to.startswith("#"), F.concat(home, without_dots(parts(1)), parts(2)))
    )


# The named character references that can stand in a URL.
NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def unescaped(value: Column) -> Column:
    """An attribute's value without character references: the named ones of NAMED, and numbers in decimal or hex."""
    part = F.regexp_extract_all(value, F.lit(r"(?i)&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9a-f]{1,6});|[^&]+|&"), F.lit(0))

    def one(x):
        number = F.when(x.rlike("(?i)^&#x"), F.conv(F.regexp_extract(x, "(?i)x([0-9a-f]+)", 1), 16, 10)).otherwise(F.regexp_extract(x, "#([0-9]+)", 1)).cast("int")
        sound = x.rlike("^&#.*;$") & ((number < 0xD800) | (number > 0xDFFF)) & (number <= 0x10FFFF)
        out = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(F.when(sound, number)), 8, "0")), "UTF-32"))
        for name, letter in NAMED.items():
            out = out.when(F.lower(x) == name, letter)
        return out.otherwise(x)

    return F.when(value.contains("&"), F.array_join(F.transform(part, one), "")).otherwise(value)


def edges_of(pages: DataFrame) -> DataFrame:
    """(a, b, to): the node of a page's own URL, that of each redirect or canonical link in its text, and the link's URL."""
    tags = F.filter(
        F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, ""), F.lit(_TAG), F.lit(0)),
        lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"),
    )
    target = lambda t: F.when(t.rlike(r"(?is)^<link"), F.regexp_extract(t, _HREF, 1)).otherwise(F.regexp_extract(t, _REFRESH, 1))
    found = (
        pages.where(F.col("url").contains("://") & (F.rlike("html", F.lit(r"(?i)canonical|refresh"))))
        .select("url", F.explode(F.transform(tags, target)).alias("to"))
        .select("url", resolved(F.col("url"), unescaped(F.col("to"))).alias("to"))
    )
    return found.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"), "to").where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) per row of (page_id, url, html); redirects: (source, target) URLs.

    alias_of is the least URL of the page's component, null for pages outside the graph.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))

    def ruled_of(df: DataFrame, url: str, *more: str) -> DataFrame:
        made = df.select(*more, node_of(F.col(url)).alias("node"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
        rule, said = rule_of(F.col("host"), F.col("path"), rules)
        return made.withColumns({"rule": rule, "said": said})

    ruled = ruled_of(slim, "url", "page_id")
    with scope() as keep:
        edges = stage(edges_of(pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))), "links")
        ends = edges.select(F.col("to").alias("url"))
        if redirects is not None:
            more = redirects.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
            ends = ends.unionByName(more.select(F.col("source").alias("url"))).unionByName(more.select(F.col("target").alias("url")))
            edges = edges.unionByName(more.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"), F.col("target").alias("to")).where("a <> b"))
        roots = components(edges, "urls")
        if roots.isEmpty():  # no alias at all: the rules decide alone
            return ruled.select("page_id", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of"))
        named = stage(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "aliases")
        # what rules say about each URL, of pages and of links' ends alike; those of one node meet as partial sums
        said = ruled.select("node", "said").unionByName(ruled_of(ends, "url").select("node", "said"))
        both = [F.max((F.col("said") == v).cast("int")).alias(v) for v in ("block", "allow")]
        seen = said.where("said is not null and node is not null").groupBy("node").agg(*both)
        # by shuffle, as broadcasts would pass through the driver
        spread = named.join(seen.hint("merge"), "node", "left").groupBy("root").agg(*[F.max(v).alias(v) for v in ("block", "allow")])
        marked = keep(stage(named.join(spread.hint("merge"), "root").select("node", "root", (F.coalesce("block", F.lit(0)) > F.coalesce("allow", F.lit(0))).alias("bad")), "marked"))
    # pages without a node match nothing; each goes to a key of its own, so that no task meets them all
    nowhere = F.concat(F.lit("\0"), F.xxhash64("page_id", F.monotonically_increasing_id()).cast("string"))
    return ruled.withColumn("node", F.coalesce("node", nowhere)).join(marked.hint("merge"), "node", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"),
        F.col("root").alias("alias_of"),
    )
