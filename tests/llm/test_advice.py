"""Cases from reviews: what a query once did less of than the whole job."""

import random
import re
from collections import Counter
from urllib.parse import urljoin

import duckdb
import pytest

pytest.importorskip("quern.llm")
import corpus_pipeline  # noqa: E402
from quern.llm import minhash, queries, secrets, simhash, urls  # noqa: E402


def kept_by_definition(rows):
    """Least doc_id of each component of documents whose sets of five-word shingles are at least 0.8 alike."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    group = list(range(len(rows)))
    while True:
        new = [min(group[j] for j in range(len(rows)) if near(sets[i], sets[j])) for i in range(len(rows))]
        if new == group:
            return {min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
        group = new


def test_near_dedup_by_shingle_similarity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = kept_by_definition([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = corpus_pipeline.near_dedup(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want)
    # a hub with more copies than are paired with one another: each copy is near the hub, hardly any near another copy
    draw = random.Random(5)
    hub = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = [(100, " ".join(hub))]
    for k in range(3 * minhash.SMALL):
        copy = list(hub)
        for at in draw.sample(range(0, 300, 6), 9):
            copy[at] = f"x{draw.randrange(10**6)}"
        rows.append((k + 200, " ".join(copy)))
    rows += [(1, ""), (2, None), (3, "Short text"), (4, "short  TEXT"), (5, "other")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == kept_by_definition(rows)
    assert simhash.keep_one(docs.where("false")).count() == 0


RELATIVE = ["page2.html", "../x", "?p=1", "./y/../z?q=/../r", "..", ".", "../../../up", "/abs/./w", "//other.org/v", "a:b", "HTTP://Far.org/a", "#top", "?u=http://far.org/b", "sub/"]


def test_relative_links(spark):
    bases = ["http://h.com", "http://h.com/", "https://h.com/d/e/f.html?s=/t#u", "http://h.com/d/e/"]
    rows = [(b, t) for b in bases for t in RELATIVE]
    made = spark.createDataFrame(rows, "url string, to string")
    want = spark.createDataFrame([(urljoin(b, t),) for b, t in rows], "to string")
    nodes = lambda df, c: [r[0] for r in df.select(urls.node_of(c)).collect()]
    got = nodes(made, urls.resolved(made["url"], made["to"]))
    for (b, t), g, w in zip(rows, got, nodes(want, want["to"]), strict=True):
        assert g == (None if t == "#top" else w), (b, t)
    pages = [(1, "http://bad.net/d/page2.html", ""), (2, "http://sub.bad.org/d/a.html", '<link rel="canonical" href="http://bad.net/d/page2.html">'), (3, "http://sub.bad.org/d/b.html", '<link rel=canonical href="a.html">'), (4, "http://sub.bad.org/e/c", '<meta http-equiv="refresh" content="0; url=../d/b.html">'), (5, "http://sub.bad.org/e/c?p=1", None), (6, "http://sub.bad.org/e/c", '<link rel=canonical href="?p=1">')]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert set(got.values()) == {"block"} and len(got) == 6


def judged_by_definition(pages, rules=urls.RULES):
    """(page_id, host, path, rule, verdict, alias_of) by plain loops over URLs; links are given, not read from the text."""
    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)", url or "")
        return (m[1].lower(), m[2], m[1].lower() + (m[2] + m[3] or "/") if m[1] else None) if m else ("", "", None)

    def ruled(url):
        host, path, _ = parts(url)
        fit = [(len(h), len(p), h + p, said) for said, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    group, known = {}, {u for _, u, _ in pages}
    for _, url, link in pages:
        a, b = parts(url)[2], parts(urljoin(url, link))[2] if url and link else None
        known |= {urljoin(url, link)} if b else set()
        if a and b and a != b:
            both = group.get(a, {a}) | group.get(b, {b})
            group |= dict.fromkeys(both, both)
    out = []
    for page, url, _ in pages:
        host, path, node = parts(url)
        rule, said = ruled(url)
        near = [ruled(u)[1] for u in known if node in group and parts(u)[2] in group[node]]
        out.append((page, host, path, rule, said or ("block" if "block" in near and "allow" not in near else "allow"), min(group[node]) if node in group else None))
    return Counter(out)


def test_urls_by_definition(spark):
    draw = random.Random(8)
    hosts = ["a.net", "b.example.net", "example.com", "x.org", "plain.com", "Plain.COM", "other.de", *(f"p{k}.com" for k in range(40))]
    links = [*[None] * 40, "/de/1", "../2", "?p=1", "?p=1&q=2", "3", "http://a.net/fr/1", "http://z.net/1", "https://x.org/fr/2", "//p1.com/en/3"]
    links += [f"http://{h}/never/{k}" for h in ("uncrawled.net", "y.example.net/en", "gone.org/fr", "plain.com") for k in range(4)]
    pages = [(k, f"http://{draw.choice(hosts)}/{draw.choice(['de', 'fr', 'en'])}/{draw.randrange(4)}{draw.choice(['', '', '?p=1'])}", draw.choice(links)) for k in range(120)]
    pages += [(800, "http://z.net/1", None), (900, None, None), (901, "no-scheme", None), (5, "http://a.net/en/1", None)]
    refer = lambda to: draw.choice([lambda x: x.replace("&", "&amp;"), lambda x: x.replace("/", "&#47;").replace("?", "&#x3F;"), lambda x: x])(to)
    tag = lambda k, to: to and (f'<p><!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="{refer(to)}">' if k % 2 else f"<META http-equiv=refresh content='0; URL={refer(to)}'>")
    df = spark.createDataFrame([(k, u, tag(k, to)) for k, u, to in pages], "page_id long, url string, html string")
    want = judged_by_definition(pages)
    assert sum(r[3] is None and r[4] == "block" for r in want) > 3 and sum(r[5] is not None for r in want) > 20
    assert Counter(map(tuple, urls.judge(df).collect())) == want
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert Counter(con.sql(queries.ORACLE["op8_url_filters"]).fetchall()) == want


def test_blocked_urls_need_not_be_pages(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.com/1", link.format("http://bad.net/z")), (2, "http://a.com/2", link.format("http://bad.net/z")),
        (3, "http://b.com/1", link.format("http://bad.net/y?a=1&amp;b=2")), (4, "http://b.com/2", link.format("http://bad.net/y?a=1&#38;b=2")),
        (5, "http://good.org/fr/1", link.format("http://bad.net/y?a=1&b=2")), (6, "http://c.com/1", link.format("http://d.com/")), (7, "http://bad.net", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}  # page 7 has no path, so no rule fits


def test_keys_joined_to_base_matches(spark):
    key = "Zk3x9Qp7Lm2Vt8Rw4Ys6Bn1"
    other = "qW8eR2tY6uI0oP4aS1dF5gH"
    cases = [
        (f"{key}/token=abcdef", "entropy:0:24,assign:24:36"), (f"é {key}/{'ab' * 14}/{other}", "entropy:2:26,hex:26:54,entropy:54:78"),
        ("Zk3x9Qp7Lm2Vt8R/token=abcdef", "assign:16:28"), (f"{'x' * 30}/token=abcdef", "assign:31:43"),
        (f"{key}/token=example-token=abcdef", "entropy:0:24,assign:24:50"), (f"example{key}/token=abcdef", "assign:31:43"),
    ]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(cases)], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in secrets.digest(df).collect()} == {k: want for k, (_, want) in enumerate(cases)}
    clean = [r["text"] for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert clean[0] == "[SECRET][SECRET]" and not any(s in clean[1] for s in (key, other))


def test_links_that_are_no_tags(spark):
    """What looks like a link inside a script, a style, a textarea, a title, a template or a comment is none; the SQL says the same."""
    link = '<link rel="canonical" href="http://bad.net/z">'
    hidden = [f"<script>var s = '{link}';</script>", f"<SCRIPT type=x>\n{link}</script >", f"<style>{link}</style>", f"<textarea rows=2>{link}</textarea>", f"<title>{link}</title>", f"<template>{link}</template>", f"<!-- {link} -->", f"<script>{link}"]
    shown = [link, f"<script>x</script>{link}", f"<scripty>{link}</scripty>", f"<style></style>{link}<script>", f"<!-- a -->{link}<!-- b -->"]
    rows = [(k, f"http://a{k}.org/de/", h) for k, h in enumerate(hidden + shown)] + [(99, "http://bad.net/z", ""), (100, None, link), (101, "nowhere", link), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["alias_of"]) for r in urls.judge(pages).collect()}
    assert {r[0] for r in got if r[4] == "block"} == {99, *range(len(hidden), len(rows) - 4)}
    con = duckdb.connect()
    frame = pages.toPandas()
    con.register("pages", frame)
    want = con.sql("SELECT CAST(page_id AS BIGINT), host, path, rule, verdict, alias_of FROM (" + queries.ORACLE["op8_url_filters"] + ")").fetchall()
    clean = lambda rows: Counter(tuple(None if x != x else x for x in r) for r in rows)
    assert clean(got) == clean(want)
